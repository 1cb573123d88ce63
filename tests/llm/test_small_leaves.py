"""Neighbours where the leaves visited hold fewer than k rows."""

import numpy as np

from declario.llm import neighbours


def test_every_query_gets_k_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 6))
    x[60:90] = x[60]  # copies shrink to k + 1 rows of the index
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, df, k=5, recall=0.2, leaf_size=2, branch=4).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == dict.fromkeys(range(120), 5)


def test_order_goes_on_to_enough_rows():
    x = np.random.default_rng(2).normal(size=(200, 4))
    tree = neighbours.Tree(x, 4, 3)
    sizes = np.bincount(tree.leaf_of(x), minlength=tree.leaves)
    for q in x[:20]:
        found = tree.order(q, 1, sizes, 6)
        assert found == tree.order(q, len(found)) and sizes[found].sum() >= 6 > sizes[found[:-1]].sum()
    assert len(tree.order(x[0], 1, sizes, 10**9)) == tree.leaves
