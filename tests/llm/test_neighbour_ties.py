"""Ties, lengths and sizes of vectors."""

import numpy as np

from declario.llm import neighbours


def test_parallel_vectors_are_ranked_by_the_measure(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=16)
    x = np.outer(rng.uniform(0.1, 50, 300), v)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id IN (0, 100, 250)"), recall=1.0, block=64).collect()
    for q in (0, 100, 250):
        score = neighbours.cosines(x[q], x)
        score[q] = -2
        want = np.lexsort((np.arange(300), -score))[:5].tolist()
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
        assert [r.score for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == score[want].tolist()


def test_lengths_and_magnitudes(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3.0, 3.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 2.0, 0.0]), (5, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in neighbours.nearest(df, df).collect()}
    half = round(0.5**0.5, 9)
    assert got == {(0, 1): (2, 1.0), (0, 2): (1, half), (1, 1): (0, half), (1, 2): (2, half), (2, 1): (0, 1.0), (2, 2): (1, half), (3, 1): (4, 0.0), (4, 1): (3, 0.0)}


def test_blocks_of_visits(spark):
    """Rows and queries of one leaf dealt into many parts give the same answer."""
    x = np.random.default_rng(5).normal(size=(400, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    whole = neighbours.nearest(df, df, recall=1.0, leaf_size=1000).collect()
    parts = neighbours.nearest(df, df, recall=1.0, leaf_size=1000, block=37).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))
