"""Diff queries must compare whole vectors and all orders: against plain versions."""

import datetime

from declario.queries import QUERIES


def orders(spark, path):
    rows = [(k, 1, "FOP"[k % 3], float(k % 5), datetime.datetime(2020, 1, 1), f"{k % 4}-P") for k in range(1, 47) if k not in (20, 21)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return {r[0]: r for r in rows}


def test_array_diff_reads_whole_vectors(spark, tmp_path):
    vectors = {i: [0.25 * ((i * 31 + j * j) % 7) - 0.75 for j in range(64)] for i in range(9)}
    vectors[4] = vectors[3][:-1] + [vectors[3][-1] + 5]  # apart only in the last component
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")

    def score(i):
        a, b = ([x * 4 for x in vectors[k]] + [0.0] * (k % 3) for k in (i, i + 1))
        n, least = max(len(a), len(b)), min(len(a), len(b))
        return round((sum(0.5 for x, y in zip(a, b) if x != y) + n - least) / n, 6)

    got = {r.vec_id: r.score for r in QUERIES["q25_diff_array_positional"](spark, str(tmp_path)).collect()}
    assert got == {i: score(i) for i in range(8)}
    assert got[3] == round(1.5 / 65, 6)


def test_scores_of_all_orders(spark, tmp_path):
    o = orders(spark, tmp_path)

    def score(i):
        a, b = o.get(i), o.get(i + 1)
        if a is None or b is None:
            return 1.0
        t = a[3] if i % 7 else None
        parts = [0 if a[2] == b[2] else 0.5, 0 if a[5] == b[5] else 0.5, 1 if t is None else 0 if t == b[3] else 0.5, 1]
        return round(sum(parts) / 4, 6)

    got = {r.id: r.score for r in QUERIES["q24_diff_score_pairs"](spark, str(tmp_path)).collect()}
    assert got == {i: score(i) for i in o.keys() | {k - 1 for k in o}}


def test_differences_of_all_orders(spark, tmp_path):
    o = orders(spark, tmp_path)
    want = set()
    for i in o.keys() | {k - 1 for k in o}:
        for path, at in (("status", 2), ("priority", 5)):
            old, new = (o[k][at] if k in o else None for k in (i, i + 1))
            if old != new:
                want.add((i, path, "added" if old is None else "removed" if new is None else "changed", old, new))
    got = [(r.id, r.path, r.op, r.old, r.new) for r in QUERIES["q42_diff_table"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {op for _, _, op, _, _ in got} == {"added", "removed", "changed"}
