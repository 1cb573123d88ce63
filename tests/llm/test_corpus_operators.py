"""Operators that compare documents, against brute force, and their edge cases."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from declario.llm import lines, minhash, neighbours


def rows_of(df):
    return [r.asDict(True) for r in df.collect()]


# near duplicates


def plain_set(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            up[top(i)] = top(j)
    low = defaultdict(lambda: np.inf)
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low[top(i)], d)
    return [(d, len(s), low[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(rng, base, k):
    w = list(base)
    for i in rng.choice(len(w), k, replace=False):
        w[i] = f"e{rng.integers(1e9)}"
    return " ".join(w)


def test_near_duplicates(spark):
    """Groups whose copies are near an original but not each other, chains, short and empty texts."""
    rng = np.random.default_rng(4)
    rows, base = [], [f"w{i}" for i in range(150)]
    rows += [" ".join(base)] + [edited(rng, base, int(k)) for k in rng.integers(0, 9, 60)]
    chain = [f"c{i}" for i in range(120)]
    for _ in range(6):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 2).split()
    shared = [f"s{i}" for i in range(60)]
    rows += [" ".join(shared + [f"x{i}_{j}" for j in range(40)]) for i in range(30)]
    rows += ["One two", "one TWO", "one", "", None, "  ", "a b c d e", "A b\tc\nd  e", "é É", "É É"]
    rows = [(1000 - i, t) for i, t in enumerate(rows)]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit(0))))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (None, long), (None, None), (3, "x")]
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(((r["doc_id"] or 0), r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signature_is_unbiased():
    m = minhash.MinMax(bands=200, rows=4)
    a, b = minhash.shingles([b"%d" % i for i in range(404)]), minhash.shingles([b"%d" % i for i in range(100, 504)])
    both = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = np.mean([x == y for x, y in zip(np.concatenate(m.signature(a)), np.concatenate(m.signature(b)))])
    assert agree == pytest.approx(both, abs=0.05)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (41, 40), (60, 41), (7, 7)]
    got = {r["node"]: r["component"] for r in rows_of(minhash.components(spark.createDataFrame(edges, "a long, b long")))}
    assert {n: got.get(n, n) for n in (1, 2, 17, 30, 40, 41, 50, 60)} == {1: 1, 2: 1, 17: 1, 30: 1, 40: 40, 41: 40, 50: 40, 60: 40}


# lines


def plain_dedup(rows, least):
    """Runs by their text, first occurrence kept, any run of ``least`` words or more."""
    docs = {d: [x.strip() for x in (t or "").split("\n")] for d, t in rows}
    seqs = {d: [x for x in ls if x] for d, ls in docs.items()}
    first, dead = {}, defaultdict(set)
    for d in sorted(seqs):
        for a in range(len(seqs[d])):
            for b in range(a + 1, len(seqs[d]) + 1):
                if sum(len(x.split()) for x in seqs[d][a:b]) >= least:
                    if first.setdefault(tuple(seqs[d][a:b]), (d, a)) != (d, a):
                        dead[d].update(range(a, b))
    out = {}
    for d, t in rows:
        seq, kept = -1, []
        for x in (t or "").split("\n"):
            seq += bool(x.strip())
            if not x.strip() or seq not in dead[d]:
                kept.append(x)
        out[d] = (t if not dead[d] else "" if len(dead[d]) == len(seqs[d]) else "\n".join(kept), len(dead[d]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["a", "b c", "d e f", "g h i j k l m n", " a ", ""]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(1, 14)))) for i in range(25)]
    rows += [(50, rows[3][1]), (51, None), (52, ""), (53, "\n\n")]
    got = {r["doc_id"]: r for r in rows_of(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("dedup", F.lit(1)), min_words=7))}
    for d, (text, n) in plain_dedup(rows, 7).items():
        assert (got[d]["text"], got[d]["dedup_"]["n_removed"]) == (text, n), d
        assert sum(r["last"] - r["first"] + 1 for r in got[d]["dedup_"]["runs"]) >= n


def test_line_dedup_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    long = "\n".join(f"line {i} " + "x " * 10 for i in range(5000))
    rows = [(1, "own text\n" + passage), (2, passage + "\nother"), (2, passage + "\nother"), (None, passage), (3, long), (4, long + "\nmore")]
    got = rows_of(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(r["text"] for r in got) == sorted(["own text\n" + passage, "other", "other", "", long, "more"])
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 12))
    x[100:700] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11), (2003, [1.0] * 3), (2004, [None] + [1.0] * 11), (2005, []), (None, [1.0] * 12), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(rows_of(neighbours.nearest(df, df.where("vec_id % 50 = 0"), max_fit=600, leaf_size=20, block=64)), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -2
        want = np.lexsort((np.arange(1500), -s))[:5].tolist()
        assert len(got[q]) == 5 and [sc for _, sc in got[q]] == sorted([sc for _, sc in got[q]], reverse=True)
        hit += len(set(want) & {v for v, _ in got[q]})
        if 100 <= q < 700:
            assert [v for v, _ in got[q]] == want  # ties to smaller ids
    assert set(got) == set(range(0, 1500, 50)) and hit >= 0.9 * 150


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = rows_of(neighbours.nearest(df, df.where("vec_id = 0")))
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)] and got[0]["score"] == pytest.approx(0.5**0.5)
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0


def test_best_bin_first_visits_every_leaf_once():
    x = np.random.default_rng(0).normal(size=(500, 6))
    tree = neighbours.Tree(x, leaf_size=16)
    order = tree.order(x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.leaf_of(x[:1])[0]
