"""Approximate nearest neighbours: hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample (``max_fit`` vectors, those with the
smallest hash of their id) of unit vectors; every row is indexed. A query walks
the tree through a priority queue of nodes by distance to their centres, so
leaves come out in the order of promise. How many leaves are visited is
calibrated: ``n_probe`` queries (the smallest hashes) are answered exactly
against all rows, in blocks, and visits are widened to the smallest number at
which their neighbours are found with ``recall``, plus one in eight. A query
whose leaves hold fewer than ``k + 1`` rows goes on until they do.

Scale: the tree is broadcast (its nodes are bounded by ``max_fit`` over
``leaf_size``, a few MB). Vectors that are equal keep their ``k + 1`` smallest
ids before anything else: no other copy can be among the k nearest, as ties go
to smaller ids (a third of all rows may be one vector). Rows and visits meet in
blocks of a leaf: both its rows and its visits are dealt into parts of about
``block`` by a hash, and every part of the one meets every part of the other, so
no task holds more than two parts however large a leaf grows. Unit vectors
choose candidates; all within rounding of the k-th are scored again in double
precision on the original vectors, and the k best of each block are merged by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from declario.llm.common import materialise, spared


class Tree:
    """k-means of k-means; leaves are numbered."""

    def __init__(self, x: np.ndarray, branch: int = 8, leaf_size: int = 64, seed: int = 5):
        self.rng = np.random.default_rng(seed)
        self.branch, self.leaf_size = branch, leaf_size
        self.centres: list[np.ndarray] = []  # of each inner node, its children's centres
        self.children: list[list[int]] = []  # inner node n >= 0, leaf as -1 - number
        self.leaves = 0
        self.root = self.grow(x)

    def grow(self, x: np.ndarray) -> int:
        if len(x) <= self.leaf_size:
            self.leaves += 1
            return -self.leaves
        c, of = self.means(x)
        if len(c) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(c)
        self.children.append([])
        self.children[node] = [self.grow(x[of == i]) for i in range(len(c))]
        return node

    def means(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = x[np.sort(self.rng.choice(len(x), min(self.branch, len(x)), replace=False))]
        for _ in range(12):
            of = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
            c = np.stack([x[of == i].mean(axis=0) for i in range(len(c)) if (of == i).any()])
        return c, np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        out = np.full(len(x), -1 - self.root, np.int64) if self.root < 0 else np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))] if self.root >= 0 else []
        while todo:
            node, rows = todo.pop()
            c = self.centres[node]
            of = np.argmin((c**2).sum(1) - 2 * x[rows] @ c.T, axis=1)
            for i, child in enumerate(self.children[node]):
                own = rows[of == i]
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def order(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and more until ``least`` rows are in them."""
        queue, out, held = [(0.0, self.root)], [], 0
        while queue and (len(out) < most or held < least):
            d, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += 0 if sizes is None else int(sizes[-1 - node])
                continue
            for far, child in zip(((self.centres[node] - q) ** 2).sum(axis=1).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (far, child))
        return out


SLACK = 1e-9  # unit vectors' products are within this of the measure


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x) if x.size else x
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of vectors that take part, as arrays of doubles."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


def _exact(probe: np.ndarray, ids: np.ndarray, k: int):
    """The k nearest of each probe among the rows of a partition, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                rows, leaf, x = part.column(0).to_numpy(), part.column(1).to_numpy(), unit(matrix(part.column(2)))
                s = probe @ x.T
                for i, q in enumerate(ids):
                    own = rows != q
                    score, row, of = (np.concatenate(p) for p in zip(held[i], (s[i][own], rows[own], leaf[own]), strict=True))
                    top = best(score, row, k)
                    held[i] = score[top], row[top], of[top]
        counts = [len(h[0]) for h in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, counts)), *(pa.array(np.concatenate([h[j] for h in held])) for j in (0, 1, 2))],
            names=["q", "score", "vec_id", "leaf"],
        )

    return run


def visits_for(tree: Tree, probes: list[tuple[int, np.ndarray]], found: pd.DataFrame, k: int, recall: float) -> int:
    """Leaves to visit so that the probes' exact neighbours are found with ``recall``."""
    ranks = []
    vectors = dict(probes)
    for q, rows in found.groupby("q"):
        place = {leaf: i + 1 for i, leaf in enumerate(tree.order(unit(vectors[q]), tree.leaves))}
        ranks += [place[x] for x in rows.sort_values(["score", "vec_id"], ascending=[False, True])["leaf"][:k]]
    if not ranks:
        return tree.leaves
    need = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)])
    return min(tree.leaves, need + -(-need // 8))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    recall: float = 0.97,
    max_fit: int = 20000,
    n_probe: int = 100,
    branch: int = 8,
    leaf_size: int = 64,
    block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): cosine neighbours of ``queries`` in ``vectors``.

    Defined results: vectors that are null, empty, zero or hold a null or a
    number that isn't finite take no part, nor do rows without id; vectors are
    compared with vectors of their own length; fewer than k candidates give all
    of them; a repeated id counts once, by its first vector in order of
    components; an empty table gives an empty result.
    """
    rows = usable(vectors, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = usable(queries, vec_id, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widths = sorted(r.n for r in rows.select(F.size("v").alias("n")).distinct().collect())  # a row for each length
    for n in widths:
        fits = F.size("v") == n
        part = _nearest(rows.where(fits), asked.where(fits), k, recall, max_fit, n_probe, branch, leaf_size, block)
        found = part if len(widths) == 1 else found.union(part)
    return found


def _nearest(
    rows: DataFrame, asked: DataFrame, k: int, recall: float, max_fit: int, n_probe: int, branch: int, leaf_size: int, block: int
) -> DataFrame:
    """nearest() of usable vectors of one length, one for each id."""
    spark = rows.sparkSession
    chosen = rows.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_fit)
    sample = rows.join(F.broadcast(chosen), "vec_id").toArrow()
    out = "query_id long, rank int, vec_id long, score double"
    by_id = sorted(zip(sample["vec_id"].to_pylist(), sample["v"].to_pylist(), strict=True))
    tree = Tree(unit(np.array([v for _, v in by_id])), branch, leaf_size)
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaf_of(unit(matrix(b.column(1)))) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf), b.column(1)], names=["vec_id", "leaf", "v"])

    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v")
    index = materialise(few.mapInArrow(spared(assign), "vec_id long, leaf long, v array<double>"))
    asked = materialise(asked)
    probe = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_probe).toArrow()
    probes = list(zip(probe["vec_id"].to_pylist(), map(np.array, probe["v"].to_pylist()), strict=True))
    if not probes:
        return spark.createDataFrame([], out)
    ids = np.array([q for q, _ in probes], np.int64)
    exact = index.mapInArrow(_exact(unit(np.array([v for _, v in probes])), ids, k), "q long, score double, vec_id long, leaf long")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    exact = exact.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k).drop("n")
    visits = visits_for(tree, probes, exact.toPandas(), k, recall)

    counts = index.groupBy("leaf").agg(F.count("*").alias("n"))  # a row for each leaf
    counted = counts.toArrow()
    sizes = np.zeros(tree.leaves, np.int64)
    sizes[counted["leaf"].to_numpy()] = counted["n"].to_numpy()

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = [shared.value.order(q, visits, sizes, k + 1) for q in unit(matrix(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves, pa.list_(pa.int64()))], names=["query_id", "q", "leaves"])

    bound = materialise(asked.mapInArrow(spared(bins), "query_id long, q array<double>, leaves array<long>"))
    visited = bound.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("visits"))
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    parts = materialise(counts.join(visited, "leaf").select("leaf", blocks("n").alias("parts"), blocks("visits").alias("turns")))
    parts = F.broadcast(parts)  # a row for each leaf
    deal = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = index.join(parts, "leaf").select("leaf", deal("vec_id", "parts").alias("part"), each("turns").alias("turn"), "vec_id", "v")
    asked_at = bound.select("query_id", "q", F.explode("leaves").alias("leaf")).join(parts, "leaf")
    asked_at = asked_at.select("leaf", each("parts").alias("part"), deal("query_id", "turns").alias("turn"), "query_id", "q")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            v, ids = matrix(left["v"].combine_chunks()), left["vec_id"].to_numpy()
            x = unit(v)
            for at in range(0, right.num_rows, 512):
                some = right.slice(at, 512)
                raw = matrix(some["q"].combine_chunks())
                for q, own, s in zip(some["query_id"].to_numpy(), raw, unit(raw) @ x.T, strict=True):
                    s[ids == q] = -np.inf
                    near = candidates(s, k)
                    score = cosines(own, v[near])
                    top = np.lexsort((ids[near], -score))[:k]
                    found.append((np.full(len(top), q), ids[near][top], score[top]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    place = ["leaf", "part", "turn"]
    met = dealt.groupBy(*place).cogroup(asked_at.groupBy(*place)).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def candidates(s: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores that can be among the k largest, given their rounding."""
    live = np.flatnonzero(s > -np.inf)
    if len(live) <= k:
        return live
    cut = np.partition(s[live], len(live) - k)[len(live) - k]
    return live[s[live] >= cut - SLACK]


def cosines(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In double precision, the same for equal vectors whatever stands around them."""
    a, rows = scaled(a), scaled(rows)
    return (rows * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((rows * rows).sum(axis=1)))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(cosines(a, b[None])[0])
