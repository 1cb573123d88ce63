"""MinHash near-duplicates with min-max hashing.

A document's set holds its distinct 5-word shingles. Under each permutation both
the smallest and the largest hash are kept, so a signature of 2m values costs m
hash evaluations; either agrees between two sets with probability J, and the
pair has lower variance than two independent minima. Bands of two permutations
(two minima and two maxima) are the buckets that suggest pairs; links are
confirmed on the full sets. At J = 0.75 a pair shares none of 28 bands with
probability 2.4e-5, at J = 0.8 with 4e-7.

Scale: equal word sequences are one class from the start, with a number of its
own (a third of all rows may be one). Within a bucket no pairs are listed: in each round a bucket names
one pivot, a member asks only for the pivot it shares most buckets with, and
buckets whose members already are one component drop out. What several rounds
leave are few members in different components; those are compared outright.
Connected components alternate large-star and small-star steps, whose minima
aggregate before the shuffle.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declario.llm.common import drop, free_name, materialise, spared

RARE = 16
_FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (bytes.lower and bytes.split do just that)."""
    return text.encode("utf-8").lower().split() if text else []


def shingles(w: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words make one shingle."""
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    out = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        fold = _FOLD[i % 5] + np.uint64(2 * (i // 5))
        out += h[i : len(h) - n + 1 + i] * fold
    out ^= out >> np.uint64(32)
    return np.unique(out)


class MinMax:
    """Band keys of a set: minima and maxima under ``bands * rows / 2`` permutations."""

    def __init__(self, bands: int = 28, rows: int = 4, seed: int = 1):
        rng = np.random.default_rng(seed)
        m = bands * rows // 2
        self.bands, self.half = bands, rows // 2
        self.xor = rng.integers(0, 2**64, (m, 1), np.uint64)
        self.odd = rng.integers(0, 2**64, (m, 1), np.uint64) | np.uint64(1)
        self.mix = rng.integers(0, 2**64, (bands, rows), np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 2**64, bands, np.uint64)

    def signature(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(len(self.xor), 2**64 - 1, np.uint64)
        high = np.zeros(len(self.xor), np.uint64)
        for k in range(0, len(s), 4096):
            h = s[None, k : k + 4096] ^ self.xor
            h *= self.odd
            h ^= h >> np.uint64(29)
            np.minimum(low, h.min(axis=1), out=low)
            np.maximum(high, h.max(axis=1), out=high)
        return low, high

    def keys(self, s: np.ndarray) -> np.ndarray:
        low, high = self.signature(s)
        v = np.concatenate([low.reshape(self.bands, self.half), high.reshape(self.bands, self.half)], axis=1)
        v ^= v >> np.uint64(31)
        k = (v * self.mix).sum(axis=1, dtype=np.uint64) ^ self.salt
        k *= np.uint64(0x9E3779B97F4A7C15)
        return (k ^ (k >> np.uint64(32))).view(np.int64)


def _sketcher(ngram: int, minmax: MinMax):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, keys, ends = [], [], [], [0]
            for text in b.column(3):
                w = words(text.as_py())
                s = shingles(w, ngram)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(b" ".join(w)) if w else None)
                if w:
                    keys.append(minmax.keys(s))
                ends.append(ends[-1] + (minmax.bands if w else 0))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), bands],
                names=["id", "th", "nul", "n", "digest", "bands"],
            )

    return spared(sketch)


def _confirmer(ngram: int, num: int, den: int):
    """Keeps (a, b, ...) whose sets have den * intersection >= num * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            pivots, texts, others = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for i, p in enumerate(pivots):
                if p != last:
                    last, held = p, shingles(words(others[i].as_py()), ngram)
                s = shingles(words(texts[i].as_py()), ngram)
                both = len(np.intersect1d(s, held, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(held) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return spared(confirm)


def confirmed(pairs: DataFrame, texts: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """Of ``pairs`` (a, b), those linked on the full sets of ``texts`` (id, text).

    The member ``a`` is joined first, so a pivot's text is attached last and
    never shuffled once for each of its members.
    """
    got = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )
    return got.mapInArrow(_confirmer(ngram, num, den), "a long, b long")


def components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).

    Each large-star step hangs a node's larger neighbours on its smallest
    neighbour, each small-star step the smaller ones; both keep the components.
    What is written and needed afterwards is added to ``made``.
    """
    last: list[str] = []
    now = materialise(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), last)
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, last = last, []
        now = materialise(small, last)
        drop(edges.sparkSession, before)
    if made is not None:
        made += last
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """True if every larger end hangs on one smaller end that hangs on nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("k")), F.struct(F.col("v").alias("x"), F.lit(0).alias("k")))).alias("e"))
    bad = ends.groupBy("e.x").agg(F.sum("e.k").alias("up"), F.min("e.k").alias("low")).where("up > 1 OR (up = 1 AND low = 0)")
    return bad.isEmpty()


def _exploder(ngram: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(words(t.as_py()), ngram) for t in b.column(1)]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(s) for s in own])))
            flat = np.concatenate(own) if own else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(flat.view(np.int64))], names=["id", "s"])

    return spared(explode)


def unresolved(crowd: DataFrame, texts: DataFrame, ngram: int, percent: int, made: list[str]) -> DataFrame:
    """Pairs (a, b) of ``crowd`` (key, id, comp) in different components that may be
    linked. The bound on an intersection is exact, see above."""
    ids = crowd.select("id", "comp").distinct()
    own = texts.join(ids.select("id"), "id").select("id", "text")
    own = materialise(own.mapInArrow(_exploder(ngram), "id long, s long"), made)
    rare = own.join(own.groupBy("s").agg(F.count("*").alias("c")).where(f"c <= {RARE}"), "s")
    sizes = own.groupBy("id").agg(F.count("*").alias("n"))
    odd = rare.groupBy("id").agg(F.count("*").alias("r"))
    known = ids.join(sizes, "id").join(odd, "id", "left").select("id", "comp", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("s"))
    known = materialise(known, made)
    other = known.select(F.col("id").alias("b"), F.col("comp").alias("other"), F.col("n").alias("m"), F.col("s").alias("t"))

    listed = F.sort_array(F.collect_list("id"))  # RARE ids at most
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    together = rare.where("c > 1").groupBy("s").agg(listed.alias("ids")).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("q"))
    fits = f"comp <> other AND 100 * (least(s, t) + q) >= {percent} * (n + m - least(s, t) - q)"
    by_rare = together.join(known.withColumnRenamed("id", "a"), "a").join(other, "b").where(fits).select("a", "b")

    crowd = materialise(crowd.select("key", "id").join(known, "id"), made)
    least = crowd.groupBy("key").agg(F.min("n").alias("m"))
    near = crowd.join(least, "key").where(f"100 * s >= {percent} * (n + greatest(m, s) - s)").drop("m")
    near = near.join(near.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")  # a key for each band at most
    near = materialise(near, made)
    right = near.select("key", F.col("id").alias("b"), F.col("comp").alias("other"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("keys").alias("keys_b"))
    fits = f"id < b AND comp <> other AND 100 * least(s, t) >= {percent} * (n + m - least(s, t)) AND array_min(array_intersect(keys, keys_b)) = key"
    by_bucket = near.join(right, "key").where(fits).select(F.col("id").alias("a"), "b")
    return by_rare.union(by_bucket).distinct()


def _free(df: DataFrame) -> None:
    """Let the driver drop frames that are done, so Spark deletes their shuffle files."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    ngram: int = 5,
    percent: int = 75,
    bands: int = 28,
    rows: int = 4,
    pivot_rounds: int = 2,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents with 100 * intersection >= percent * union are linked; the
    component is named by its smallest id. Defined results: null, empty or
    blank texts have an empty set and are linked with nothing; fewer words than
    ``ngram`` make one shingle; rows that share an id are documents of their own,
    each by its own text, and a repeated row gets the same answer; a row whose
    id is null is linked with nothing, has a null component and is kept; an
    empty table gives an empty result. Only the two named columns are read.
    """
    own = docs.where(F.col(doc_id).isNotNull())
    rest = docs.where(F.col(doc_id).isNull())
    found = _labelled(own, doc_id, text, ngram, percent, bands, rows, pivot_rounds)
    found = found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("rep.id", "id").alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    alone = rest.select(F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("th"), F.lit(True).alias("nul"), F.col(text).alias("text"))
    alone = alone.mapInArrow(_sketcher(ngram, MinMax(bands, rows)), SKETCH)
    return found.union(alone.select("id", "n", F.lit(None).cast("long"), F.lit(True)))


def one_of_each(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    ngram: int = 5,
    percent: int = 75,
    bands: int = 28,
    rows: int = 4,
    pivot_rounds: int = 2,
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest
    id, and of several texts under it the one with the smallest hash.

    Defined results: rows without id are documents like others and come last in
    order; of rows that share id and text the smallest stays, by its columns in
    order; texts without words are linked with nothing, so of them only rows
    that share id and text are repeats; an empty table gives an empty result.
    """
    found = _labelled(docs, doc_id, text, ngram, percent, bands, rows, pivot_rounds)
    found = materialise(found.select(*KEY, F.coalesce(F.col("rep") != F.struct(*KEY), F.lit(False)).alias("gone")))
    mark = {c: free_name(docs, f"_{c}") for c in KEY}
    names = list(mark.values())
    gone = found.where("gone").select(*KEY).distinct().withColumnsRenamed(mark)
    again = materialise(found.where("NOT gone").groupBy(*KEY).agg(F.count("*").alias("c")).where("c > 1").select(*KEY).withColumnsRenamed(mark))
    keyed = docs.select("*", *(c.alias(mark[k]) for k, c in _key(doc_id, text).items()))
    kept = keyed.join(gone, names, "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again, names, "left_semi").groupBy(*names).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.join(again, names, "left_anti").select(docs.columns).union(once.select("row.*"))


KEY = ["nul", "id", "th"]
SKETCH = "id long, th long, nul boolean, n long, digest binary, bands array<long>"


def _key(doc_id: str, text: str) -> dict:
    """What a row is known by: rows that share id and text are repeats. Without nulls, to be joined."""
    return {
        "nul": F.col(doc_id).isNull(),
        "id": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)),
        "th": F.coalesce(F.xxhash64(text), F.lit(0)),
    }


def _labelled(docs: DataFrame, doc_id: str, text: str, ngram: int, percent: int, bands: int, rows: int, pivot_rounds: int) -> DataFrame:
    """(nul, id, th, n, rep) of every row; rep: the least (nul, id, th) of its
    component, null where the row is alone.

    Rows with the same words are one class, which has a number of its own.
    """
    key = _key(doc_id, text)
    docs = docs.select(*(key[c].alias(c) for c in ("id", "th", "nul")), F.col(text).alias("text"))
    sketches = materialise(docs.mapInArrow(_sketcher(ngram, MinMax(bands, rows)), SKETCH))
    classes = sketches.where("n > 0").groupBy("digest").agg(F.min(F.struct(*KEY)).alias("r"), F.count("*").alias("c"), F.first("bands").alias("bands"))
    made: list[str] = []
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), made)

    each = classes.select("id", F.explode("bands").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = materialise(each.join(shared, "key"), made)
    _free(buckets)
    asked = materialise(buckets.groupBy("id").agg(F.sum("c").alias("company")), made)
    texts = _texts(docs, sketches, classes.join(asked.select("id"), "id").select(F.col("id").alias("cls"), "r.*"), made)
    _free(texts)
    labels = asked.withColumn("comp", F.col("id"))
    tested, merges = None, None
    for turn in range(pivot_rounds + 1):
        open_ = buckets.join(labels, "id").select("key", "id", "comp", "company")
        chance = F.lit(0) if turn == 0 else F.xxhash64("id", F.lit(turn))
        differ = open_.groupBy("key").agg(
            F.max(F.struct(chance, "company", -F.col("id"), "id", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high")
        )
        differ = differ.where("low < high").select("key", F.col("p.id").alias("b"), F.col("p.comp").alias("other"))
        if turn < pivot_rounds:
            pairs = open_.join(differ, "key").where("comp <> other").groupBy("id", "b").agg(F.count("*").alias("k"))
            if tested is not None:
                pairs = pairs.join(tested.selectExpr("a AS id", "b"), ["id", "b"], "left_anti")
            pairs = pairs.groupBy(F.col("id").alias("a")).agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("b"))
        else:
            crowd = materialise(open_.join(differ.select("key"), "key").drop("company"), made)
            if crowd.isEmpty():
                break
            pairs = unresolved(crowd, texts, ngram, percent, made)
            if tested is not None:
                pairs = pairs.join(tested.union(tested.selectExpr("b AS a", "a AS b")), ["a", "b"], "left_anti")
        pairs = materialise(pairs, made)
        if pairs.isEmpty():
            continue
        links = materialise(confirmed(pairs, texts, ngram, percent, 100), made)
        _free(links)
        tested = pairs if tested is None else tested.union(pairs)
        if links.isEmpty():
            continue
        merges = links if merges is None else merges.union(links)
        labels = asked.join(components(merges, made), F.col("id") == F.col("node"), "left")
        labels = materialise(labels.select("id", "company", F.coalesce("component", "id").alias("comp")), made)
    found = classes.join(labels.selectExpr("id", "comp AS found"), "id", "left").select("digest", F.coalesce("found", "id").alias("comp"), "c", "r")
    least = found.groupBy("comp").agg(F.min("r").alias("rep"))
    # Written first, so that the last join has nothing but exchanges below it and a hot class can be split.
    found = materialise(found.join(least, "comp").where("c > 1 OR rep <> r").select("digest", "rep"))
    drop(docs.sparkSession, made)
    return sketches.select(*KEY, "n", "digest").join(found, "digest", "left").select(*KEY, "n", "rep")


def _texts(docs: DataFrame, sketches: DataFrame, wanted: DataFrame, made: list[str]) -> DataFrame:
    """(id, text), one for each of ``wanted`` (cls, nul, id, th).

    Copies of a repeated row meet in a partial aggregate before the shuffle;
    all other rows are joined as they are.
    """
    again = sketches.where("n > 0").groupBy(*KEY).agg(F.count("*").alias("c")).where("c > 1").select(*KEY)
    again = materialise(again, made)
    if not again.isEmpty():
        once = docs.join(again, KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text"))
        docs = docs.join(again, KEY, "left_anti").select(*KEY, "text").union(once)
    return materialise(docs.join(wanted, KEY).select(F.col("cls").alias("id"), "text"), made)
