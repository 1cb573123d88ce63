"""Line dedup: repeated line runs from a suffix array built by prefix doubling.

Every line with words gets a 128-bit line id; a document is its sequence of
line ids. Suffixes are ranked by their first line, then by their first 2, 4, 8
... lines: the rank of 2k lines at p is the order of the pair (rank of k lines
at p, rank of k lines at p + k), found by sorting the distinct pairs by range.
Suffixes of one rank are an interval of the suffix array whose longest common
prefix is at least that many lines; ranks that occur once are dropped.

A run counts as repeated from ``min_words`` words on. A run of L lines at p is
named by two overlapping power-of-two ranks, (rank at p, rank at p + L - 2^j).
Of the runs inside a maximal repeated run it is enough to name, for every line,
the shortest that starts there and the shortest that ends there with
``min_words`` words: their union is the maximal run, and none is longer than
``min_words`` lines, so doubling ends after log2(min_words) rounds at any input
size. Each occurrence but the first, in order of id and line, is deleted.

Scale: groups are aggregated before they are joined back; a join on a hot line
is one that adaptive execution can split; no group is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.llm.common import drop, free_name, materialise, spared

KEY = ["nul", "id", "th"]


def line_runs(text: str | None, min_words: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Trimmed lines with words; lines in the shortest run of ``min_words`` words
    that starts at each, and that ends at each (0: there is none)."""
    lines = [s for x in (text or "").split("\n") if (s := x.strip())]
    sums = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])]).astype(np.int64)
    at = np.arange(len(lines))
    end = np.searchsorted(sums, sums[:-1] + min_words)
    begin = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
    return (
        [x.encode() for x in lines],
        np.where(end <= len(lines), end - at, 0),
        np.where(begin >= 0, at + 1 - begin, 0),
    )


def _splitter(min_words: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seqs, ids, starts, ends = [], [], [], [], []
            for i, text in enumerate(b.column(3)):
                lines, start, end = line_runs(text.as_py(), min_words)
                rows.append(np.full(len(lines), i))
                seqs.append(np.arange(len(lines)))
                ids += [xxhash.xxh3_128_digest(x) for x in lines]
                starts.append(start)
                ends.append(end)
            if not ids:
                continue
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(k).take(take) for k in range(3)]
                + [pa.array(np.concatenate(seqs), pa.int32()), pa.array(ids, pa.binary())]
                + [pa.array(np.concatenate(x), pa.int32()) for x in (starts, ends)],
                names=[*KEY, "seq", "line", "starts", "ends"],
            )

    return spared(split)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The row key: rows that share id and text are one document."""
    return docs.select(
        F.col(doc_id).isNull().alias("nul"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("th"),
        F.col(text).alias("text"),
    )


def _ranked(groups: DataFrame, made: list[str], *keys: str) -> DataFrame:
    """Groups with a rank that follows the order of their keys over all partitions."""
    ordered = groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(ordered.withColumn("rank", F.monotonically_increasing_id()), made)


def _groups(df: DataFrame, at: str, *keys: str) -> DataFrame:
    """What occurs more than once, with its first occurrence."""
    first = F.min(F.struct(*KEY, F.col(at).alias("seq"))).alias("first")
    return df.groupBy(*keys).agg(F.count("*").alias("c"), first).where("c > 1").drop("c")


def _later(df: DataFrame, at: str) -> DataFrame:
    return df.where(F.struct(*KEY, F.col(at).alias("seq")) != F.col("first"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 25) -> DataFrame:
    """(nul, id, th, seq) of every line that a later copy of a repeated run covers."""
    kind = "nul boolean, id long, th long, seq int, line binary, starts int, ends int"
    made: list[str] = []
    places = materialise(_keyed(docs, doc_id, text).mapInArrow(_splitter(min_words), kind), made)
    lines = _ranked(_groups(places, "seq", "line"), made, "line")
    ranks = materialise(places.join(lines, "line").select(*KEY, "seq", "starts", "ends", "rank", "first"), made)
    dead = _later(ranks.where("starts = 1"), "seq").select(*KEY, "seq")

    runs = ranks.where("starts > 1").select(*KEY, F.col("seq").alias("at"), F.col("starts").alias("n"))
    runs = runs.union(ranks.where("ends > 1").select(*KEY, F.expr("seq - ends + 1"), "ends")).distinct()
    runs = materialise(runs, made)
    longest = runs.agg(F.max("n")).first()[0] or 1
    now = ranks.select(*KEY, "seq", "rank")
    for j in range(1, int(math.log2(longest)) + 1):
        half, size = 1 << (j - 1), 1 << j
        shifted = now.select(*KEY, (F.col("seq") - half).alias("seq"), F.col("rank").alias("next"))
        pairs = materialise(now.join(shifted, [*KEY, "seq"]), made)
        names = _ranked(_groups(pairs, "seq", "rank", "next").drop("first").withColumnRenamed("rank", "prev"), made, "prev", "next")
        now = pairs.withColumnRenamed("rank", "prev").join(names, ["prev", "next"]).select(*KEY, "seq", "rank")
        now = materialise(now, made)
        own = runs.where((F.col("n") >= size) & (F.col("n") < 2 * size))
        head = now.select(*KEY, F.col("seq").alias("at"), F.col("rank").alias("head"))
        tail = now.select(*KEY, F.col("seq").alias("last"), F.col("rank").alias("tail"))
        named = own.join(head, [*KEY, "at"]).withColumn("last", F.col("at") + F.col("n") - size)
        named = materialise(named.join(tail, [*KEY, "last"]).select(*KEY, "at", "n", "head", "tail"), made)
        found = named.join(_groups(named, "at", "n", "head", "tail"), ["n", "head", "tail"])
        covers = F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("seq")
        dead = dead.union(_later(found, "at").select(*KEY, covers))
    dead = materialise(dead.distinct())
    drop(docs.sparkSession, made)
    return dead


def _remover(text_at: int, dead_at: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for b in batches:
            texts, totals, counts, runs = [], [], [], []
            for text, dead in zip(b.column(text_at), b.column(dead_at).to_pylist(), strict=True):
                text, gone, kept, own, seq = text.as_py(), set(dead or ()), [], [], -1
                lines = [] if text is None else text.split("\n")
                for no, line in enumerate(lines):
                    seq += bool(line.strip())
                    if not line.strip() or seq not in gone:
                        kept.append(line)
                    elif own and own[-1]["last"] == no - 1:
                        own[-1]["last"] = no
                    else:
                        own.append({"first": no, "last": no})
                texts.append(text if not gone else "\n".join(kept) if seq + 1 > len(gone) else "")
                totals.append(len(lines))
                counts.append(len(gone))
                runs.append(own)
            found = pa.StructArray.from_arrays(
                [pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, kind)],
                names=["n_lines", "n_removed", "runs"],
            )
            b = b.set_column(text_at, b.schema.field(text_at).name, pa.array(texts, pa.string()))
            yield b.set_column(dead_at, b.schema.field(dead_at).name, found)

    return spared(remove)


FOUND = "struct<n_lines: bigint, n_removed: bigint, runs: array<struct<first: bigint, last: bigint>>>"


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "dedup", min_words: int = 25
) -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of ``text``, and a
    struct ``out``: n_lines, n_removed and runs (first and last line removed, from 0).

    Defined results: null and empty texts stay as they are; blank lines take no
    part and stay, but a text that loses all other lines becomes empty; rows that
    share id and text are one document and keep the same lines; rows without id
    come last in order; a repeat inside one document counts; an empty table
    gives an empty result; other columns pass through whatever their names.
    """
    out = free_name(docs, out)
    dead = repeated_lines(docs, doc_id, text, min_words).groupBy(*KEY).agg(F.sort_array(F.collect_list("seq")).alias(out))
    marks = {c: free_name(docs, f"_{c}") for c in KEY}
    keyed = docs.withColumns(
        {
            marks["nul"]: F.col(doc_id).isNull(),
            marks["id"]: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)),
            marks["th"]: F.xxhash64(text),
        }
    )
    dead = dead.withColumnsRenamed(marks)
    both = keyed.join(dead, list(marks.values()), "left").select(*docs.columns, out)
    kind = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"x {FOUND}").fields])
    kind.fields[-1].name = out
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in kind.fields])
    return both.mapInArrow(_remover(docs.columns.index(text), len(docs.columns)), kind)
