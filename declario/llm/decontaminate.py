"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to lower-case words joined by single spaces. Every window
of ``window`` consecutive words of a benchmark item is a pattern (an item with
fewer words, but not none, is one pattern). One automaton over all patterns
reads each document once; matches are word ranges, which map back to code-point
offsets of the original text.

The items are broadcast and each worker builds the automaton once. Its size is
bounded before: a pattern has at most the bytes of ``window`` words, so item text
times ``window`` bounds the patterns, and a node takes some 40 bytes. Up to
``max_block_bytes`` of patterns make one automaton (160 MB at the default);
beyond that the items are dealt into blocks by a hash, and the documents, written
to shared storage after each block, are scanned by one automaton at a time, so
no broadcast exceeds the bound by more than hashing's unevenness and one item.
A document keeps merged word ranges and a set of items, never single hits.

Defined results: a null or wordless text has no words and no hits; a null or
wordless item has no window; repeated item_ids count once; windows of an item
whose id is null hit words but name no item; repeated documents are judged row
by row; an empty table gives an empty result or no hits.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.llm.common import arrow_type, drop, free_name, materialise, spared

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = T.StructType(
    [
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
SUMMARY = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("items_sha256", T.StringType()),
        T.StructField(
            "spans",
            T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
        ),
    ]
)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_TABLE).split() if text else []


def windows(text: str | None, size: int) -> list[bytes]:
    """Patterns of an item: its word windows, framed by spaces."""
    w = words(text)
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(max(1, len(w) - size + 1))] if w else []


def automaton(items: list[tuple[str | None, str | None]], size: int):
    """Values: (words in the pattern, ids of the items that have it)."""
    import ahocorasick

    found: dict[bytes, set] = {}
    for item, text in items:
        for p in windows(text, size):
            found.setdefault(p, set()).add(item)
    a = ahocorasick.Automaton()
    for p, ids in found.items():
        a.add_word(p.decode("latin-1"), (p.count(b" ") - 1, tuple(ids)))
    if found:
        a.make_automaton()
    return a if found else None


@lru_cache(1)
def shared(items: Broadcast, size: int):
    """One automaton for each worker, for as long as it works on the same items."""
    return automaton(items.value, size)


def match(a, norm: bytes) -> Iterator[tuple[int, int, tuple]]:
    """(first word, last word, item ids) of each occurrence, in order of last words."""
    at, seen = 0, 0
    for end, (n, ids) in a.iter(norm.decode("latin-1")):
        seen += norm.count(b" ", at, end)
        at = end
        yield seen - n, seen - 1, ids


def covered(hits: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges, merged where they overlap or touch; the last words must not fall."""
    out: list[tuple[int, int]] = []
    for a, b in hits:
        while out and a <= out[-1][0]:
            out.pop()
        if out and a <= out[-1][1] + 1:
            a = out.pop()[0]
        out.append((a, b))
    return out


def scan(a, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Word ranges that patterns cover, and the ids of their items."""
    ids, listed = set(), set()

    def ranges() -> Iterator[tuple[int, int]]:
        for first, last, own in match(a, b" " + b" ".join(w) + b" "):
            if id(own) not in listed:  # once for a pattern, however often it occurs
                listed.add(id(own))
                ids.update(own)
            yield first, last

    return (covered(ranges()), ids) if a is not None and w else ([], ids)


def summary(text: str, n_words: int, runs: list[tuple[int, int]], ids: Iterable) -> dict:
    named = sorted(x for x in ids if x is not None)
    ends = {x for run in runs for x in run}
    places = {i: m.span() for i, m in enumerate(_WORD.finditer(text)) if i in ends} if runs else {}
    return {
        "n_words": n_words,
        "n_hit": sum(y - x + 1 for x, y in runs),
        "n_items": len(named),
        "item_ids": named,
        "items_sha256": hashlib.sha256(",".join(named).encode()).hexdigest(),
        "spans": [{"start": places[x][0], "end": places[y][1]} for x, y in runs],
    }


def _scanner(items: Broadcast, size: int, text_at: int, hits_at: int, last: bool):
    """Adds the hits of one automaton to those of the blocks before; the last writes the summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared(items, size)
        kind = arrow_type(SUMMARY if last else HITS)
        for b in batches:
            out = []
            for text, before in zip(b.column(text_at), b.column(hits_at).to_pylist(), strict=True):
                text = text.as_py() or ""
                w = words(text)
                runs, ids = scan(a, w)
                if before:
                    runs = covered(sorted([*runs, *((r["first"], r["last"]) for r in before["runs"])], key=lambda r: (r[1], r[0])))
                    ids |= set(before["items"])
                if last:
                    out.append(summary(text, len(w), runs, ids))
                else:
                    out.append({"runs": [{"first": x, "last": y} for x, y in runs], "items": list(ids)})
            yield b.set_column(hits_at, b.schema.field(hits_at).name, pa.array(out, kind))

    return spared(run)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "overlap",
    window: int = 10,
    max_block_bytes: int = 4 << 20,
) -> DataFrame:
    """``docs`` with one more column, a struct: n_words, n_hit, n_items, item_ids,
    items_sha256 and spans (code-point offsets in the original text)."""
    spark = docs.sparkSession
    out = free_name(docs, out)
    items = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size * window / max_block_bytes))
    block = F.pmod(F.xxhash64("t"), F.lit(blocks))
    at = (docs.columns.index(text), len(docs.columns))
    found = docs.withColumn(out, F.lit(None).cast(HITS))
    result = T.StructType([*docs.schema.fields, T.StructField(out, SUMMARY)])
    made: list[str] = []
    for k in range(blocks):
        part = items if blocks == 1 else items.where(block == k)
        values = spark.sparkContext.broadcast([(r.i, r.t) for r in part.collect()])
        if k == blocks - 1:
            return found.mapInArrow(_scanner(values, window, *at, True), result)
        done = made
        made = []
        found = materialise(found.mapInArrow(_scanner(values, window, *at, False), found.schema), made)
        values.destroy()
        drop(spark, done)
