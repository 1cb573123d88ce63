"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, anything but letters becomes a space and runs of
spaces one; n-grams of 1 to 3 characters are hashed into ``2**bits`` buckets.
The model is a matrix of log-probabilities, buckets by languages, whose last row
are the languages' priors. It is broadcast (2**bits * languages * 4 bytes: 1 MB
for four languages); the texts of a batch are a sparse matrix of buckets by
texts, and their scores are its product with the model, row sums of gathered
rows. The score is the posterior probability of the language.

Training counts run on Spark over at most ``max_train`` labelled documents, the
ones with the smallest hash of their id: that bound is the parameter to raise.
N-grams count with 0.1 more than they occur, and priors with 1 more.

Defined results: a null text, or one without letters, is ``und`` with score 0;
ties go to the language first in order; rows without language or id teach
nothing; without any training rows every text is ``und``; an empty table gives
an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.llm.common import free_name, held_out, spared

CHARS = 1 << 16  # texts are read together up to so many characters, longer ones in stretches
ORDERS = (1, 2, 3)


@lru_cache(1)
def letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(text: str) -> np.ndarray:
    """Code points, framed by spaces; empty if there is no letter."""
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    space = c == 32
    c = c[~(space & np.concatenate([[False], space[:-1]]))]
    return c if len(c) > 1 else c[:0]


def buckets(c: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of all n-grams of normalised code points."""
    out = []
    for n in ORDERS:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h + c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(64 - bits - 8)) & np.uint64((1 << bits) - 1))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def stretches(text: str) -> Iterator[str]:
    for i in range(0, len(text), CHARS):
        yield text[i : i + CHARS]


def together(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, texts) of about CHARS characters; a long text comes in stretches."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in stretches(text or ""):
            if parts and size + len(part) > CHARS:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, parts


def sparse(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order of n-grams (buckets, which text, ascending); texts are framed by spaces."""
    c = letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (of[1:] == of[:-1]))
    keep &= (np.bincount(of[~space], minlength=len(texts)) > 0)[of]
    c, of = c[keep].astype(np.uint64), of[keep]
    for n in ORDERS:
        if len(c) < n:
            return
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h + c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = of[: len(of) - n + 1] == of[n - 1 :]
        yield ((h[inside] >> np.uint64(64 - bits - 8)) & np.uint64((1 << bits) - 1)).astype(np.int32), of[: len(of) - n + 1][inside]


def _counter(languages: list[str], bits: int):
    """Counts by (language, bucket); bucket -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), (1 << bits) + 1), np.int64)
        number = {x: i for i, x in enumerate(languages)}
        for b in batches:
            langs = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            total[:, -1] += np.bincount(langs, minlength=len(languages))
            for rows, parts in together(b.column(1).to_pylist()):
                own = langs[np.array(rows)] * total.shape[1]
                for found, of in sparse(parts, bits):
                    np.add.at(total.reshape(-1), own[of] + found, 1)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])],
            names=["lang", "bucket", "n"],
        )

    return spared(count)


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = 16, max_train: int = 8192
) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities) from rows that aren't held out."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    chosen = known.select("id").orderBy(F.xxhash64("id"), "id").limit(max_train).distinct()
    sample = known.join(F.broadcast(chosen), "id").select("lang", "text")  # at most max_train ids
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    counts = sample.mapInArrow(_counter(languages, bits), "lang int, bucket int, n long")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages * (2**bits + 1) rows at most
    total = np.full(((1 << bits) + 1, max(1, len(languages))), 0.1)
    total[-1] = 1.0
    total[got["bucket"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
    logp = np.concatenate([np.log(total[:-1] / total[:-1].sum(axis=0)), np.log(total[-1:] / total[-1].sum())])
    return languages, logp.astype(np.float32)


def classify(texts: list[str | None], logp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(language numbers, scores) of texts; -1 and 0 where there is no letter."""
    total, any_ = np.zeros((len(texts), logp.shape[1])), np.zeros(len(texts), bool)
    for rows, parts in together(texts):
        for found, of in sparse(parts, bits):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            if len(first):
                own = np.array(rows)[of[first]]
                np.add.at(total, own, np.add.reduceat(logp[found], first, axis=0, dtype=np.float64))
                any_[own] = True
    total += logp[-1]
    best = total.argmax(axis=1) if len(texts) else np.empty(0, np.int64)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if len(texts) else np.empty(0)
    return np.where(any_, best, -1), np.where(any_, score, 0.0)


def _classifier(languages: list[str], model, bits: int, text_at: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*languages, "und"], pa.string())
        for b in batches:
            lang, score = classify(b.column(text_at).to_pylist(), model.value, bits)
            if not languages:
                lang, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            cols = [names.take(pa.array(np.where(lang < 0, len(languages), lang))), pa.array(score, pa.float64())]
            found = pa.StructArray.from_arrays(cols, names=["lang", "score"])
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, out])

    return spared(run)


FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(
    docs: DataFrame, languages: list[str], logp: np.ndarray, text: str = "text", out: str = "language", bits: int = 16
) -> DataFrame:
    """``docs`` with a struct ``out``: lang and score (0 to 1)."""
    out = free_name(docs, out)
    model = docs.sparkSession.sparkContext.broadcast(logp)
    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields]
    kind = T.StructType([*fields, T.StructField(out, FOUND)])
    return docs.mapInArrow(_classifier(languages, model, bits, docs.columns.index(text), out), kind)
