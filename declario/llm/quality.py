"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``WIDTH`` characters that cover its whole
text. A passage is encoded as the square roots of its frequencies of hashed
character pairs and of character classes, the squared mass of the pairs and the
share of characters that come again a few places on (which repetition raises);
h = tanh(x W). Gated attention, a = softmax(w . (tanh(h V) *
sigmoid(h U))), is learned from document labels alone, and the score is the
sigmoid of a linear function of the weighted sum of h.

Labels come from a bounded sample of labelled documents: those with the smallest
hash of their id, ``max_train`` at most, and of these in the same order as many
as have ``max_passages`` passages together (those two bounds are the parameters
to raise). They are encoded whole on Spark; the driver fits a network of a few
thousand weights on all their passages, kept as float16.

Defined results: null and empty texts are one empty passage; a document with
several labels counts once for each; a repeated row teaches once; rows without
id teach nothing; without training rows all scores are 0.5; an empty table gives an empty result.
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

WIDTH = 400
PAIRS = 256
CLASSES = 24
LAGS = range(2, 13)
SIZE = PAIRS + CLASSES + len(LAGS) + 2
BATCH = 2000  # passages encoded together


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of a character: letters by case, digits, spaces, each common mark of its own."""
    marks = ".,;:!?'\"()-*#$%&|@=+/"
    out = np.full(0x3000, 1, np.int64)
    for c in range(0x3000):
        s = chr(c)
        out[c] = 0 if s.islower() else 2 if s.isupper() else 3 if s.isdigit() else 4 if s.isspace() else 1
        if s in marks:
            out[c] = 5 + marks.index(s) % (CLASSES - 5)
    return out


def passages(text: str | None) -> np.ndarray:
    """Code points in rows of WIDTH, the last filled with 0; an empty text is one row."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = max(1, -(-len(c) // WIDTH))
    out = np.zeros(rows * WIDTH, np.uint32)
    out[: len(c)] = c
    return out.reshape(rows, WIDTH)


def encode(rows: np.ndarray) -> np.ndarray:
    """Features of passages, one float32 row each."""
    n = len(rows)
    at = np.arange(n)[:, None]
    live = rows > 0
    kind = classes()[np.minimum(rows, 0x2FFF)]
    by_class = np.bincount((at * CLASSES + kind)[live], minlength=n * CLASSES).reshape(n, CLASSES)
    pair = rows[:, :-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows[:, 1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair = (pair >> np.uint64(40)).astype(np.int64) % PAIRS
    by_pair = np.bincount((at * PAIRS + pair)[live[:, 1:]], minlength=n * PAIRS).reshape(n, PAIRS)
    size = np.maximum(live.sum(axis=1, keepdims=True), 1)
    x = np.empty((n, SIZE), np.float32)
    x[:, :PAIRS] = np.sqrt(by_pair / size)
    x[:, PAIRS : PAIRS + CLASSES] = np.sqrt(by_class / size)
    for i, lag in enumerate(LAGS):  # words said twice
        x[:, PAIRS + CLASSES + i] = ((rows[:, lag:] == rows[:, :-lag]) & live[:, lag:]).sum(axis=1) / size[:, 0]
    x[:, -2] = np.sqrt(((by_pair / size) ** 2).sum(axis=1))
    x[:, -1] = np.minimum(1.0, size[:, 0] / WIDTH)
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Gated attention over the passages of a document."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(SIZE), np.ones(SIZE)
        self.p = {"W": draw(SIZE, hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """``first``: of each bag, its first row."""
        p = self.p
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        x = (x - self.mean) / self.scale  # float16 becomes float64 here, batch by batch
        h = np.tanh(x @ p["W"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * a[:, None], first)
        return {"x": x, "bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["b"])}

    def gradients(self, f: dict, first: np.ndarray, want: np.ndarray) -> dict:
        p, bag, h, a = self.p, f["bag"], f["h"], f["a"]
        d = (f["y"] - want) / len(want)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dz[bag] * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        out = {"W": f["x"].T @ dh, "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}
        return {k: v + 1e-4 * p[k] for k, v in out.items()}

    def fit(self, x: np.ndarray, first: np.ndarray, want: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01) -> Attention:
        if not len(first):
            return self
        self.mean = x.mean(axis=0, dtype=np.float64)
        square = sum((x[k : k + BATCH].astype(np.float64) ** 2).sum(axis=0) for k in range(0, len(x), BATCH)) / len(x)
        self.scale = np.sqrt(np.maximum(square - self.mean**2, 0.0)) + 0.01
        rng, step = np.random.default_rng(7), 0
        last = np.append(first[1:], len(x))
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(first))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                sizes = last[own] - first[own]
                starts = np.cumsum(sizes) - sizes
                rows = np.arange(sizes.sum()) + np.repeat(first[own] - starts, sizes)
                g = self.gradients(self.forward(x[rows], starts), starts, want[own])
                step += 1
                for name, (a, b) in m.items():
                    a += 0.1 * (g[name] - a)
                    b += 0.001 * (g[name] ** 2 - b)
                    self.p[name] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, text: str | None) -> float:
        """Of a whole text; attention is summed up block by block."""
        p, top, total, z = self.p, -np.inf, 0.0, 0.0
        rows = passages(text)
        for k in range(0, len(rows), BATCH):
            h = np.tanh(((encode(rows[k : k + BATCH]) - self.mean) / self.scale) @ p["W"])
            e = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
            most = max(top, float(e.max()))
            w = np.exp(e - most)
            shrink = np.exp(top - most) if top > -np.inf else 0.0
            total, z, top = total * shrink + w.sum(), z * shrink + w @ h, most
        return float(_sigmoid(z / total @ p["c"] + p["b"])[0])


def _encoder():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = encode(passages(b.column(2)[i].as_py())).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([x.tobytes()], pa.binary())], names=["id", "label", "x"]
                )

    return spared(run)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    max_train: int = 3000,
    max_passages: int = 40_000,
) -> Attention:
    """Fitted on labelled rows that aren't held out; at most ``max_train`` documents
    with ``max_passages`` encodings together go to the driver (24 MB at the defaults)."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_train)
    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    own = own.join(F.broadcast(known), "id")  # max_train rows at most
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.length("text"), F.lit(0)) / WIDTH))
    order = ["id", "label", "th"]
    sizes = own.select(*order, size.alias("n")).orderBy(F.xxhash64("id"), *order).limit(max_train).toArrow()
    total, chosen = 0, set()  # whole documents only
    for row in sizes.to_pylist():
        if total + row["n"] <= max_passages:
            total += row["n"]
            chosen.add((row["id"], row["label"], row["th"]))
    keep = docs.sparkSession.createDataFrame(sorted(chosen, key=str), own.select(*order).schema)
    own = own.join(F.broadcast(keep), [own[c].eqNullSafe(keep[c]) for c in order], "left_semi")
    own = own.groupBy(*order).agg(F.first("text").alias("text"))  # a repeated row teaches once
    got = own.select("id", "label", "text").mapInArrow(_encoder(), "id long, label int, x binary")
    rows = sorted(got.toArrow().to_pylist(), key=lambda r: (r["id"], r["label"], r["x"]))
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, SIZE) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64) if bags else np.empty(0, np.int64)
    x = np.concatenate(bags) if bags else np.empty((0, SIZE), np.float16)
    return Attention().fit(x, first, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Attention, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of label 1 as double ``out``."""
    out = free_name(docs, out)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([shared.value.score(x.as_py()) for x in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, out])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema.fields]
    return docs.mapInArrow(spared(run), T.StructType([*fields, T.StructField(out, T.DoubleType())]))
