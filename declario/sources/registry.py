"""Formats by name: what reads a path to JSON text, and what writes it."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declario.functions import strings
from declario.operators import triples
from declario.plans import compile as plans
from declario.plans.mapping import Mapping, Mappings
from declario.sources import documents


@dataclass(frozen=True)
class Format:
    """``read``: (spark, path) to (path, doc_idx, json). ``write``: a frame with a
    column ``json`` to the same with text of the format."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    write: Callable[[DataFrame], DataFrame]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "")
    good = rows.where(F.try_parse_json("value").isNotNull())
    return good.select(F.col("_metadata.file_path").alias("path"), F.lit(0).alias("doc_idx"), F.col("value").alias("json"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("t"))
    docs = F.when(F.startswith("t", F.lit("[")), F.transform(F.from_json("t", "array<variant>"), lambda v: F.to_json(v))).otherwise(F.array("t"))
    return files.select("path", F.posexplode(docs).alias("doc_idx", "json"))


FORMATS: dict[str, Format] = {
    "json": Format("json", _whole, lambda df: df),
    "jsonl": Format("jsonl", _lines, lambda df: df),
    **{f: Format(f, lambda s, p, f=f: documents.read(s, p, f), lambda df, f=f: documents.write_text(df, f)) for f in documents.PARSERS},
}
_scoped: list[dict[str, Format]] = []


def _turtle(spark: SparkSession, path: str) -> DataFrame:
    """Subjects as JSON objects: ``@id``, and their predicates' least objects."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = triples.read_turtle(files, "value", ("path",))
    members = rows.groupBy("path", "s", "p").agg(F.min("o").alias("o")).groupBy("path", "s")
    return members.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("m")).select(
        "path", F.lit(0).alias("doc_idx"), F.to_json(F.map_concat(F.create_map(F.lit("@id"), F.col("s")), F.col("m"))).alias("json")
    )


FORMATS["turtle"] = Format("turtle", _turtle, lambda df: df)


def from_hash(spark: SparkSession, rows: list[dict], mapping: Mapping) -> DataFrame:
    """Dicts of this process as rows of the model, by the mapping's names."""
    texts = spark.createDataFrame([(documents.to_text(r),) for r in rows], "value string")
    return plans.read_frame(texts, mapping)


def to_hash(df: DataFrame, mapping: Mapping) -> Iterator[dict]:
    """Rows of the model as dicts, fetched part by part."""
    return (json.loads(r.value) for r in plans.write_frame(df, mapping, "hash").toLocalIterator())


#: File endings and the formats they stand for.
ENDINGS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "ttl": "turtle", "jsonld": "jsonld", "yamlld": "yamlld"}


def detect(path: str) -> str:
    """A path's format, by its ending."""
    ending = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ending not in ENDINGS:
        raise KeyError(f"no format is known for .{ending}; there are {', '.join(sorted(ENDINGS))}")
    return ENDINGS[ending]


def register(f: Format) -> None:
    FORMATS[f.name] = f


@contextlib.contextmanager
def scoped(f: Format) -> Iterator[None]:
    """Another reader or writer for a format while a block runs."""
    _scoped.append({f.name: f})
    try:
        yield
    finally:
        _scoped.pop()


def find(name: str) -> Format:
    """The innermost scope's format, else the registered one; else the nearest names."""
    for scope in reversed(_scoped):
        if name in scope:
            return scope[name]
    if name in FORMATS:
        return FORMATS[name]
    raise KeyError(f"no format {name}; there are {', '.join(sorted(FORMATS))}")


def suggest(spark: SparkSession, word: str, names: list[str]) -> str | None:
    """The nearest of some names, if near enough."""
    rows = spark.createDataFrame([(n,) for n in names], "name string").where(strings.close_enough(F.lit(word), F.col("name")))
    best = rows.orderBy(strings.edit_distance(F.lit(word), F.col("name")), "name").first()
    return best.name if best else None


def read(spark: SparkSession, path: str, fmt: str, mappings: Mappings) -> DataFrame:
    """Documents of a path as rows of the model, with path and doc_idx."""
    return plans.read_frame(find(fmt).read(spark, path), mappings.of(fmt), "json", ("path", "doc_idx"), fmt)


def write(df: DataFrame, fmt: str, mappings: Mappings, *keep: str) -> DataFrame:
    """Rows of the model as documents, column ``json`` in the format's text."""
    return find(fmt).write(plans.write_frame(df, mappings.of(fmt), fmt, "json", keep))
