"""YAML, YAML streams, TOML and XML as JSON texts, one row per document.

Rows are (path, doc_idx, json): documents as JSON text, so that mappings read
them as they read JSON. Files are dealt to tasks; a file is one document or one
stream and is parsed by the task that has it.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _plain(x):
    """Values that JSON has no type for, as text."""
    if isinstance(x, (datetime.datetime, datetime.date, datetime.time)):
        return x.isoformat()
    if isinstance(x, (set, bytes)):
        return sorted(map(str, x)) if isinstance(x, set) else x.decode("utf-8", "replace")
    return str(x)


def _keys(x):
    if isinstance(x, dict):
        return {("null" if k is None else str(k).lower() if isinstance(k, bool) else str(k)): _keys(v) for k, v in x.items()}
    return [_keys(v) for v in x] if isinstance(x, list) else x


def to_text(x) -> str:
    return json.dumps(_keys(x), default=_plain, ensure_ascii=False)


def _yaml(kind: str):
    """PyYAML's safe loader or dumper, in C where it was built with libyaml."""
    import yaml

    return getattr(yaml, f"CSafe{kind}", None) or getattr(yaml, f"Safe{kind}")


def parse_yaml(text: str) -> Iterator[str]:
    import yaml

    yield to_text(yaml.load(text, _yaml("Loader")))


def parse_yaml_stream(text: str) -> Iterator[str]:
    """Every document; after a syntax error the pieces between --- lines, bad ones skipped."""
    import yaml

    try:
        yield from [to_text(d) for d in yaml.load_all(text, _yaml("Loader"))]
    except yaml.YAMLError:
        for piece in re.split(r"(?m)^---\s*$", text):
            if piece.strip():
                try:
                    yield to_text(yaml.load(piece, _yaml("Loader")))
                except yaml.YAMLError:
                    continue


def parse_toml(text: str) -> Iterator[str]:
    import tomllib

    yield to_text(tomllib.load(BytesIO(text.encode())))


def parse_xml(text: str) -> Iterator[str]:
    """The root's name to its members: attributes as ``@name``, text as ``#text``,
    elements that come again as arrays, elements of text alone as that text."""
    from xml.etree import ElementTree

    def value(e):
        out = {f"@{k.rpartition('}')[2]}": v for k, v in e.attrib.items()}
        for child in e:
            name = child.tag.rpartition("}")[2]
            own = value(child)
            if name in out:
                out[name] = [*out[name], own] if isinstance(out[name], list) else [out[name], own]
            else:
                out[name] = own
        body = (e.text or "").strip()
        if not out:
            return body
        return out | ({"#text": body} if body else {})

    root = ElementTree.fromstring(text)
    yield to_text({root.tag.rpartition("}")[2]: value(root)})


def parse_graph(text: str) -> Iterator[str]:
    """The nodes of a JSON-LD or YAML-LD document, without its context."""
    import yaml

    doc = yaml.load(text, _yaml("Loader"))
    for node in doc.get("@graph", [doc]) if isinstance(doc, dict) else doc or []:
        yield to_text({k: v for k, v in node.items() if k != "@context"})


PARSERS = {"yaml": parse_yaml, "yamls": parse_yaml_stream, "toml": parse_toml, "xml": parse_xml, "jsonld": parse_graph, "yamlld": parse_graph}


def parse(df: DataFrame, fmt: str, column: str = "value", path: str = "path") -> DataFrame:
    """(path, doc_idx, json) from texts of a format."""
    parser = PARSERS[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, d) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, d in enumerate(parser(t or ""))]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "doc_idx", "json"])

    return df.select(F.col(path).cast("string"), column).mapInArrow(run, "path string, doc_idx int, json string")


def read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse(files, fmt)


def toml_value(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, list):
        return "[" + ", ".join(toml_value(v) for v in x if v is not None) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{json.dumps(k)} = {toml_value(v)}" for k, v in x.items() if v is not None) + "}"
    return json.dumps(x, ensure_ascii=False).replace("\x7f", "\\u007f")


def xml_of(name: str, x) -> str:
    """An element; ``@`` members are attributes and ``#text`` its text. Nulls go."""
    from xml.sax.saxutils import escape, quoteattr

    if isinstance(x, list):
        return "".join(xml_of(name, v) for v in x if v is not None)
    if not isinstance(x, dict):
        return f"<{name}>{escape(str(x).lower() if isinstance(x, bool) else str(x))}</{name}>"
    attributes = "".join(f" {k[1:]}={quoteattr(str(v))}" for k, v in x.items() if k.startswith("@") and v is not None)
    body = escape(str(x.get("#text", ""))) + "".join(xml_of(k, v) for k, v in x.items() if not k.startswith(("@", "#")) and v is not None)
    return f"<{name}{attributes}>{body}</{name}>"


def render(text: str, fmt: str) -> str:
    """One JSON document as text of a format. TOML has no null: such keys go."""
    import yaml

    doc = json.loads(text)
    if fmt == "xml":
        return "".join(xml_of(k, v) for k, v in doc.items() if v is not None)
    if fmt == "jsonld":
        return text
    if fmt == "toml":
        return "".join(f"{json.dumps(k)} = {toml_value(v)}\n" for k, v in doc.items() if v is not None)
    return yaml.dump(doc, Dumper=_yaml("Dumper"), allow_unicode=True, sort_keys=False, explicit_start=fmt == "yamls")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores. Formats cost far more for each row than
    reading it: a table of few megabytes is one input partition, so one core's work."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def write_text(df: DataFrame, fmt: str, column: str = "json") -> DataFrame:
    """``df`` with JSON documents in ``column`` written in a format."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else render(x, fmt) for x in b.column(at).to_pylist()]
            yield b.set_column(at, column, pa.array(texts, pa.string()))

    return dealt(df).mapInArrow(run, df.schema)


def stream(df: DataFrame, ord_: list[str], column: str = "json", *by: str) -> DataFrame:
    """YAML documents of a group joined to one stream, in order."""
    text = write_text(df, "yamls", column)
    listed = F.array_sort(F.collect_list(F.struct(*ord_, column)))
    return text.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x[column]), "").alias("value"))
