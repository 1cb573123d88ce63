"""XML mappings: elements, attributes and content of a document as a model's attributes.

A mapping compiles to the row schema that Spark's XML functions read, with every
scalar as text, and to one projection that casts them. Writing builds the same
struct from the model and hands it to to_xml.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.functions import casts
from declario.plans.model import Attribute, Model


@dataclass(frozen=True)
class XmlRule:
    """``kind``: element, attribute, content, or inner (an element's inner XML as text)."""

    kind: str
    name: str
    to: str
    default: str | None = None
    load: Callable[[Column], Column] | None = None
    dump: Callable[[Column], Column] | None = None

    @property
    def column(self) -> str:
        return {"attribute": f"_{self.name}", "content": "_VALUE"}.get(self.kind, self.name)


def element(name: str, to: str, **k) -> XmlRule:
    return XmlRule("element", name, to, **k)


def attribute(name: str, to: str, **k) -> XmlRule:
    return XmlRule("attribute", name, to, **k)


def content(to: str, **k) -> XmlRule:
    return XmlRule("content", "", to, **k)


def inner(name: str, to: str, **k) -> XmlRule:
    return XmlRule("inner", name, to, **k)


@dataclass(frozen=True)
class XmlMapping:
    """``nested``: the mappings of attributes that are models. ``sort``: a collection
    attribute that is kept sorted, which ordered content rules out."""

    model: Model
    root: str
    rules: tuple[XmlRule, ...]
    nested: dict[str, XmlMapping] = field(default_factory=dict)
    ordered: bool = False
    sort: str | None = None

    def __post_init__(self):
        if self.ordered and self.sort:
            raise ValueError(f"{self.model.name} keeps the order of its content and can't sort {self.sort}")
        known = {a.name for a in self.model.attributes}
        for r in self.rules:
            if r.to not in known:
                raise KeyError(f"{self.model.name} has no attribute {r.to}")

    def schema(self) -> T.StructType:
        fields = []
        for r in self.rules:
            one = self.nested[r.to].schema() if r.to in self.nested else T.StringType()
            fields.append(T.StructField(r.column, T.ArrayType(one) if self.model[r.to].collection and r.kind in ("element", "inner") else one))
        return T.StructType(fields)


def _reader(r: XmlRule, a: Attribute, mapping: XmlMapping) -> Callable[[Column], Column]:
    if r.to in mapping.nested:
        return lambda x: F.when(x.isNotNull(), _typed(x, mapping.nested[r.to]))
    return lambda x: casts.cast(a.type if isinstance(a.type, str) else "string", r.load(x) if r.load else x)


def _writer(r: XmlRule, a: Attribute, mapping: XmlMapping) -> Callable[[Column], Column]:
    if r.to in mapping.nested:
        return lambda x: F.when(x.isNotNull(), _raw(x, mapping.nested[r.to]))
    return lambda x: casts.serialize(a.type, r.dump(x) if r.dump else x, "xml")


def _typed(row: Column, mapping: XmlMapping) -> Column:
    out = []
    for r in mapping.rules:
        a, raw = mapping.model[r.to], row[r.column]
        one = _reader(r, a, mapping)
        value = F.transform(raw, one) if a.collection else one(raw)
        out.append((F.coalesce(value, F.lit(r.default).cast(a.spark_type())) if r.default is not None else value).alias(r.to))
    return F.struct(*out)


def read(text: Column, mapping: XmlMapping, namespaces: bool = False) -> Column:
    """A struct of the model from a document; null where there is none."""
    row = F.from_xml(text, mapping.schema(), {"ignoreNamespace": str(not namespaces).lower()})
    found = F.get(F.transform(F.array(row), lambda x: _typed(x, mapping)), F.lit(0))
    return F.when(F.trim(text) != "", found)


def _raw(row: Column, mapping: XmlMapping) -> Column:
    out = []
    for r in mapping.rules:
        a, value = mapping.model[r.to], row[r.to]
        one = _writer(r, a, mapping)
        out.append((F.transform(value, one) if a.collection else one(value)).alias(r.column))
    return F.struct(*out)


def write(row: Column, mapping: XmlMapping) -> Column:
    """The document of a model struct; null attributes are left out."""
    return F.to_xml(_raw(row, mapping), {"rowTag": mapping.root, "indent": ""})


def read_frame(df: DataFrame, mapping: XmlMapping, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, read(F.col(column), mapping).alias("_m")).select(*keep, "_m.*")


def write_frame(df: DataFrame, mapping: XmlMapping, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    names = [r.to for r in mapping.rules]
    return df.select(*keep, write(F.struct(*(F.col(n) for n in names)), mapping).alias(column))


def instructions(text: Column, name: str) -> Column:
    """The contents of all processing instructions of a name."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)<\?{re.escape(name)}\s+(.*?)\s*\?>"), F.lit(1))


NODES = "array<struct<path: string, kind: string, name: string, text: string>>"


def _events(text: str) -> Iterator[dict]:
    """Elements, attributes and texts in document order, with the path of what holds them."""

    def walk(e: ElementTree.Element, path: str) -> Iterator[dict]:
        name = e.tag.rpartition("}")[2]
        own = f"{path}/{name}"
        yield {"path": path or "/", "kind": "element", "name": name, "text": None}
        for k, v in e.attrib.items():
            yield {"path": own, "kind": "attribute", "name": k.rpartition("}")[2], "text": v}
        if e.text:
            yield {"path": own, "kind": "text", "name": None, "text": e.text}
        for child in e:
            yield from walk(child, own)
            if child.tail:
                yield {"path": own, "kind": "text", "name": None, "text": child.tail}

    yield from walk(ElementTree.fromstring(text), "")


def nodes(df: DataFrame, column: str = "value", out: str = "nodes") -> DataFrame:
    """``df`` with mixed content in order: an array of elements, attributes and texts.

    Listeners are filters of it: the events of an element or attribute name. Null
    for a text that isn't well formed.
    """
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(f"n {NODES}").fields])
    schema = T.StructType([*schema.fields[:-1], T.StructField(out, schema.fields[-1].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("path", "kind", "name", "text")]))
        for b in batches:
            found = []
            for text in b.column(at).to_pylist():
                try:
                    found.append(list(_events(text)) if text else None)
                except ElementTree.ParseError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def heard(df: DataFrame, kind: str, name: str, nodes_: str = "nodes", keep: tuple[str, ...] = ()) -> DataFrame:
    """What a listener for an element or attribute hears, in order: (keep, pos, path, text)."""
    each = df.select(*keep, F.posexplode(nodes_).alias("pos", "n"))
    return each.where((F.col("n.kind") == kind) & (F.col("n.name") == name)).select(*keep, "pos", "n.path", "n.text")
