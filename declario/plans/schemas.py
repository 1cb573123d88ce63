"""Schemas out of models, and models out of schemas.

Only what a model needs to be read and written: JSON Schema and XSD both ways,
YAML Schema out. Types other than string, integer, boolean, float and hash are
"string" in JSON Schema. XSD of a union is refused. Recursive types are refused too.
"""

from __future__ import annotations

import json
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declario.plans.model import Attribute, Choice, Model, Reference

#: Names of types in JSON Schema and in XSD.
JSON_NAMES = {"string": "string", "integer": "integer", "boolean": "boolean", "float": "number", "double": "number", "hash": "object"}
XSD_NAMES = {
    "string": "string",
    "integer": "integer",
    "float": "float",
    "double": "double",
    "decimal": "decimal",
    "boolean": "boolean",
    "date": "date",
    "date_time": "dateTime",
    "time": "dateTime",
    "time_without_date": "time",
    "duration": "duration",
    "uri": "anyURI",
    "qname": "QName",
    "base64_binary": "base64Binary",
    "hex_binary": "hexBinary",
    "hash": "anyType",
    "symbol": "string",
    "reference": "string",
}
XS = "{http://www.w3.org/2001/XMLSchema}"


def _models(model: Model, found: dict[str, Model]) -> dict[str, Model]:
    found[model.name] = model
    for a in model.attributes:
        if isinstance(a.type, Model) and a.type.name not in found:
            _models(a.type, found)
    return found


def _json_type(a: Attribute) -> dict:
    if isinstance(a.type, Model):
        one = {"$ref": f"#/$defs/{a.type.name}"}
    elif isinstance(a.type, list):
        one = {"anyOf": [{"type": JSON_NAMES.get(c, "string")} for c in a.type]}
    else:
        code = "string" if isinstance(a.type, Reference) else a.type
        one = {"type": JSON_NAMES.get(code, "string")}
        if not a.required and not a.collection:
            one = {"type": [one["type"], "null"]}
        if a.values:
            one["enum"] = list(a.values)
        if a.pattern:
            one["pattern"] = a.pattern
        if a.default is not None and not callable(a.default):
            one["default"] = a.default
    if not a.collection:
        return one
    out = {"type": "array", "items": one}
    if isinstance(a.collection, tuple):
        out["minItems"] = a.collection[0]
        if a.collection[1] is not None:
            out["maxItems"] = a.collection[1]
    return out


def json_schema(model: Model) -> dict:
    defs = {}
    for name, m in _models(model, {}).items():
        own = {"type": "object", "additionalProperties": False, "properties": {a.name: _json_type(a) for a in m.attributes}}
        if needed := [a.name for a in m.attributes if a.required]:
            own["required"] = needed
        for c in m.choices:  # how many are allowed can't be said by keywords, so the bounds go along as well
            own.setdefault("allOf", []).append({"oneOf" if c.high == 1 else "anyOf": [{"required": [n]} for n in c.names], "minChoice": c.low, "maxChoice": c.high})
        defs[name] = own
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$ref": f"#/$defs/{model.name}", "$defs": defs}


def yaml_schema(model: Model) -> str:
    import yaml

    return yaml.safe_dump(json_schema(model), sort_keys=False)


def from_json_schema(schema: dict | str) -> Model:
    """The model of a JSON Schema of the kind json_schema() writes."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    back = {v: k for k, v in reversed(JSON_NAMES.items())}
    back["number"] = "float"

    def build(name: str, above: tuple[str, ...] = ()) -> Model:
        if name in above:
            raise ValueError(f"{name} contains itself")
        d = schema["$defs"][name]
        out = []
        for key, p in d.get("properties", {}).items():
            many, one = p.get("type") == "array", p["items"] if p.get("type") == "array" else p
            if "$ref" in one:
                kind = build(one["$ref"].rsplit("/", 1)[1], (*above, name))
            elif "anyOf" in one:
                kind = [back[x["type"]] for x in one["anyOf"]]
            else:
                names = one.get("type", "string")
                kind = back[names if isinstance(names, str) else next(n for n in names if n != "null")]
            size = (p["minItems"], p.get("maxItems")) if "minItems" in p else True
            out.append(
                Attribute(key, kind, size if many else False, one.get("default"), tuple(one.get("enum", ())), one.get("pattern"), key in d.get("required", ()))
            )
        parts = [*d.get("allOf", ()), *([d] if "oneOf" in d else [])]
        choices = [(tuple(x["required"][0] for x in c.get("oneOf") or c.get("anyOf") or ()), c) for c in parts]
        return Model(name, tuple(out), tuple(Choice(names, c.get("minChoice", 1), c.get("maxChoice", 1)) for names, c in choices if names))

    return build(schema["$ref"].rsplit("/", 1)[1])


def xsd(model: Model) -> str:
    ET.register_namespace("xs", XS[1:-1])
    root = ET.Element(f"{XS}schema")
    ET.SubElement(root, f"{XS}element", name=model.root or model.name, type=model.name)
    for name, m in _models(model, {}).items():
        seq = ET.SubElement(ET.SubElement(root, f"{XS}complexType", name=name), f"{XS}sequence")
        chosen: dict[str, ET.Element] = {}
        for c in m.choices:
            box = ET.Element(f"{XS}choice", minOccurs=str(c.low), maxOccurs=str(c.high))
            chosen |= dict.fromkeys(c.names, box)
        for a in m.attributes:
            if a.name in chosen and chosen[a.name] not in list(seq):
                seq.append(chosen[a.name])  # where its first attribute stands
            if isinstance(a.type, list):
                raise ValueError(f"{a.name}: a union has no XSD")
            low, high = a.collection if isinstance(a.collection, tuple) else (int(a.required), None if a.collection else 1)
            kind = a.type.name if isinstance(a.type, Model) else f"xs:{XSD_NAMES['string' if isinstance(a.type, Reference) else a.type]}"
            e = ET.SubElement(chosen.get(a.name, seq), f"{XS}element", name=a.name, minOccurs=str(low), maxOccurs="unbounded" if high is None else str(high))
            if a.values or a.pattern:
                r = ET.SubElement(ET.SubElement(e, f"{XS}simpleType"), f"{XS}restriction", base=kind)
                for v in a.values:
                    ET.SubElement(r, f"{XS}enumeration", value=str(v))
                if a.pattern:
                    ET.SubElement(r, f"{XS}pattern", value=a.pattern)
            else:
                e.set("type", kind)
    root.set("xmlns:xs", XS[1:-1]) if "xs:" not in ET.tostring(root, "unicode") else None
    ET.indent(root)
    return ET.tostring(root, "unicode")


def from_xsd(text: str, included: dict[str, str] | None = None) -> Model:
    """The model of an XSD: named complex types with sequences, choices, attributes
    and extensions, and named simple types that restrict another.

    ``included``: the texts of schemas that it includes or imports, by location.
    """
    back = {}
    for code, name in XSD_NAMES.items():
        back.setdefault(name, code)
    root = ET.fromstring(text)
    tops, seen = [root], set()
    for r in tops:  # grows as further schemas are named
        for e in [*r.findall(f"{XS}include"), *r.findall(f"{XS}import")]:
            at = e.get("schemaLocation")
            if at and at not in seen:
                seen.add(at)
                if at not in (included or {}):
                    raise KeyError(f"the schema includes {at}, which isn't given")
                tops.append(ET.fromstring(included[at]))
    types = {t.get("name"): t for r in tops for t in r.findall(f"{XS}complexType")}
    simple = {t.get("name"): t for r in tops for t in r.findall(f"{XS}simpleType")}
    local = lambda name: name.rsplit(":", 1)[-1]

    def restricted(name: str, r: ET.Element | None) -> tuple[str, tuple, str | None]:
        """(base type, values, pattern) of a simple type, through named ones."""
        values = () if r is None else tuple(v.get("value") for v in r.findall(f"{XS}enumeration"))
        found = None if r is None or r.find(f"{XS}pattern") is None else r.find(f"{XS}pattern").get("value")
        if name in simple and name not in types:
            inner = simple[name].find(f"{XS}restriction")
            base, more, pattern = restricted(local(inner.get("base")), inner)
            return base, values or more, found or pattern
        return name, values, found

    def build(name: str, above: tuple[str, ...] = (), shown: str | None = None) -> Model:
        if name in above:
            raise ValueError(f"{name} contains itself")
        t, out, choices = types[name], [], []
        if (base := t.find(f"{XS}complexContent/{XS}extension")) is not None:
            parent = build(local(base.get("base")), (*above, name))
            out, choices = list(parent.attributes), list(parent.choices)
        if (base := t.find(f"{XS}simpleContent/{XS}extension")) is not None:
            kind, values, found = restricted(local(base.get("base")), None)
            out.append(Attribute("content", back.get(kind, "string"), values=values, pattern=found))
        for c in t.iterfind(f".//{XS}choice"):
            choices.append(Choice(tuple(e.get("name") for e in c.findall(f"{XS}element")), int(c.get("minOccurs", "1")), int(c.get("maxOccurs", "1"))))
        for e in t.iterfind(f".//{XS}element"):
            low, high = int(e.get("minOccurs", "1")), e.get("maxOccurs", "1")
            many = high != "1"
            r = e.find(f"{XS}simpleType/{XS}restriction")
            kind, values, found = restricted(local(e.get("type") if r is None else r.get("base")), r)
            of = build(kind, (*above, name)) if kind in types else back.get(kind, "string")
            size = (True if not low and high == "unbounded" else (low, None if high == "unbounded" else int(high))) if many else False
            in_choice = any(e.get("name") in c.names for c in choices)
            out.append(Attribute(e.get("name"), of, size, None, values, found, low > 0 and not many and not in_choice))
        for x in t.iterfind(f".//{XS}attribute"):
            kind, values, found = restricted(local(x.get("type", "xs:string")), x.find(f"{XS}simpleType/{XS}restriction"))
            out.append(Attribute(x.get("name"), back.get(kind, "string"), False, x.get("default"), values, found, x.get("use") == "required"))
        return Model(name, tuple(out), tuple(choices), root=shown)

    top = root.find(f"{XS}element")
    kind = local(top.get("type"))
    return build(kind, (), top.get("name") if top.get("name") != kind else None)


def unfit(text: str) -> list[str]:
    """What keeps an XSD from being read: another root, or features of version 1.1."""
    root = ET.fromstring(text)
    out = [] if root.tag == f"{XS}schema" else [f"the root is {root.tag}, not an XSD schema"]
    newer = {"assert", "assertion", "alternative", "override", "openContent", "defaultOpenContent"}  # fixed value: elements of XSD 1.1
    return out + sorted({f"{e.tag[len(XS) :]} needs XSD 1.1" for e in root.iter() if isinstance(e.tag, str) and e.tag.startswith(XS) and e.tag[len(XS) :] in newer})


def sorted_components(found: DataFrame, kind: str) -> DataFrame:
    """The components of a kind by name."""
    return found.where(F.col("kind") == kind).orderBy("name", "file")


COMPONENTS = ["element", "complexType", "simpleType", "attribute", "attributeGroup", "group", "notation", "import", "include"]


def components(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(file, kind, name, type, target_namespace): top-level components of XSD texts.

    Read with the XML functions of the JVM; one row per component.
    """
    part = "array<struct<_name: string, _type: string, _namespace: string, _schemaLocation: string>>"
    schema = "struct<_targetNamespace: string, " + ", ".join(f"{c}: {part}" for c in COMPONENTS) + ">"
    doc = F.from_xml(text, schema, {"ignoreNamespace": "true"})
    empty = F.array().cast("array<struct<kind: string, name: string, type: string>>")

    def one(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), F.coalesce(x["_name"], x["_namespace"], x["_schemaLocation"]).alias("name"), x["_type"].alias("type"))

    rows = [F.coalesce(F.transform(F.col(f"d.{c}"), one(c)), empty) for c in COMPONENTS]
    out = files.select(F.col(path).alias("file"), doc.alias("d"))
    out = out.select("file", F.col("d._targetNamespace").alias("target_namespace"), F.explode(F.concat(*rows)).alias("c"))
    return out.select("file", "c.kind", "c.name", "c.type", "target_namespace")


def find_type(found: DataFrame, name: str) -> DataFrame:
    """Simple types before complex ones."""
    rows = found.where((F.col("name") == name) & F.col("kind").isin("simpleType", "complexType"))
    return rows.orderBy(F.col("kind") != "simpleType", "file").limit(1)


def statistics(found: DataFrame) -> DataFrame:
    """Counts by kind, one row per file."""
    return found.groupBy("file").pivot("kind", COMPONENTS).count().na.fill(0)
