import json

import pytest
from pyspark.sql import functions as F

from declario.plans import compile as plans
from declario.plans import schemas
from declario.plans.mapping import Mapping, Mappings, field_
from declario.plans.model import Attribute, Choice, Model, Register
from declario.plans.transform import ModelMap, Move, reverse, transform
from declario.sources import documents, registry, text

ADDRESS = Model("Address", (Attribute("street"), Attribute("city")))
PERSON = Model("Person", (Attribute("name", required=True), Attribute("age", "integer", default=18), Attribute("tags", collection=(0, 3)), Attribute("address", ADDRESS)))


def read(spark, docs, mapping):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, value string")
    return [r.asDict(True) for r in plans.read_frame(rows, mapping, keep=("i",)).orderBy("i").drop("i").collect()]


def write(spark, rows, schema, mapping):
    return [r.value for r in plans.write_frame(spark.createDataFrame(rows, schema).coalesce(1), mapping).collect()]


def test_read_defaults_and_nesting(spark):
    got = read(spark, ['{"name": "A", "tags": ["x", "y"], "address": {"street": "S"}}', '{"name": null, "age": null, "tags": []}', "no json"], Mapping(PERSON))
    assert got[0] == {"name": "A", "age": 18, "tags": ["x", "y"], "address": {"street": "S", "city": None}}
    assert got[1] == {"name": None, "age": None, "tags": [], "address": None}
    assert got[2] == {"name": None, "age": None, "tags": None, "address": None}


@pytest.mark.parametrize("state,doc", [("omitted", "{}"), ("nil", '{"a": null}'), ("empty", '{"a": ""}')])
@pytest.mark.parametrize("to,want", [("nil", None), ("empty", "")])
def test_missing_states_on_reading(spark, state, doc, to, want):
    m = Mapping(Model("M", (Attribute("a"),)), (field_("a", "a", take={state: to}),))
    assert read(spark, [doc], m) == [{"a": want}]


@pytest.mark.parametrize("value,state", [(None, "nil"), ("", "empty")])
@pytest.mark.parametrize("to,want", [("omitted", "{}"), ("nil", '{"a":null}'), ("empty", '{"a":""}')])
def test_missing_states_on_writing(spark, value, state, to, want):
    m = Mapping(Model("M", (Attribute("a"),)), (field_("a", "a", give={state: to}),))
    assert write(spark, [(value,)], "a string", m) == [want]


def test_aliases_paths_delegates_and_delimiters(spark):
    m = Mapping(PERSON, (field_(["full", "name"], "name"), field_("a", "age", path=("x", "y")), field_("tags", "tags", delimiter=","), field_("road", "street", delegate="address")), root="person")
    got = read(spark, ['{"person": {"name": "n", "full": null, "x": {"y": {"a": 7}}, "tags": "p,q", "road": "R"}}'], m)
    assert got == [{"name": None, "age": 7, "tags": ["p", "q"], "address": {"street": "R"}}]
    out = write(spark, [("n", 7, ["p", "q"], ("R", None))], "name string, age bigint, tags array<string>, address struct<street string, city string>", m)
    assert json.loads(out[0]) == {"person": {"full": "n", "x": {"y": {"a": 7}}, "tags": "p,q", "road": "R"}}


def test_default_is_not_written(spark):
    schema = "name string, age bigint, tags array<string>, address struct<street string, city string>"
    assert json.loads(write(spark, [("n", 18, None, None)], schema, Mapping(PERSON))[0]) == {"name": "n"}


def test_derived_and_transforms(spark):
    model = Model("M", (Attribute("a"), Attribute("b", derived=lambda df: F.concat(df["a"], F.lit("!")))))
    assert read(spark, ['{"a": "x"}'], Mapping(model, (field_("a", "a", load=F.upper, attribute_load=lambda c: F.concat(c, c)),))) == [{"a": "XX", "b": "XX!"}]


def test_format_fallback():
    m = Mappings({"json": Mapping(PERSON)})
    assert m.of("jsonl") is m.of("json")
    assert [r.to for r in m.of("json").only("age").all()] == ["age"]
    assert "age" not in [r.to for r in m.of("json").without("age").all()]


def test_composition():
    child = PERSON.extend("Child", Attribute("age", "float"), Attribute("school"))
    assert [a.name for a in child.attributes] == ["name", "age", "tags", "address", "school"]
    assert child["age"].type == "float" and PERSON["age"].type == "integer"
    assert PERSON.restrict("name", pattern="^A")["name"].pattern == "^A"
    with pytest.raises(KeyError):
        PERSON.restrict("nothing", pattern="^A")
    with pytest.raises(ValueError):
        PERSON.include(Model("R", (), root="r"))
    r = Register("own", [Register("base", models={"Address": ADDRESS})], substitutes={"text": "string"})
    assert r.resolve("Address") is ADDRESS and r.resolve("text") == "string"
    with pytest.raises(KeyError):
        r.resolve("nothing")
    loop = r.add(Model("Loop", (Attribute("next", "Loop"),)))
    with pytest.raises(ValueError):
        r.link(loop)
    assert Choice(("a", "b")).without("a").names == ("b",)


def test_schemas_round_trip():
    assert schemas.from_json_schema(json.dumps(schemas.json_schema(PERSON))).ddl() == PERSON.ddl()
    assert schemas.from_xsd(schemas.xsd(PERSON)).ddl() == PERSON.ddl()
    with pytest.raises(ValueError):
        schemas.xsd(Model("U", (Attribute("u", ["integer", "string"]),)))


def test_xsd_components(spark):
    rows = spark.createDataFrame([("f", schemas.xsd(PERSON))], "path string, value string")
    found = schemas.components(rows)
    assert {(r.kind, r.name) for r in found.collect()} == {("element", "Person"), ("complexType", "Person"), ("complexType", "Address")}
    assert schemas.find_type(found, "Address").first().kind == "complexType"
    assert schemas.statistics(found).first().complexType == 2


def test_model_map_and_back(spark):
    m = ModelMap((Move("name", "n", F.upper, F.lower), Move("address", "place", nested=ModelMap((Move("street", "road"), Move("city", "town"))))))
    df = spark.createDataFrame([("a", ("s", "c"))], "name string, address struct<street string, city string>")
    many = ModelMap((Move("l", "m", each=ModelMap((Move("street", "road"),))),))
    got = transform(df.select(F.array("address").alias("l")), many)
    assert got.first().asDict(True) == {"m": [{"road": "s"}]}
    there = transform(df, m)
    assert there.first().asDict(True) == {"n": "A", "place": {"road": "s", "town": "c"}}
    assert reverse(there, m).first().asDict(True) == df.first().asDict(True)


def test_yaml_stream_skips_bad_documents(spark):
    df = spark.createDataFrame([("f", "a: 1\n---\nb: [\n---\nc: 2020-01-01\n")], "path string, value string")
    assert [(r.doc_idx, json.loads(r.json)) for r in documents.parse(df, "yamls").orderBy("doc_idx").collect()] == [(0, {"a": 1}), (1, {"c": "2020-01-01"})]


def test_registry_reads_files(spark, tmp_path):
    (tmp_path / "a.toml").write_text('name = "T"\nage = 3\n')
    (tmp_path / "b.jsonl").write_text('{"name": "J"}\n\nbad\n{"name": "K", "age": 4}\n')
    (tmp_path / "c.json").write_text('[{"name": "A"}, {"name": "B"}]')
    m = Mappings({"json": Mapping(PERSON), "toml": Mapping(PERSON)})
    names = lambda p, f: sorted((r.name, r.age) for r in registry.read(spark, str(tmp_path / p), f, m).collect())
    assert names("a.toml", "toml") == [("T", 3)]
    assert names("b.jsonl", "jsonl") == [("J", 18), ("K", 4)]
    assert names("c.json", "json") == [("A", 18), ("B", 18)]
    with registry.scoped(registry.Format("json", registry.FORMATS["jsonl"].read, lambda df: df)):
        assert names("b.jsonl", "json") == [("J", 18), ("K", 4)]
    with pytest.raises(KeyError):
        registry.find("csv2")
    assert registry.suggest(spark, "jsnl", ["json", "jsonl", "yaml"]) in ("json", "jsonl")


def test_xml_and_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (2, "")], "_id int, name string")
    text.write_xml(df, str(tmp_path / "x"), "rows", "row")
    got = text.read_xml(spark, str(tmp_path / "x"), "_id int, name string", "row")
    assert sorted((r["_id"], r["name"]) for r in got.collect()) == [(1, "a<b"), (2, "")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbad\n')
    assert text.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").count() == 1
    assert text.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int", keep_bad=True).count() == 2


def test_schemas_keep_choices():
    m = Model("M", (Attribute("a"), Attribute("b"), Attribute("c", "integer"), Attribute("d"), Attribute("e")), (Choice(("a", "b")), Choice(("c", "d", "e"), 0, 2)))
    assert schemas.from_json_schema(schemas.json_schema(m)).choices == m.choices
    assert schemas.from_xsd(schemas.xsd(m)).choices == m.choices


def test_foreign_xsd():
    common = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="Code"><xs:restriction base="xs:string"><xs:enumeration value="x"/><xs:enumeration value="y"/></xs:restriction></xs:simpleType></xs:schema>'
    text = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:t="urn:t"><xs:include schemaLocation="common.xsd"/><xs:element name="top" type="t:Child"/>
<xs:complexType name="Base"><xs:sequence><xs:element name="a" type="xs:integer"/></xs:sequence><xs:attribute name="id" type="xs:string" use="required"/></xs:complexType>
<xs:complexType name="Child"><xs:complexContent><xs:extension base="t:Base"><xs:choice minOccurs="0" maxOccurs="2"><xs:element name="b" type="t:Code"/><xs:element name="c" type="xs:date"/></xs:choice></xs:extension></xs:complexContent></xs:complexType></xs:schema>"""
    m = schemas.from_xsd(text, {"common.xsd": common})
    assert m.root == "top" and [a.name for a in m.attributes] == ["a", "id", "b", "c"]
    assert m["a"].type == "integer" and m["id"].required and m["b"].values == ("x", "y") and m["c"].type == "date"
    assert m.choices == (Choice(("b", "c"), 0, 2),)
    with pytest.raises(KeyError):
        schemas.from_xsd(text)
    assert schemas.unfit("<a/>") and schemas.unfit(text) == []
    assert schemas.unfit('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:assert test="1"/></xs:schema>') == ["assert needs XSD 1.1"]


def test_registers_imports_and_contexts():
    base, other = Register("base"), Register("other")
    base.add(Model("A", (Attribute("x"),)))
    other.add(Model("A", (Attribute("y"),)))
    base.bind("urn:o", other)
    assert base.resolve("{urn:o}A")["y"].name == "y" and base.resolve("A")["x"].name == "x"
    with pytest.raises(KeyError):
        base.resolve("{urn:p}A")
    copy, child = base.isolate("copy"), base.derive("child")
    base.add(Model("B", (Attribute("z"),)))
    assert child.resolve("B").name == "B" and "B" not in copy.models
    with base.scope(Model("C", (Attribute("w"),))):
        assert base.resolve("C").name == "C"
    with pytest.raises(KeyError):
        base.resolve("C")
    m = Model("M", (Attribute("a"), Attribute("b")), (Choice(("a", "b")),))
    n = Model("N", (Attribute("b", "integer"), Attribute("c")))
    assert [(a.name, a.type) for a in n.include_attributes(m, "b").attributes] == [("c", "string"), ("b", "string")]
    assert m.remove("a").choices == (Choice(("b",)),)


def test_sorting_and_ordered_content_conflict():
    from declario.plans import xml

    m = Model("M", (Attribute("a", collection=True),))
    with pytest.raises(ValueError):
        xml.XmlMapping(m, "m", (xml.element("a", "a"),), ordered=True, sort="a")
