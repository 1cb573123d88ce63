"""Further queries, chiefly formats, mappings and rules; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from declario.functions import casts, iri, strings
from declario.operators import consolidate, diff, refs, triples, validate
from declario.operators.collection import Collection, array_put
from declario.operators.shared import items
from declario.plans import compile as plans
from declario.plans import xml
from declario.plans.mapping import Keyed, Mapping, Rule, Transformer, field_
from declario.plans.model import Attribute, Choice, Model
from declario.queries import query, table
from declario.sources import documents, text

EX = "http://example.org/"
LINE = Model("Line", (Attribute("no", "integer"), Attribute("part", "integer"), Attribute("quantity", "float"), Attribute("flag")))
ORDER = Model("Order", (Attribute("id", "integer"), Attribute("status"), Attribute("lines", LINE, collection=True)))
ORDER_XML = xml.XmlMapping(
    ORDER,
    "order",
    (xml.attribute("id", "id"), xml.element("status", "status"), xml.element("line", "lines")),
    {"lines": xml.XmlMapping(LINE, "line", (xml.attribute("no", "no"), xml.element("part", "part"), xml.element("quantity", "quantity"), xml.content("flag")))},
)


@query("""
SELECT l_orderkey AS id, o_orderstatus AS status, CAST(l_linenumber AS BIGINT) AS no, l_partkey AS part, l_quantity AS quantity, l_returnflag AS flag
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def q54_xml_mapping(spark, sf_dir):
    """Attributes, elements, content and a nested collection, written as XML and read back."""
    line = F.struct(F.col("l_linenumber").cast("bigint").alias("no"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    docs = xml.write_frame(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "lines"), ORDER_XML)
    return items(xml.read_frame(docs, ORDER_XML), "lines", "l", "id", "status").select("id", "status", "l.*")


def _nation_xml(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit('<?print size="2" ink="a" ink="b"?><nation code="'), n, F.lit('">before <b>'), F.col("n_name"), F.lit("</b> after<!-- no --></nation>"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("<doc>"), body, F.lit("</doc>")).alias("value"))


@query("""
SELECT n_nationkey AS id, CAST(i AS INTEGER) AS pos, [ '/', '/doc', '/doc/nation', '/doc/nation', '/doc/nation', '/doc/nation/b', '/doc/nation'][i + 1] AS path,
 ['element', 'element', 'attribute', 'text', 'element', 'text', 'text'][i + 1] AS kind, ['doc', 'nation', 'code', NULL, 'b', NULL, NULL][i + 1] AS name,
 [NULL, NULL, CAST(n_nationkey AS VARCHAR), 'before ', NULL, n_name, ' after'][i + 1] AS text FROM nation, generate_series(0, 6) AS g(i)""")
def q55_xml_mixed_content(spark, sf_dir):
    """Mixed content as nodes in document order."""
    return xml.nodes(_nation_xml(spark, sf_dir)).select("id", F.posexplode("nodes").alias("pos", "n")).select("id", "pos", "n.*")


@query("SELECT n_nationkey AS id, 2 AS pos, '/doc/nation' AS path, CAST(n_nationkey AS VARCHAR) AS text FROM nation")
def q56_xml_listener(spark, sf_dir):
    return xml.heard(xml.nodes(_nation_xml(spark, sf_dir)), "attribute", "code", keep=("id",))


@query("SELECT n_nationkey AS id, 'size=\"2\" ink=\"a\" ink=\"b\"' AS content, '2' AS size, 'b' AS ink FROM nation")
def q57_processing_instructions(spark, sf_dir):
    found = _nation_xml(spark, sf_dir).select("id", F.explode(xml.instructions(F.col("value"), "print")).alias("content"))
    pseudo = strings.pi_attributes(F.col("content"))
    return found.select("id", "content", pseudo["size"].alias("size"), pseudo["ink"].alias("ink"))


@query("SELECT n_nationkey AS id, 'x <b>' || n_name || '</b> y' AS body FROM nation")
def q58_xml_inner(spark, sf_dir):
    model = Model("Note", (Attribute("id", "integer"), Attribute("body")))
    m = xml.XmlMapping(model, "note", (xml.attribute("id", "id"), xml.inner("body", "body")))
    doc = F.concat(F.lit('<note id="'), F.col("n_nationkey").cast("string"), F.lit('"><body>x <b>'), F.col("n_name"), F.lit("</b> y</body></note>"))
    return xml.read_frame(table(spark, sf_dir, "nation").select(doc.alias("value")), m)


@query("SELECT n_regionkey AS region, n_nationkey AS id, n_name AS name FROM nation")
def q59_xml_rootless_and_cdata(spark, sf_dir):
    """Items one after the other without a root, their text in CDATA sections."""
    item = F.concat(F.lit('<n id="'), F.col("n_nationkey").cast("string"), F.lit('">'), text.cdata(F.col("n_name")), F.lit("</n>"))
    docs = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.collect_list(item), "\n").alias("value"))
    got = text.rootless(docs, "value", "n array<struct<_id: int, _VALUE: string>>")
    return items(got, "value.n", "n", "region").select("region", F.col("n._id").alias("id"), F.col("n._VALUE").alias("name"))


@query("SELECT o_custkey AS cust, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def q60_keyed_documents(spark, sf_dir):
    """One map document for each customer, order number to order, and back to rows."""
    model = Model("Order", (Attribute("id", "integer"), Attribute("status"), Attribute("price", "float")))
    keyed = Keyed(Mapping(model), {"id": ":key"})
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return plans.read_keyed(plans.write_keyed(rows, keyed, ("cust",)), keyed, keep=("cust",))


@query("SELECT r_regionkey AS region, n_name AS name, CAST(n_nationkey AS BIGINT) AS code, 'n' || n_nationkey AS label FROM nation JOIN region ON r_regionkey = n_regionkey")
def q61_keyed_child_mappings(spark, sf_dir):
    """Keys, and values behind paths, as attributes."""
    model = Model("Nation", (Attribute("name"), Attribute("code", "integer"), Attribute("label")))
    n = F.col("n_nationkey")
    value = F.to_json(F.struct(F.struct(n.alias("code"), F.struct(F.concat(F.lit("n"), n.cast("string")).alias("t")).alias("deep")).alias("a")))
    entry = F.concat(F.lit('"'), F.col("n_name"), F.lit('":'), value)
    docs = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))
    return plans.read_keyed(docs, Keyed(Mapping(model), {"name": ":key", "code": ("a", "code"), "label": ("a", "deep", "t")}), keep=("region",))


@query("SELECT s_nationkey AS nation, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS pos, s_suppkey AS id, s_name AS name FROM supplier")
def q62_map_instances(spark, sf_dir):
    item = F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    docs = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("value"))
    return plans.read_instances(docs, "items", Mapping(Model("Supplier", (Attribute("id", "integer"), Attribute("name")))), keep=("nation",))


@query("SELECT event_id, props AS body, props AS again FROM events")
def q63_map_all(spark, sf_dir):
    """A document taken and written as it is."""
    m = Mapping(Model("Raw", (Attribute("body"),)), whole="body")
    rows = plans.read_frame(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value")), m, keep=("event_id",))
    return rows.select("event_id", "body", plans.write(F.struct("body"), m).alias("again"))


@query("""
SELECT p_partkey AS id, upper(p_name) AS name, p_brand AS brand, p_retailprice * 2 AS price, '{"id":' || p_partkey || ',"name":"' || lower(p_name) || '","brand":"' || p_brand || '!"}' AS json FROM part""")
def q64_transformers_and_methods(spark, sf_dir):
    """Value transformers by format, and custom reader and writer methods."""
    model = Model("Part", (Attribute("id", "integer"), Attribute("name"), Attribute("brand"), Attribute("price", "float")))
    case = Transformer({"json": F.upper, "yaml": F.lower}, {"json": F.lower})
    rules = (
        Rule(("id",), "id"),
        Rule(("name",), "name", **case.options()),
        Rule(("brand",), "brand", writer=lambda row: plans.quoted(F.concat(row.brand, F.lit("!")))),
        Rule(("price",), "price", reader=lambda obj: F.try_element_at(obj, F.lit("price")).cast("double") * 2),
    )
    docs = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))).alias("value"))
    m = Mapping(model, rules)
    return plans.read_frame(docs, m).withColumn("json", plans.write(F.struct("id", "name", "brand", "price"), m.without("price")))


@query(r"""
SELECT 'http://example.org/nation/' || n_nationkey AS s, p, CASE p WHEN 'http://example.org/path' THEN 'C:\temp\new ' || n_name WHEN 'http://example.org/code' THEN CAST(n_nationkey AS VARCHAR) ELSE 'http://example.org/region/' || n_regionkey END AS o,
 CASE p WHEN 'http://example.org/path' THEN 'en' END AS lang, CASE p WHEN 'http://example.org/code' THEN 'http://www.w3.org/2001/XMLSchema#integer' END AS datatype
FROM nation, (VALUES ('http://example.org/path'), ('http://example.org/code'), ('http://example.org/in')) AS t(p)""")
def q65_turtle_documents(spark, sf_dir):
    """Prefixes, bare numbers, language tags and escapes with backslashes."""
    n = F.col("n_nationkey").cast("string")
    path = F.concat(iri.literal(F.concat(F.lit("C:\\temp\\new "), F.col("n_name"))), F.lit("@en"))
    one = F.concat(F.lit("ex:nation/".replace("/", "%")), n, F.lit(" x:path "), path, F.lit(" ;\n  x:code "), n, F.lit(" ; x:in <http://example.org/region/"), F.col("n_regionkey").cast("string"), F.lit("> ."))
    one = F.replace(one, F.lit("ex:nation%"), F.lit("nation:"))
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit(f"@prefix nation: <{EX}nation/> .\n@prefix x: <{EX}> .\n"), F.array_join(F.collect_list(one), "\n")).alias("value"))
    return triples.read_turtle(docs)


@query(f"SELECT '{EX}nation/' || n_nationkey AS id, 'Nation' AS type, n_name AS label, CAST(n_regionkey AS BIGINT) AS region, fmt FROM nation, (VALUES ('jsonld'), ('yamlld')) AS f(fmt)")
def q66_linked_data_read(spark, sf_dir):
    """JSON-LD graphs by region, in JSON and in YAML, back to rows."""
    subject = F.concat(F.lit(f"{EX}nation/"), F.col("n_nationkey").cast("string"))
    node = F.struct(subject.alias("@id"), F.lit("Nation").alias("@type"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("region"))
    doc = F.to_json(F.struct(F.struct(F.lit(f"{EX}label").alias("label")).alias("@context"), F.collect_list(node).alias("@graph")))
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(doc.alias("json"))
    model = Model("Nation", (Attribute("id"), Attribute("type"), Attribute("label"), Attribute("region", "integer")))
    m = Mapping(model, (field_("@id", "id"), field_("@type", "type"), field_("label", "label"), field_("region", "region")))
    as_json = documents.parse(docs, "jsonld", "json", "n_regionkey").withColumn("fmt", F.lit("jsonld"))
    as_yaml = documents.parse(documents.write_text(docs, "yaml"), "yamlld", "json", "n_regionkey").withColumn("fmt", F.lit("yamlld"))
    return plans.read_frame(as_json.union(as_yaml), m, "json", ("fmt",))


@query("SELECT p_partkey AS id, p_name AS name, p_type AS words, CAST(p_size AS BIGINT) AS size FROM part")
def q67_xml_as_format(spark, sf_dir):
    """XML through the generic mapping: attributes are ``@``, text is ``#text``."""
    model = Model("Part", (Attribute("id", "integer"), Attribute("name"), Attribute("words", collection=True), Attribute("size", "integer")))
    m = Mapping(model, (field_("@id", "id"), Rule(("#text",), "name", path=("name",)), field_("word", "words"), Rule(("value",), "size", path=("size",))), root="part")
    name = F.struct(F.lit("en").alias("@lang"), F.col("p_name").alias("#text"))
    body = F.struct(F.col("p_partkey").alias("@id"), name.alias("name"), F.split("p_type", " ").alias("word"), F.struct(F.lit(1).alias("@v"), F.col("p_size").alias("value")).alias("size"))
    docs = documents.write_text(table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(body.alias("part"))).alias("json")), "xml")
    return plans.read_frame(documents.parse(docs, "xml", "json", "p_partkey"), m, "json").withColumn("words", F.array_join("words", " "))


@query("""
SELECT c_custkey AS id, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), [])::BIGINT[] AS orders, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def q68_references_of_all(spark, sf_dir):
    """References of every customer, also of those without any: empty stays empty."""
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    rows = table(spark, sf_dir, "customer").join(keys, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), F.coalesce("keys", F.array().cast("array<bigint>")).alias("keys"))
    got = refs.resolve_all(rows, "keys", table(spark, sf_dir, "orders"), "o_orderkey", "found", "id")
    return got.select("id", F.transform("found", lambda x: x.o_orderkey).alias("orders"), F.size("found").cast("bigint").alias("n"))


@query("""
WITH a AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS code FROM customer), b AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN 'X' ELSE seg END AS seg, CASE WHEN id % 5 <> 0 THEN code END AS code FROM a)
SELECT a.id, 'm.seg' AS path, NULL::INTEGER AS index, 'changed' AS op, a.seg AS old, b.seg AS new FROM a JOIN b USING (id) WHERE a.seg <> b.seg
UNION ALL SELECT a.id, 'm.tags', 1, 'removed', a.code, NULL FROM a JOIN b USING (id) WHERE b.code IS NULL""")
def q69_diff_nested(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    code = F.col("c_nationkey").cast("string")
    side = lambda seg, tags: c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(seg.alias("seg"), tags.alias("tags")).alias("m"))
    left = side(F.col("c_mktsegment"), F.array(F.col("c_name"), code))
    right = side(F.when(F.col("c_custkey") % 3 == 0, "X").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 5 != 0, F.array(F.col("c_name"), code)).otherwise(F.array("c_name")))
    return diff.differences(left, right, "id")


@query(r"""
WITH r AS (SELECT p_partkey AS id, p_name, p_brand, p_size, string_split(p_type, ' ') AS words, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS kind FROM part)
SELECT id AS row_id, path, code, sev AS severity, message FROM (
 SELECT id, 'p_brand' AS path, 'pattern' AS code, 'error' AS sev, 'p_brand does not match' AS message FROM r WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]')
 UNION ALL SELECT id, 'p_name', 'length', 'warning', 'p_name has a wrong length' FROM r WHERE length(p_name) > 12
 UNION ALL SELECT id, 'words', 'collection_size', 'error', 'words has a wrong size' FROM r WHERE len(words) NOT BETWEEN 3 AND 3
 UNION ALL SELECT id, 'words', 'pattern', 'error', 'words does not match' FROM r WHERE len(list_filter(words, lambda w: NOT regexp_matches(w, '^[A-Z]+$'))) > 0
 UNION ALL SELECT id, 'kind', 'required', 'error', 'kind is missing' FROM r WHERE kind IS NULL OR kind = ''
 UNION ALL SELECT id, 'kind', 'polymorphic', 'error', 'kind is not an allowed type' FROM r WHERE kind IS NOT NULL AND kind NOT LIKE 'PROMO%')""")
def q70_validate_rules(spark, sf_dir):
    """Patterns, also of every item, lengths, sizes, required and polymorphic types."""
    kind = F.when(F.col("p_partkey") % 7 != 0, F.col("p_type"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", F.split("p_type", " ").alias("words"), kind.alias("kind"))
    allowed = [r.p_type for r in table(spark, sf_dir, "part").select("p_type").where("p_type LIKE 'PROMO%'").distinct().collect()]  # a handful of type names
    rules = [
        validate.pattern("p_brand", "^Brand#[1-3]"),
        validate.length_between("p_name", 0, 12, severity="warning"),
        validate.size_between("words", 3, 3),
        validate.pattern("words", "^[A-Z]+$", array=True),
        validate.required("kind"),
        validate.type_in("kind", allowed),
    ]
    return validate.issues(rows, "id", rules)


@query("""
SELECT doc_id AS row_id, 'lang' AS path, 'required' AS code, 'warning' AS severity, 'lang is missing' AS message FROM documents WHERE lang IS NULL OR lang = '' OR doc_id % 4 = 0
UNION ALL SELECT doc_id, 'source', 'required', 'error', 'source is missing' FROM documents WHERE source IS NULL OR source = ''""")
def q71_profile(spark, sf_dir):
    """A profile read from YAML that imports another one; conditions see the context."""

    def langs(df, context):
        context["seen"] = True
        return validate.all_present(df, "lang", "doc_id", "warning")

    rules = {
        "langs": validate.CollectionRule("langs", langs),
        "sources": validate.CollectionRule("sources", lambda df, c: validate.all_present(df, "source", "doc_id"), if_cond=lambda c: c.get("seen", False)),
        "never": validate.CollectionRule("never", lambda df, c: validate.all_present(df, "text", "doc_id"), unless_cond=lambda c: c.get("seen", False)),
    }
    base = validate.Profile.parse("name: base\nrules: [langs]", rules, {})
    found = validate.Profile.parse("name: all\nimports: [base]\nrules: [sources, never]", rules, {"base": base}).run(table(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.col("lang"))))
    out = None
    for issues in found.values():
        out = issues if out is None else out.union(issues)
    return out


@query(r"""
SELECT p_partkey AS id, array_to_string(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda w: upper(w[1]) || w[2:]), '') AS camel,
 array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(w[1]) || w[2:]), '') AS class,
 list_extract(string_split(p_brand || ':' || p_partkey, ':'), -1) AS tail, to_base64(encode(p_name)) AS b64, lower(hex(encode(p_name))) AS hex,
 'urn:publicid:-:' || replace(p_type, ' ', '+') || ':EN' AS urn, p_name AS back FROM part""")
def q72_names_and_encodings(spark, sf_dir):
    c = F.col("p_name")
    urn = strings.fpi_to_urn(F.concat(F.lit("-//"), F.col("p_type"), F.lit("//EN")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        strings.camel_case(F.replace(c, F.lit(" "), F.lit("_"))).alias("camel"),
        strings.classify(F.replace(c, F.lit(" "), F.lit("-"))).alias("class"),
        strings.last_of_split(F.concat("p_brand", F.lit(":"), F.col("p_partkey").cast("string"))).alias("tail"),
        strings.base64_encode(c).alias("b64"),
        strings.hex_encode(c).alias("hex"),
        urn.alias("urn"),
        strings.hex_decode(strings.hex_encode(strings.base64_decode(strings.base64_encode(c)))).alias("back"),
    )


@query("""
SELECT l_orderkey AS id, l_linenumber AS no, 'P' || l_linenumber || 'Y2M3DT' || l_linenumber || 'H0.5S' AS duration, CAST(l_linenumber AS DOUBLE) AS years, 0.5::DOUBLE AS seconds, NULL::VARCHAR AS bad,
 'ns' AS prefix, l_returnflag AS local, l_returnflag AS symbol, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':05:09' AS time, 3600 * l_linenumber + 1800 AS zone, l_linenumber::DOUBLE AS f, NULL::BOOLEAN AS flag, 'maybe' AS raw FROM lineitem""")
def q73_casts(spark, sf_dir):
    """Durations, qualified names, symbols, times, zones, floats and words that are no truth value."""
    n = F.col("l_linenumber").cast("string")
    duration = F.concat(F.lit("P"), n, F.lit("Y2M3DT"), n, F.lit("H0.5S"))
    name = casts.cast("qname", F.concat(F.lit("ns:"), F.col("l_returnflag")))
    parts = casts.duration_parts(duration)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("no"),
        casts.cast("duration", duration).alias("duration"),
        parts.years.alias("years"),
        parts.seconds.alias("seconds"),
        casts.cast("duration", F.concat(F.lit("P"), n, F.lit(".5Y"))).alias("bad"),
        name.prefix.alias("prefix"),
        name.local.alias("local"),
        casts.cast("symbol", F.concat(F.lit(":"), F.col("l_returnflag"), F.lit(":"))).alias("symbol"),
        casts.cast("time_without_date", F.concat(n, F.lit(":05:09"))).alias("time"),
        casts.zone_seconds(F.concat(F.lit("10:00:00+0"), n, F.lit(":30"))).alias("zone"),
        casts.cast("float", F.concat(n, F.lit(" kg"))).alias("f"),
        casts.cast("boolean", F.lit("maybe")).alias("flag"),
        casts.raw_boolean(F.lit("maybe")).alias("raw"),
    )


@query("""
SELECT s_suppkey AS id, '$' || CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) AS money, CAST(round(s_acctbal) AS BIGINT) AS back FROM supplier""")
def q74_type_of_ones_own(spark, sf_dir):
    """A registered value type, written and read through a mapping."""
    casts.register_type("money", "bigint", lambda c: F.replace(c.cast("string"), F.lit("$"), F.lit("")).try_cast("bigint"), lambda c, fmt: F.concat(F.lit("$"), c.cast("string")))
    m = Mapping(Model("Account", (Attribute("id", "integer"), Attribute("balance", "money"))))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.round("s_acctbal").cast("bigint").alias("balance"))
    docs = plans.write_frame(rows, m)
    return plans.read_frame(docs, m, keep=("value",)).select("id", plans.extract(plans.members(F.col("value")), Rule(("balance",), "balance"))[0].alias("money"), F.col("balance").alias("back"))


@query("""
SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN '' ELSE event_type END AS plain,
 CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE event_type END AS defaulted, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN event_type END AS emptied,
 CASE event_id % 4 WHEN 0 THEN '{"a":null}' WHEN 1 THEN '{"a":null}' WHEN 2 THEN '{"a":""}' ELSE '{"a":"' || event_type || '"}' END AS shown,
 CASE WHEN event_id % 4 < 3 THEN '{}' ELSE '{"a":"' || event_type || '"}' END AS hidden FROM events""")
def q75_missing_states(spark, sf_dir):
    """Omitted, null and empty fields, read and written by rules."""
    kind = F.col("event_id") % 4
    doc = F.when(kind == 0, "{}").when(kind == 1, '{"a":null}').when(kind == 2, '{"a":""}').otherwise(F.concat(F.lit('{"a":"'), F.col("event_type"), F.lit('"}')))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), doc.alias("doc"))
    one = Model("M", (Attribute("a"),))
    plain = Mapping(one, (field_("a", "a", render_nil=True, render_empty=True),))
    read = lambda m: plans.read(F.col("doc"), m).a
    return rows.select(
        "id",
        read(plain).alias("plain"),
        read(Mapping(Model("M", (Attribute("a", default="none"),)))).alias("defaulted"),
        read(Mapping(one, (Rule(("a",), "a", take={"empty": "nil"}),))).alias("emptied"),
        plans.write(F.struct(read(plain).alias("a")), plain).alias("shown"),
        plans.write(F.struct(read(plain).alias("a")), Mapping(one)).alias("hidden"),
    )


@query("SELECT o_orderkey AS id, o_custkey AS cust, n_name AS nation, o_orderstatus AS status, o_orderstatus || '/' || n_name AS label FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def q76_paths_delegates_derived(spark, sf_dir):
    """Nested paths, delegated and derived attributes."""
    place = Model("Place", (Attribute("nation"),))
    model = Model(
        "Order",
        (Attribute("id", "integer"), Attribute("cust", "integer"), Attribute("place", place), Attribute("status"), Attribute("label", derived=lambda df: F.concat("status", F.lit("/"), "place.nation"))),
    )
    m = Mapping(model, (field_("id", "id"), Rule(("key",), "cust", path=("who", "ref")), Rule(("nation",), "nation", delegate="place"), field_(["state", "status"], "status")))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    who = F.struct(F.struct(F.col("o_custkey").alias("key")).alias("ref"))
    docs = rows.select(F.to_json(F.struct(F.col("o_orderkey").alias("id"), who.alias("who"), F.col("n_name").alias("nation"), F.col("o_orderstatus").alias("status"))).alias("value"))
    return plans.read_frame(docs, m).select("id", "cust", "place.nation", "status", "label")


@query("""
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END AS balance FROM customer WHERE NOT (c_acctbal < 0 AND c_custkey % 10 <> 0)
UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE NOT s_acctbal < 0""")
def q77_collection_changes(spark, sf_dir):
    """Rows pushed, put and rejected; items of another shape are brought to the collection's."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    more = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") + 1000000).cast("string").alias("id"), F.col("s_acctbal").alias("balance"))
    rows = Collection(c, ["id"]).put((F.col("id") % 10 == 0) & (F.col("balance") != 0), balance=F.lit(0.0))
    return rows.push(Collection.coerce(more, c.schema)).reject(F.col("balance") < 0).df


@query("SELECT n_regionkey AS id, n_nationkey AS code, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey")
def q78_parent_access(spark, sf_dir):
    items = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("code")))).alias("nations"))
    rows = table(spark, sf_dir, "region").join(items, F.col("r_regionkey") == F.col("n_regionkey")).select(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "nations").alias("region"))
    got = plans.with_parent(rows, "region", "nations", ("id", "name"))
    return got.select("parent.id", "code", "pos", F.col("parent.name").alias("parent"))


@query("""
SELECT conv_id, max(text) FILTER (role = 'user' AND r = 1) AS user_text, max(text) FILTER (role = 'assistant' AND r = 1) AS assistant_text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL) GROUP BY 1""")
def q79_language_map(spark, sf_dir):
    """Tagged values as a map of tag to text, the last of a tag wins."""
    got = triples.language_map(table(spark, sf_dir, "conversations"), "role", "text", ["turn"], "conv_id")
    at = lambda k: F.try_element_at("map", F.lit(k))
    return got.select("conv_id", at("user").alias("user_text"), at("assistant").alias("assistant_text"))


@query("SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS first, 9.0::DOUBLE AS put, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def q80_array_put(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    put = array_put(v, 2, F.lit(9.0))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), put[0].alias("first"), put[2].alias("put"), F.element_at(put, -1).alias("last"))


@query("""
WITH m AS (SELECT event_id, ts, event_type, value, count(*) FILTER (event_type = 'click') OVER (ORDER BY event_id) AS chunk, count(*) FILTER (event_type IN ('click', 'view')) OVER (ORDER BY event_id) AS seen FROM events)
SELECT chunk, arg_max(CAST(value AS VARCHAR), event_id) FILTER (event_type = 'click') AS click, arg_max(event_id, event_id) FILTER (event_type = 'view') AS view_id FROM m WHERE seen > 0 AND event_type IN ('click', 'view') GROUP BY 1""")
def q81_chunk_one_stream(spark, sf_dir):
    """One stream over all events, numbered over many tasks."""
    e = table(spark, sf_dir, "events")
    shown = F.when(F.col("event_type") == "view", F.col("event_id").cast("string")).otherwise(F.col("value").cast("string"))
    got = consolidate.chunk(e.select("event_id", "event_type", shown.alias("v")), "event_type", "v", ["event_id"], "click", {"click": "click", "view": "view_id"})
    return got.select("chunk", "click", F.col("view_id").cast("bigint").alias("view_id"))


@query(r"""
WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'a' END AS one, CASE WHEN p_partkey % 2 = 0 THEN 'b' END AS two, p_partkey % 4 AS n, p_size AS size FROM part)
SELECT id AS row_id, path, code FROM (
 SELECT id, 'name' AS path, 'required' AS code FROM r WHERE name IS NULL
 UNION ALL SELECT id, 'brand', 'enum' FROM r WHERE brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')
 UNION ALL SELECT id, 'words', 'collection_size' FROM r WHERE n > 2
 UNION ALL SELECT id, 'words', 'pattern' FROM r WHERE n > 2
 UNION ALL SELECT id, 'box.size', 'pattern' FROM r WHERE n <> 0 AND NOT regexp_matches(CAST(size AS VARCHAR), '^[1-4]')
 UNION ALL SELECT id, 'one|two', 'choice' FROM r WHERE (one IS NOT NULL)::INT + (two IS NOT NULL)::INT <> 1
 UNION ALL SELECT id, 'order', 'sequence' FROM r WHERE id % 6 = 1)""")
def q82_rules_of_a_model(spark, sf_dir):
    """Everything that a model declares, checked in one pass."""
    box = Model("Box", (Attribute("size", pattern="^[1-4]"),))
    model = Model(
        "Part",
        (
            Attribute("name", required=True),
            Attribute("brand", values=("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22")),
            Attribute("words", collection=(0, 2), pattern="^[01]"),
            Attribute("box", box),
            Attribute("one"),
            Attribute("two"),
            Attribute("many", collection=(0, 1)),
        ),
        (Choice(("one", "two")), Choice(("many",), 1, 1)),
        sequence=("name", "brand", "words"),
    )
    k = F.col("p_partkey")
    words = F.slice(F.array(*map(F.lit, "0123")), 1, (k % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.when(k % 5 != 0, F.col("p_name")).alias("name"),
        F.col("p_brand").alias("brand"),
        words.alias("words"),
        F.when(k % 4 != 0, F.struct(F.col("p_size").cast("string").alias("size"))).alias("box"),
        F.when(k % 3 == 0, "a").alias("one"),
        F.when(k % 2 == 0, "b").alias("two"),
        F.array().cast("array<string>").alias("many"),
        F.when(k % 6 == 1, F.array(F.lit("brand"), F.lit("name"))).otherwise(F.array(F.lit("name"), F.lit("else"), F.lit("words"))).alias("order"),
    )
    return validate.issues(rows, "id", validate.of_model(model, "order")).select("row_id", "path", "code")
