"""Queries over the test tables, each by the library's operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.functions import casts, iri, strings, variants
from declario.operators import consolidate, diff, refs, triples, validate
from declario.operators.collection import Collection, array_at, slices, sort_array_by
from declario.plans import compile as plans
from declario.plans.mapping import Mapping, field_
from declario.plans.model import Attribute, Model
from declario.plans.transform import ModelMap, Move, reverse, transform
from declario.sources import documents, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT c_custkey AS id, c_name AS name, n_name AS nation, r_name AS region, c_acctbal AS balance
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 0""")
def q01_ref_resolve_chain(spark, sf_dir):
    nations = refs.resolve(table(spark, sf_dir, "nation"), "n_regionkey", table(spark, sf_dir, "region"), "r_regionkey", "region")
    got = refs.resolve(table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_nationkey", nations, "n_nationkey", "nation")
    got = got.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("nation.n_name").alias("nation"),
        F.col("nation.region.r_name").alias("region"),
        F.col("c_acctbal").alias("balance"),
    )
    return Collection(got, ["id"]).sort("balance", "desc")


@query(r"""
WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '0' || CAST(o_orderkey AS VARCHAR) WHEN 1 THEN CAST(o_orderkey AS VARCHAR)
  WHEN 2 THEN '-' || CAST(o_orderkey AS VARCHAR) || '.75' WHEN 3 THEN CAST(o_orderkey % 1000 AS VARCHAR) || 'e2' ELSE CAST(o_orderkey AS VARCHAR) || 'x' END AS t FROM orders)
SELECT id, t AS text, CASE WHEN regexp_full_match(t, '0[0-7]+') THEN CAST(list_sum(list_transform(generate_series(1, len(t)),
   lambda i: CAST(t[i] AS BIGINT) * CAST(pow(8, len(t) - i) AS BIGINT))) AS BIGINT)
  WHEN regexp_full_match(t, '-?[0-9]+([.][0-9]+)?([eE]-?[0-9]+)?') THEN CAST(trunc(CAST(t AS DOUBLE)) AS BIGINT) END AS value FROM s""")
def q02_cast_integer_text(spark, sf_dir):
    k = F.col("o_orderkey")
    s = k.cast("string")
    t = (
        F.when(k % 5 == 0, F.concat(F.lit("0"), s))
        .when(k % 5 == 1, s)
        .when(k % 5 == 2, F.concat(F.lit("-"), s, F.lit(".75")))
        .when(k % 5 == 3, F.concat((k % 1000).cast("string"), F.lit("e2")))
        .otherwise(F.concat(s, F.lit("x")))
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), t.alias("text")).withColumn("value", casts.cast("integer", F.col("text")))


@query("""
SELECT o_orderkey AS id, CASE WHEN lower(o_orderstatus) IN ('true', 't', 'yes', 'y', '1') THEN true
 WHEN lower(o_orderstatus) IN ('false', 'f', 'no', 'n', '0') THEN false END AS flag,
 CASE WHEN lower(o_orderstatus) NOT IN ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0') THEN o_orderstatus END AS raw FROM orders""")
def q03_cast_boolean(spark, sf_dir):
    c = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), casts.boolean(c).alias("flag"), casts.raw_boolean(c).alias("raw"))


@query("""
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS xml_stamp FROM orders""")
def q04_date_serialize(spark, sf_dir):
    c = F.col("o_orderdate")
    whole = F.date_trunc("second", c).cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), casts.serialize("date", c).alias("day"), casts.serialize("date_time", whole, "xml").alias("xml_stamp")
    )


@query("""
SELECT event_id, CAST(CASE WHEN list_contains(json_keys(props), 'key') THEN props->>'key' WHEN list_contains(json_keys(props), 'k') THEN props->>'k' END AS BIGINT) AS key
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 AND props LIKE '{%' THEN '{"key": null, ' || substr(props, 2) ELSE props END AS props FROM events)""")
def q05_alias_first_present(spark, sf_dir):
    props = F.when((F.col("event_id") % 3 == 0) & F.startswith("props", F.lit("{")), F.concat(F.lit('{"key": null, '), F.substr("props", F.lit(2)))).otherwise(F.col("props"))
    m = Mapping(Model("Props", (Attribute("key", "integer"),)), (field_(["key", "k"], "key"),))
    return plans.read_frame(table(spark, sf_dir, "events").select("event_id", props.alias("value")), m, keep=("event_id",))


@query("""
SELECT event_id, coalesce(CASE WHEN props IS NOT NULL AND props <> '' THEN CAST(props->>'k' AS BIGINT) END, CASE WHEN props IS NOT NULL AND props <> '' AND NOT list_contains(json_keys(props), 'k') THEN -1 END) AS k,
 CASE WHEN props IS NOT NULL AND props <> '' THEN 'web' END AS channel, props IS NOT NULL AND props <> '' AS present FROM events""")
def q06_default_and_presence(spark, sf_dir):
    m = Mapping(Model("Props", (Attribute("k", "integer", default=-1), Attribute("channel", default="web"))))
    rows = table(spark, sf_dir, "events").select("event_id", plans.read(F.col("props"), m).alias("m"), strings.present(F.col("props")).alias("present"))
    return rows.select("event_id", "m.k", "m.channel", "present")


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def q07_set_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return Collection(a, ["nation"]).union(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def q08_set_intersection(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return Collection(a, ["nation"]).intersection(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("""
SELECT o_custkey AS cust FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT DISTINCT FROM o_custkey)""")
def q09_set_difference_bag(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"))
    return Collection(a, ["cust"]).difference(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("cust")))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def q10_index_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return Collection(rows, ["ts", "event_id"]).index("user_id").select("user_id", "event_id", "event_type", "value")


@query("SELECT lower(c_mktsegment) AS key, max(c_custkey) AS c_custkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY 1")
def q11_index_expression(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return Collection(rows, ["c_custkey"]).index(F.lower("c_mktsegment")).select("key", "c_custkey", "c_name")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def q12_keyed_collection(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return Collection(rows, ["o_orderkey"]).keyed("o_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q13_duplicates(spark, sf_dir):
    return Collection(table(spark, sf_dir, "lineitem").select("l_orderkey"), ["l_orderkey"]).duplicates("l_orderkey")


@query("""
SELECT count(*) FILTER (text IS NULL OR text = '') AS text, count(*) FILTER (lang IS NULL OR lang = '') AS lang, count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic
FROM documents LEFT JOIN labels USING (doc_id)""")
def q14_missing_count(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return Collection(rows, ["doc_id"]).missing("text", "lang", "quality", "toxic")


@query("""
SELECT l_returnflag, count(l_quantity) AS count, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 2) AS average, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1""")
def q15_metric_summary(spark, sf_dir):
    return Collection(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).summary("l_quantity", "l_returnflag")


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@query("SELECT o_custkey, min(o_orderkey) AS first_seen, strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS since, " + ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (o_orderpriority = '{k}') AS {v}" for k, v in PRIORITIES.items()) + " FROM orders GROUP BY 1")
def q16_consolidate_route(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("day", casts.serialize("date", F.col("o_orderdate")))
    g = consolidate.Grouping("o_custkey", ["o_orderkey"], {"since": "day"}, consolidate.Dispatch("o_orderpriority", PRIORITIES, "o_totalprice"))
    return consolidate.consolidate(rows, g)


@query("""
SELECT conv_id, min(turn) AS first_seen, arg_min(text, turn) AS opening, arg_max(text, turn) FILTER (role = 'user') AS user, arg_max(text, turn) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY 1""")
def q17_consolidate_dialogue(spark, sf_dir):
    g = consolidate.Grouping("conv_id", ["turn"], {"opening": "text"}, consolidate.Dispatch("role", {"user": "user", "assistant": "assistant"}, "text"))
    return consolidate.consolidate(table(spark, sf_dir, "conversations"), g)


@query("""
SELECT conv_id, chunk, arg_max(text, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant') AS answer
FROM (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS chunk FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY 1, 2""")
def q18_chunk_pattern(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return consolidate.chunk(rows, "role", "text", ["turn"], "user", {"user": "question", "assistant": "answer"}, by=["conv_id"])


@query("""
SELECT c_custkey AS row_id, 'c_mktsegment' AS path, 'enum' AS code, 'error' AS severity FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')
UNION ALL SELECT c_custkey, 'c_name', 'pattern', 'error' FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')
UNION ALL SELECT c_custkey, 'c_name', 'required', 'error' FROM customer WHERE c_name IS NULL OR c_name = ''
UNION ALL SELECT c_custkey, 'c_acctbal', 'numericality', 'warning' FROM customer WHERE c_acctbal <= 0""")
def q19_validate_issues(spark, sf_dir):
    rules = [
        validate.one_of("c_mktsegment", ["BUILDING", "AUTOMOBILE", "MACHINERY"]),
        validate.pattern("c_name", "[02468]$"),
        validate.required("c_name"),
        validate.number("c_acctbal", greater=0, severity="warning"),
    ]
    return validate.issues(table(spark, sf_dir, "customer"), "c_custkey", rules).drop("message")


LINE_RULES = """
SELECT l_orderkey * 10 + l_linenumber AS row_id, 'l_quantity' AS path, 'numericality' AS code, 'error' AS severity FROM lineitem WHERE l_quantity >= 45
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_discount', 'numericality', 'warning' FROM lineitem WHERE l_discount <= 0
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'l_returnflag', 'enum', 'info' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')"""


def _line_issues(spark, sf_dir) -> DataFrame:
    rules = [
        validate.number("l_quantity", less=45),
        validate.number("l_discount", greater=0, severity="warning"),
        validate.one_of("l_returnflag", ["A", "N"], severity="info"),
    ]
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return validate.issues(rows, "id", rules).drop("message")


@query(LINE_RULES)
def q20_validate_numeric(spark, sf_dir):
    return _line_issues(spark, sf_dir)


@query("SELECT md5(text) AS value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def q21_validate_unique(spark, sf_dir):
    return validate.unique(table(spark, sf_dir, "documents").select(F.md5("text").alias("h")), "h")


@query("""
SELECT o_orderkey AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) < 1 OR count(l_orderkey) > 6""")
def q22_validate_counts(spark, sf_dir):
    return validate.counts_between(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", 1, 6)


@query(f"SELECT severity, code, count(*) AS n FROM ({LINE_RULES}) GROUP BY 1, 2")
def q23_report_by_severity(spark, sf_dir):
    return validate.report(_line_issues(spark, sf_dir))


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS t, o_orderkey % 2 = 0 AS e FROM orders),
 b AS (SELECT o_orderkey - 1 AS id, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t, o_orderkey % 2 = 0 AS e FROM orders)
SELECT coalesce(a.id, b.id) AS id, round(CASE WHEN a.id IS NULL OR b.id IS NULL THEN 1.0 ELSE (
 CASE WHEN a.s IS NOT DISTINCT FROM b.s THEN 0 WHEN a.s IS NULL OR b.s IS NULL THEN 1 ELSE 0.5 END + CASE WHEN a.p IS NOT DISTINCT FROM b.p THEN 0 WHEN a.p IS NULL OR b.p IS NULL THEN 1 ELSE 0.5 END
 + CASE WHEN a.t IS NOT DISTINCT FROM b.t THEN 0 WHEN a.t IS NULL OR b.t IS NULL THEN 1 ELSE 0.5 END + CASE WHEN a.e IS NOT DISTINCT FROM b.e THEN 0 ELSE 1 END) / 4.0 END, 6)::DOUBLE AS score
FROM a FULL JOIN b ON a.id = b.id""")
def q24_diff_score_pairs(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rest = [F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")]
    even = (k % 2 == 0).alias("e")
    a = o.select(k.alias("id"), *rest, F.when(k % 7 != 0, F.col("o_totalprice")).alias("t"), even)
    b = o.select((k - 1).alias("id"), *rest, F.col("o_totalprice").alias("t"), even)
    return diff.score_pairs(a, b, "id").select("id", F.round("score", 6).alias("score"))


@query("""
WITH e AS (SELECT vec_id, list_concat(list_transform(embedding, lambda x: round(x * 4)), list_transform(generate_series(1, vec_id % 3), lambda x: 0.0)) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(generate_series(1, greatest(len(v), len(w))), lambda i: CASE WHEN i > len(v) OR i > len(w) THEN 1.0 WHEN v[i] = w[i] THEN 0.0 ELSE 0.5 END)) / greatest(len(v), len(w)), 6)::DOUBLE AS score FROM p""")
def q25_diff_array_positional(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    more = F.array_repeat(F.lit(0.0), (F.col("vec_id") % 3).cast("int"))  # for arrays of unequal length
    v = F.concat(F.transform("embedding", lambda x: F.round(x * 4).cast("double") + 0.0), more)
    a, b = e.select("vec_id", v.alias("v")), e.select((F.col("vec_id") - 1).alias("vec_id"), v.alias("w"))
    return a.join(b, "vec_id").select("vec_id", F.round(diff.array_score(F.col("v"), F.col("w"), T.DoubleType()), 6).alias("score"))


@query(r"""
WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props->>'k' WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN 'yes' ELSE event_type END AS t FROM events)
SELECT event_id, CASE WHEN t IS NULL THEN NULL WHEN regexp_matches(t, '^\s*[+-]?[0-9]+\s*$') THEN 'integer' WHEN try_cast(t AS DOUBLE) IS NOT NULL THEN 'float'
 WHEN lower(t) IN ('true', 't', 'yes', 'y', '1', 'false', 'f', 'no', 'n', '0') THEN 'boolean' ELSE 'string' END AS member FROM s""")
def q26_union_first_match(spark, sf_dir):
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.get_json_object("props", "$.k")).when(k == 1, F.col("value").cast("string")).when(k == 2, "yes").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", variants.union(t, ["integer", "float", "boolean", "string"]).member.alias("member"))


@query("""
SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN event_type END AS type, CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN event_type = 'error' THEN CAST(props->>'k' AS BIGINT) END AS error_code FROM events""")
def q27_polymorphic_dispatch(spark, sf_dir):
    types = {"purchase": {"amount": F.col("value")}, "error": {"code": casts.integer(F.get_json_object("props", "$.k"))}}
    got = table(spark, sf_dir, "events").select("event_id", variants.polymorphic(F.col("event_type"), types).alias("p"))
    return got.select("event_id", "p.type", F.col("p.purchase_amount").alias("amount"), F.col("p.error_code").alias("error_code"))


@query("""
SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END + CASE WHEN toxic IS NULL THEN 0 ELSE 1 END + CASE WHEN lang IS NULL OR lang = '' THEN 0 ELSE 1 END AS n,
 (CASE WHEN quality IS NULL THEN 0 ELSE 1 END + CASE WHEN toxic IS NULL THEN 0 ELSE 1 END + CASE WHEN lang IS NULL OR lang = '' THEN 0 ELSE 1 END) BETWEEN 2 AND 3 AS valid
FROM documents LEFT JOIN labels USING (doc_id)""")
def q28_choice_count(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = {"quality": "int", "toxic": "int", "lang": "string"}
    broken = validate.choice("labels", fields, 2, 3).broken
    return rows.select("doc_id", validate.present_count(fields).alias("n"), (~broken).alias("valid"))


@query("SELECT event_id, user_id, event_type, value, CAST(props->>'k' AS BIGINT) AS k FROM events")
def q29_json_roundtrip(spark, sf_dir):
    inner = Model("Props", (Attribute("k", "integer"),))
    m = Mapping(
        Model("Event", (Attribute("event_id", "integer"), Attribute("user_id", "integer"), Attribute("event_type"), Attribute("value", "float"), Attribute("props", inner))),
        (field_("id", "event_id"), field_("user", "user_id"), field_("type", "event_type"), field_("value", "value"), field_("props", "props", render_nil=True)),
        root="event",
    )
    rows = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "struct<k: bigint>"))
    got = plans.read_frame(plans.write_frame(rows, m), m)
    return got.select("event_id", "user_id", "event_type", "value", "props.k")


@query("SELECT p_partkey, array_to_string(string_split(p_type, ' '), ',') AS joined, len(string_split(p_type, ' ')) AS n FROM part")
def q30_delimited_split_join(spark, sf_dir):
    model = Model("Part", (Attribute("words", collection=True),))
    doc = F.to_json(F.struct(F.col("p_type").alias("type")))
    got = table(spark, sf_dir, "part").select("p_partkey", plans.read(doc, Mapping(model, (field_("type", "words", delimiter=" "),))).alias("m"))
    out = plans.write(F.col("m"), Mapping(model, (field_("type", "words", delimiter=","),)))
    return got.select("p_partkey", F.get_json_object(out, "$.type").alias("joined"), F.size("m.words").alias("n"))


LOCATION = ModelMap((Move("c_custkey", "id"), Move("c_name", "person.name", F.upper, F.initcap), Move("n_name", "person.place.country"), Move("c_mktsegment", "trade")))


@query("SELECT c_custkey AS id, upper(c_name) AS name, n_name AS country, c_mktsegment AS trade FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q31_model_map(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return transform(rows, LOCATION).select("id", "person.name", F.col("person.place.country").alias("country"), "trade")


EX = "http://example.org/"
PREFIXES = {"ex": EX, "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}


def _nation_triples(spark, sf_dir) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    subject = F.concat(F.lit(f"{EX}nation/"), F.col("n_nationkey").cast("string"))
    region = F.concat(F.lit(f"{EX}region/"), F.col("n_regionkey").cast("string"))
    return triples.triples(n, subject, {f"{PREFIXES['rdfs']}label": F.col("n_name"), f"{EX}region": region}, f"{EX}Nation")


@query(f"""
SELECT '{EX}nation/' || n_nationkey AS s, '{triples.TYPE}' AS p, '{EX}Nation' AS o FROM nation
UNION ALL SELECT '{EX}nation/' || n_nationkey, 'http://www.w3.org/2000/01/rdf-schema#label', n_name FROM nation
UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}region', '{EX}region/' || n_regionkey FROM nation""")
def q32_rdf_triples(spark, sf_dir):
    return _nation_triples(spark, sf_dir)


@query(f"SELECT n_nationkey AS id, '{EX}nation/' || n_nationkey AS expanded, 'ex:nation/' || n_nationkey AS compacted, 'no:' || n_name AS unknown FROM nation")
def q33_iri_expand_compact(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    expanded = iri.expand(F.concat(F.lit("ex:nation/"), key), PREFIXES)
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), expanded.alias("expanded"), iri.compact(expanded, PREFIXES).alias("compacted"), iri.expand(F.concat(F.lit("no:"), F.col("n_name")), PREFIXES).alias("unknown")
    )


@query(r"""
WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w, unnest(generate_series(0, len(string_split(p_name, ' ')) - 1)) AS i, p_brand || p_type AS b FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS i, lower(replace(replace(regexp_replace(regexp_replace(b, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '-', '_'), '.', '_')) AS snake,
 CASE WHEN w = '' THEN '' WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' WHEN regexp_matches(w, '[^aeiou]y$') THEN regexp_replace(w, 'y$', '') || 'ies' ELSE w || 's' END AS plural
FROM w""")
def q34_snake_and_plural(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("b"), F.posexplode(F.split(F.lower("p_name"), " ")).alias("i", "w"))
    return rows.select("p_partkey", "i", strings.snake_case(F.col("b")).alias("snake"), strings.pluralize(F.col("w")).alias("plural"))


@query("""
WITH c AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations)
SELECT conv_id, turn, 'first' AS slot FROM c WHERE turn = 0 UNION ALL SELECT conv_id, turn, 'last' FROM c WHERE turn = m
UNION ALL SELECT conv_id, turn, 'middle' FROM c WHERE turn >= 1 AND turn <= m - 1 UNION ALL SELECT conv_id, turn, 'tail' FROM c WHERE turn >= greatest(0, m - 1)""")
def q35_positional_slice(spark, sf_dir):
    rules = {"first": 0, "last": -1, "middle": (1, -2), "tail": (-2, None)}
    return slices(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", rules)


@query("""
WITH w AS (SELECT DISTINCT p_brand AS word FROM part), n AS (SELECT unnest(['Brand#11', 'brand21', 'Band#33', 'Brand55', 'Bnd4']) AS name)
SELECT word, (SELECT arg_min(name, (levenshtein(lower(word), lower(name)), name)) FROM n WHERE levenshtein(lower(word), lower(name)) <= greatest(len(word), len(name)) // 2 + 1) AS suggestion FROM w""")
def q36_levenshtein_suggest(spark, sf_dir):
    names = F.array(*map(F.lit, ["Brand#11", "brand21", "Band#33", "Brand55", "Bnd4"]))
    near = F.filter(names, lambda n: strings.close_enough(F.col("word"), n))
    best = F.array_min(F.transform(near, lambda n: F.struct(strings.edit_distance(F.col("word"), n).alias("d"), n.alias("name")))).getField("name")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("word")).distinct().select("word", best.alias("suggestion"))


# beyond the catalogue: one query for each further group of operators


@query("SELECT p_partkey, len(p_name) AS size, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last, string_split(p_name, ' ')[2] AS second FROM part")
def q37_array_positions(spark, sf_dir):
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.length("p_name").alias("size"), array_at(w, 0).alias("first"), array_at(w, -1).alias("last"), array_at(w, 1).alias("second")
    )


@query("""
SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_totalprice DESC, o_orderkey DESC), ',') AS by_price FROM orders GROUP BY 1""")
def q38_sort_nested_array(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))))
    got = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(items.alias("items"))
    return got.select("o_custkey", F.array_join(F.transform(sort_array_by(F.col("items"), "p", "desc"), lambda x: x.k.cast("string")), ",").alias("by_price"))


@query("""
SELECT l_orderkey, array_to_string(list(p_name ORDER BY l_linenumber, l_partkey), '|') AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def q39_reference_collection(spark, sf_dir):
    keys = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_partkey)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(keys.alias("refs"))
    got = refs.resolve_all(rows, "refs", table(spark, sf_dir, "part"), "p_partkey", "parts", "l_orderkey")
    return got.select("l_orderkey", F.array_join(F.transform("parts", lambda x: x.p_name), "|").alias("parts"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def q40_dangling_references(spark, sf_dir):
    return refs.dangling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 5000"), "c_custkey")


@query("SELECT c_custkey AS id, p.path, p.old, p.new FROM (SELECT c_custkey, unnest([{'path': 'c_name', 'old': c_name, 'new': upper(c_name)}, {'path': 'c_mktsegment', 'old': c_mktsegment, 'new': 'AUTO'}]) AS p FROM customer) WHERE p.old <> p.new AND (p.path = 'c_name' OR p.old = 'AUTOMOBILE')")
def q41_remediation_preview(spark, sf_dir):
    fixes = {"c_name": F.upper("c_name"), "c_mktsegment": F.when(F.col("c_mktsegment") == "AUTOMOBILE", "AUTO").otherwise(F.col("c_mktsegment"))}
    preview = validate.remediate(table(spark, sf_dir, "customer"), fixes, "c_custkey")[1]
    return preview.withColumnRenamed("row_id", "id")


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders), b AS (SELECT o_orderkey - 1 AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
 p AS (SELECT coalesce(a.id, b.id) AS id, a.status AS s, b.status AS t, a.priority AS p, b.priority AS q FROM a FULL JOIN b ON a.id = b.id)
SELECT id, 'status' AS path, CASE WHEN s IS NULL THEN 'added' WHEN t IS NULL THEN 'removed' ELSE 'changed' END AS op, s AS old, t AS new FROM p WHERE s IS DISTINCT FROM t
UNION ALL SELECT id, 'priority', CASE WHEN p IS NULL THEN 'added' WHEN q IS NULL THEN 'removed' ELSE 'changed' END, p, q FROM p WHERE p IS DISTINCT FROM q""")
def q42_diff_table(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rest = [F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")]
    return diff.differences(o.select(k.alias("id"), *rest), o.select((k - 1).alias("id"), *rest), "id").drop("index")


@query(f"SELECT '{EX}nation/' || n_nationkey AS s, n_name AS label, '{EX}region/' || n_regionkey AS region FROM nation")
def q43_triple_match(spark, sf_dir):
    return triples.match(_nation_triples(spark, sf_dir), {f"{PREFIXES['rdfs']}label": "label", f"{EX}region": "region"})


@query(f"SELECT '{EX}region/' || r_regionkey AS s, '{EX}code' AS p, CAST(r_regionkey AS VARCHAR) AS o, '{iri.XSD}integer' AS datatype FROM region UNION ALL SELECT '{EX}region/' || r_regionkey, '{PREFIXES['rdfs']}label', r_name || ' \"x\"', NULL FROM region")
def q44_turtle_roundtrip(spark, sf_dir):
    subject = F.concat(F.lit(f"{EX}region/"), F.col("r_regionkey").cast("string"))
    label = F.concat(F.col("r_name"), F.lit(' "x"'))
    written = triples.turtle(table(spark, sf_dir, "region"), subject, {f"{EX}code": (F.col("r_regionkey"), "int"), f"{PREFIXES['rdfs']}label": (label, "string")})
    return triples.read_turtle(written).drop("lang")


@query(f"SELECT '{EX}nation/' || n_nationkey AS id, 'Nation' AS type, n_name AS label FROM nation")
def q45_json_ld(spark, sf_dir):
    subject = F.concat(F.lit(f"{EX}nation/"), F.col("n_nationkey").cast("string"))
    docs = triples.json_ld(table(spark, sf_dir, "nation"), subject, "Nation", {"label": f"{PREFIXES['rdfs']}label"}, {"label": F.col("n_name")})
    return docs.select(F.get_json_object("value", "$['@id']").alias("id"), F.get_json_object("value", "$['@type']").alias("type"), F.get_json_object("value", "$.label").alias("label"))


@query("SELECT o_custkey, CAST(CAST(sum(CAST(o_orderkey AS BIGINT)) AS BIGINT) AS BIGINT) AS value FROM orders GROUP BY 1")
def q46_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return Collection(rows, ["o_orderkey"]).fold("o_orderkey", F.lit(0).cast("bigint"), lambda a, x: a + x, "o_custkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 25")
def q47_first_of_sorted(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return Collection(rows, ["c_custkey"]).sort("c_acctbal", "desc").limit(25)


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def q48_xml_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    got = text.from_xml(text.to_xml(rows, "nation"), "value", "_id int, name string, region int")
    return got.select(F.col("value._id").alias("id"), "value.name", "value.region")


def _roundtrip(spark, sf_dir, fmt: str) -> DataFrame:
    model = Model("Part", (Attribute("id", "integer"), Attribute("name"), Attribute("size", "integer"), Attribute("words", collection=True)))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size"), F.split("p_type", " ").alias("words"))
    docs = documents.write_text(plans.write_frame(rows, Mapping(model), fmt, "json", ("id",)), fmt)
    back = documents.parse(docs, fmt, "json", "id")
    got = plans.read_frame(back, Mapping(model), "json")
    return got.select("id", "name", "size", F.array_join("words", " ").alias("type"))


PART_SQL = "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, p_type AS type FROM part"


@query(PART_SQL)
def q49_yaml_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "yaml")


@query(PART_SQL)
def q50_toml_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "toml")


@query("SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INTEGER) AS doc_idx, role, text FROM conversations")
def q51_yaml_stream(spark, sf_dir):
    """All turns of every conversation, as one YAML stream each, read back by document."""
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("json"))
    back = documents.parse(documents.stream(docs, ["turn"], "json", "conv_id"), "yamls", "value", "conv_id")
    return back.select("path", "doc_idx", F.get_json_object("json", "$.role").alias("role"), F.get_json_object("json", "$.text").alias("text"))


@query("SELECT c_custkey AS c_custkey, c_name, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey")
def q52_model_map_reverse(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reverse(transform(rows, LOCATION), LOCATION)


@query("SELECT o_custkey, CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS n, arg_max(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'O') AS last_open FROM orders GROUP BY 1")
def q53_keyed_map(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    got = Collection(rows, ["o_orderkey"]).keyed_map("o_orderstatus", "o_orderkey", "o_custkey")
    return got.select("o_custkey", F.size("map").alias("n"), F.try_element_at("map", F.lit("O")).alias("last_open"))
