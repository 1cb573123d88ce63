import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.operators import consolidate, diff, refs, triples, validate
from declario.operators.collection import Collection, array_put, sort_array_by
from declario.streaming import live


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a", 5.0), (2, None, 3.0), (3, "a", None), (4, "b", 3.0), (5, None, 1.0)], "o int, k string, v double")


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_sort_position_and_index(rows):
    c = Collection(rows, ["o"])
    assert [o for (o,) in values(c.sort("v"), "o")] == [5, 2, 4, 1, 3]
    assert [o for (o,) in values(c.sort("v", "desc"), "o")] == [3, 1, 4, 2, 5]
    assert values(c.at(0), "o") == [(1,)] and values(c.at(-2), "o") == [(4,)]
    assert sorted(values(c.index("k"), "key", "o"), key=str) == [("a", 3), ("b", 4), (None, 5)]
    assert values(c.fetch("k", None), "o") == [(5,)]
    assert sorted(values(c.keyed("k"), "k", "o")) == [("a", 3), ("b", 4)]
    assert values(c.find(F.col("v") == 3), "o") == [(2,)]
    assert c.reject(F.col("k") == "a").df.count() == 3
    assert c.put(F.col("o") == 1, v=F.lit(9.0)).df.where("v = 9").count() == 1


def test_sets(spark):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "x int")
    c = Collection(df([1, 1, 2, 3, None, None]), ["x"])
    assert sorted(values(c.union(df([3, 4])), "x"), key=str) == [(1,), (2,), (3,), (4,), (None,)]
    assert values(c.intersection(df([1, 1, 9])), "x") == [(1,)]
    assert sorted(values(c.difference(df([2, 3])), "x"), key=str) == [(1,), (1,), (None,), (None,)]
    assert c.difference(df([None])).count() == 4


def test_references(spark):
    people = spark.createDataFrame([(1, "x", "old"), (2, "x", "new"), (3, None, "none"), (4, "y", "why")], "o int, id string, name string")
    books = spark.createDataFrame([(1, "x", ["y", "z", "x"]), (2, None, []), (3, "z", None)], "b int, author string, others array<string>")
    got = refs.resolve(books, "author", people, "id", "who", ["o"]).orderBy("b")
    assert [r.who and r.who.name for r in got.collect()] == ["new", None, None]
    many = refs.resolve_all(books, "others", people, "id", "all", "b", ["o"]).orderBy("b").collect()
    assert [x and x.name for x in many[0].all] == ["why", None, "new"]
    assert values(refs.dangling(books, "author", people, "id"), "b") == [(3,)]


def test_consolidate_and_chunks(spark):
    t = spark.createDataFrame([(1, "en", "title", "A"), (2, "fr", "title", "B"), (3, "en", "title", "C"), (4, "en", "alt", "D")], "o int, lang string, kind string, text string")
    g = consolidate.Grouping("lang", ["o"], {"first": "text"}, consolidate.Dispatch("kind", {"title": "title", "alt": "alt"}, "text"))
    assert values(consolidate.consolidate(t, g).orderBy("first_seen"), "lang", "first", "title", "alt") == [("en", "A", "C", "D"), ("fr", "B", "B", None)]
    tokens = [(1, None, "lost"), (2, "note", "n0"), (3, None, " "), (4, "term", "t1"), (5, None, "x"), (6, "note", "n1"), (7, "other", "?"), (8, None, "y"), (9, "note", "n2"), (10, "term", "t2")]
    df = spark.createDataFrame(tokens, "o int, kind string, v string")
    got = consolidate.chunk(df, "kind", "v", ["o"], "term", {"term": "term", "note": "note"}, "text").orderBy("chunk")
    assert values(got, "chunk", "term", "note", "text") == [(0, None, "n0", ""), (1, "t1", "n2", "xy"), (2, "t2", None, "")]


def test_scores(spark):
    schema = T._parse_datatype_string("s string, n bigint, b boolean, l array<int>, m struct<a: int>, p array<struct<a: int, c: int>>")
    a = spark.createDataFrame([("x", 1, True, [1, 2], (1,), [(1, 1)])], schema).select(F.struct("*").alias("a"))
    b = spark.createDataFrame([("y", None, False, [1, 3, 4], (2,), [(1, 2)])], schema).select(F.struct("*").alias("b"))
    pair = a.crossJoin(b)  # one row each
    each = [diff.attribute_score(F.col(f"a.{f.name}"), F.col(f"b.{f.name}"), f.dataType).alias(f.name) for f in schema.fields]
    assert list(pair.select(*each).first()) == [0.5, 1.0, 1.0, 0.5, 0.5, 0.25]
    assert pair.select(diff.object_score(F.col("a"), F.col("b"), schema).alias("s")).first().s == pytest.approx(3.75 / 6)
    flat = T._parse_datatype_string("n bigint, b boolean, m bigint")
    x = spark.createDataFrame([(1, True, 4)], flat).select(F.struct("*").alias("a")).crossJoin(spark.createDataFrame([(None, True, 4)], flat).select(F.struct("*").alias("b")))
    assert x.select(diff.object_score(F.col("a"), F.col("b"), flat, integer_mean=True).alias("s")).first().s == 0.0
    empty = x.select(diff.array_score(F.array().cast("array<int>"), F.array().cast("array<int>"), T.IntegerType()).alias("s"))
    assert empty.first().s == 0.0


def test_differences(spark):
    a = spark.createDataFrame([(1, "x", [1, 2]), (2, "y", [])], "id int, s string, l array<int>")
    b = spark.createDataFrame([(1, "z", [1, 3, 4]), (3, "w", [])], "id int, s string, l array<int>")
    got = sorted(values(diff.differences(a, b, "id"), "id", "path", "index", "op", "old", "new"), key=str)
    assert got == sorted([(1, "l", 1, "changed", "2", "3"), (1, "l", 2, "added", None, "4"), (1, "s", None, "changed", "x", "z"), (2, "s", None, "removed", "y", None), (3, "s", None, "added", None, "w")], key=str)
    assert sorted(values(diff.score_pairs(a, b, "id"), "id", "score")) == [(1, pytest.approx((0.5 + (0.5 + 1) / 3) / 2)), (2, 1.0), (3, 1.0)]


def test_rules(spark):
    df = spark.createDataFrame([(1, "", ["a", "b"], 5), (2, "line\nEND", [], 50), (3, None, None, None)], "id int, s string, l array<string>, n int")
    rules = [
        validate.required("s"),
        validate.pattern("s", "^END$"),
        validate.size_between("l", 1, 1),
        validate.number("n", less=10),
        validate.one_of("n", [5]),
        validate.choice("any", {"s": "string", "l": "array", "n": "int"}, 2, 3),
        validate.in_sequence("l", ["b", "a"]),
    ]
    got = sorted(values(validate.issues(df, "id", rules), "row_id", "code"))
    assert got == [
        (1, "collection_size"), (1, "pattern"), (1, "required"), (1, "sequence"),
        (2, "collection_size"), (2, "enum"), (2, "numericality"),
        (3, "choice"), (3, "collection_size"), (3, "required"),
    ]
    with pytest.raises(ValueError):
        validate.raise_issues(validate.issues(df, "id", rules))
    assert validate.report(validate.issues(df, "id", rules)).where("code = 'required'").first().n == 2


def test_profiles(rows):
    seen = []

    def first(df, context):
        context["n"] = df.count()

    def stop(df, context):
        raise validate.Stop

    base = validate.Profile("base", [validate.CollectionRule("count", first)])
    rules = [
        validate.CollectionRule("dup", lambda df, c: validate.unique(df, "k"), if_cond=lambda c: c["n"] > 3),
        validate.CollectionRule("skipped", lambda df, c: seen.append(1), unless_cond=lambda c: True),
        validate.CollectionRule("stop", stop),
        validate.CollectionRule("never", lambda df, c: seen.append(2)),
    ]
    got = validate.Profile("p", rules, [base]).run(rows)
    assert list(got) == ["dup"] and values(got["dup"], "value", "n") == [("a", 2)] and not seen
    base.imports.append(base)
    with pytest.raises(ValueError):
        base.all()


def test_triples(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    t = triples.triples(df, F.concat(F.lit("s:"), "id"), {"p:name": F.col("name")}, "c:T")
    assert sorted(values(t, "s", "o")) == [("s:1", "a"), ("s:1", "c:T"), ("s:2", "c:T")]
    lang = spark.createDataFrame([(1, "en", "a"), (2, "en", "b"), (3, None, "c"), (4, "fr", "d")], "o int, lang string, t string")
    assert triples.language_map(lang, "lang", "t", ["o"]).first().map == {"en": "b", "fr": "d"}


def test_arrays(spark):
    df = spark.createDataFrame([([(2, "b"), (None, "n"), (1, "a")],)], "l array<struct<k: int, v: string>>")
    assert [x.v for x in df.select(sort_array_by(F.col("l"), "k").alias("r")).first().r] == ["a", "b", "n"]
    assert [x.v for x in df.select(sort_array_by(F.col("l"), "k", "desc").alias("r")).first().r] == ["n", "b", "a"]
    assert df.select(array_put(F.array(F.lit(1), F.lit(2)), 1, F.lit(9)).alias("r")).first().r == [1, 9]


def test_stream(spark, sf_dir):
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rules = [validate.number("value", less=20)]
    live.run_once(live.issues(stream, "event_id", rules), "live_issues")
    want = spark.read.parquet(source).where("value >= 20").count()
    assert spark.table("live_issues").count() == want


def test_resolve_all_empty_null_and_shared_ids(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    rows = [(1, [2, 1, 9]), (1, [1]), (1, [1]), (2, []), (3, None), (None, [2]), (4, [1, 1])]
    got = refs.resolve_all(spark.createDataFrame(rows, "id int, keys array<int>"), "keys", target, "k", "found", "id")
    found = [(r["id"], r["keys"], None if r["found"] is None else [x and x["name"] for x in r["found"]]) for r in got.collect()]
    want = [(1, [2, 1, 9], ["b", "a", None]), (1, [1], ["a"]), (1, [1], ["a"]), (2, [], []), (3, None, None), (None, [2], ["b"]), (4, [1, 1], ["a", "a"])]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_read_turtle_prefixes_lists_and_escapes(spark):
    text = """@prefix ex: <http://e.x/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:one a ex:Thing ;
  ex:path "C:\\\\temp\\\\new" , "two. words; \\"so\\""@en ;
  ex:n 5 ; ex:d 1.5 ; ex:ok true .
<http://e.x/two> ex:day "2020-01-02"^^xsd:date ; ex:see ex:one, <http://e.x/a.b> .
"""
    got = {(r["s"], r["p"], r["o"], r["lang"], r["datatype"]) for r in triples.read_turtle(spark.createDataFrame([(text,)], "value string")).collect()}
    x, xsd = "http://e.x/", "http://www.w3.org/2001/XMLSchema#"
    assert got == {
        (x + "one", triples.TYPE, x + "Thing", None, None),
        (x + "one", x + "path", "C:\\temp\\new", None, None),
        (x + "one", x + "path", 'two. words; "so"', "en", None),
        (x + "one", x + "n", "5", None, xsd + "integer"),
        (x + "one", x + "d", "1.5", None, xsd + "decimal"),
        (x + "one", x + "ok", "true", None, xsd + "boolean"),
        (x + "two", x + "day", "2020-01-02", None, xsd + "date"),
        (x + "two", x + "see", x + "one", None, None),
        (x + "two", x + "see", x + "a.b", None, None),
    }


def test_differences_of_nested_models(spark):
    kind = "id int, a string, m struct<x: int, t: array<string>>"
    left = spark.createDataFrame([(1, "p", (1, ["u", "v"])), (2, "q", None), (3, "r", (3, []))], kind)
    right = spark.createDataFrame([(1, "p", (2, ["u", "w", None])), (2, "z", (5, None)), (4, None, None)], kind)
    got = {tuple(r) for r in diff.differences(left, right, "id").collect()}
    assert got == {
        (1, "m.x", None, "changed", "1", "2"),
        (1, "m.t", 1, "changed", "v", "w"),
        (1, "m.t", 2, "added", None, None),
        (2, "a", None, "changed", "q", "z"),
        (2, "m.x", None, "added", None, "5"),
        (3, "a", None, "removed", "r", None),
        (3, "m.x", None, "removed", "3", None),
    }


def test_one_stream_is_numbered_over_tasks(spark):
    rows = [(i, "term" if i % 5 == 0 else "note", f"v{i}") for i in range(1, 200)]
    df = spark.createDataFrame(rows, "o int, kind string, v string").repartition(7)
    got = consolidate.chunk(df, "kind", "v", ["o"], "term", {"term": "term", "note": "note"}).orderBy("chunk").collect()
    want = [(0, None, "v4")] + [(k, f"v{5 * k}", f"v{min(199, 5 * k + 4)}") for k in range(1, 40)]
    assert [tuple(r) for r in got] == want
