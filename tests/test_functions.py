from datetime import date

import pytest
from pyspark.sql import functions as F

from declario.functions import casts, iri, strings, variants


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


INTEGERS = [("007", 7), ("08", 8), ("1.9", 1), ("1e3", 1000), ("-2.7", -2), ("abc", None), ("+5", 5), ("", None), ("true", 1), (None, None), ("99999999999999999999", 9223372036854775807)]


def test_integer(spark):
    got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(INTEGERS)], "i int, v string").select("i", casts.integer(F.col("v")).alias("r"))
    values = {r.i: r.r for r in got.collect()}
    for i, (text, want) in enumerate(INTEGERS[:-1]):
        assert values[i] == want, text
    assert values[len(INTEGERS) - 1] in (None, 9223372036854775807)  # over 64 bits: no exact value


@pytest.mark.parametrize(
    "code,text,want",
    [
        ("float", "3.5abc", 3.5),
        ("float", "abc", 0.0),
        ("float", " -1e2x", -100.0),
        ("boolean", "YES", True),
        ("boolean", "n", False),
        ("boolean", "maybe", None),
        ("date", "2024-02-29Z", date(2024, 2, 29)),
        ("date", "2023-02-29", None),
        ("time_without_date", "25:00:00", None),
        ("time_without_date", "9:05:07.25", "09:05:07"),
        ("duration", "P1Y2M", "P1Y2M"),
        ("duration", "-P1D", None),
        ("symbol", ":ok:", "ok"),
        ("symbol", "", None),
        ("uri", "a b", "a b"),
    ],
)
def test_cast(spark, code, text, want):
    assert one(spark, casts.cast(code, F.col("v")), text) == want


def test_structured_casts(spark):
    assert one(spark, casts.qname(F.col("v")), "a:b:c").asDict() == {"prefix": "a", "local": "b:c"}
    assert one(spark, casts.qname(F.col("v")), "b").asDict() == {"prefix": None, "local": "b"}
    parts = one(spark, casts.duration_parts(F.col("v")), "P1Y2M3DT4H5M6.5S").asDict()
    assert parts == {"years": 1.0, "months": 2.0, "days": 3.0, "hours": 4.0, "minutes": 5.0, "seconds": 6.5}
    assert one(spark, casts.zone_seconds(F.col("v")), "2024-01-01T00:00:00-05:30") == -19800
    assert one(spark, casts.zone_seconds(F.col("v")), "2024-01-01Z") == 0


def test_serialize(spark):
    at = F.col("v").cast("timestamp")
    assert one(spark, casts.serialize("date_time", at), "2024-01-02 03:04:05") == "2024-01-02T03:04:05+00:00"
    assert one(spark, casts.serialize("date_time", at, "xml"), "2024-01-02 03:04:05.5") == "2024-01-02T03:04:05.500Z"
    assert one(spark, casts.serialize("date_time", at), "2024-01-02 03:04:05.123450") == "2024-01-02T03:04:05.12345+00:00"
    assert one(spark, casts.serialize("decimal", casts.decimal(F.col("v"))), "1.50") == "1.5"
    assert one(spark, casts.serialize("decimal", casts.decimal(F.col("v"))), "100") == "100.0"
    assert one(spark, casts.serialize("symbol", F.col("v"), "json"), "a") == ":a:"
    assert one(spark, casts.serialize("symbol", F.col("v"), "yaml"), "a") == "a"


@pytest.mark.parametrize(
    "f,text,want",
    [
        (strings.camel_case, "a_name/b-part", "AName::BPart"),
        (strings.snake_case, "XMLHttpRequest", "xml_http_request"),
        (strings.snake_case, "someName.part-x", "some_name_part_x"),
        (strings.classify, "some name-part", "Some namePart"),
        (strings.classify, "hello_world::foo_bar_baz", "HelloWorld::FooBarBaz"),
        (strings.classify, "hello_world/foo_bar_baz", "HelloWorld::FooBarBaz"),
        (strings.snake_case, "HelloWorld::FooBarBaz", "hello_world/foo_bar_baz"),
        (strings.snake_case, "XMLHttp-Request v1.2", "xml_http_request v1_2"),
        (strings.snake_case, "plain v1.2", "plain v1_2"),
        (strings.pluralize, "", ""),
        (strings.last_of_split, "a:b:", "b"),
        (strings.last_of_split, ":", None),
        (strings.pluralize, "box", "boxes"),
        (strings.pluralize, "city", "cities"),
        (strings.pluralize, "day", "days"),
        (strings.last_of_split, "a:b:c", "c"),
        (strings.base64_encode, "hi", "aGk="),
        (strings.base64_decode, "aGk=", "hi"),
        (strings.base64_decode, "%%", None),
        (strings.hex_encode, "hi", "6869"),
        (strings.hex_decode, "6869", "hi"),
        (strings.uri_valid, "urn:x:y", True),
        (strings.uri_valid, "not a uri", False),
        (strings.pi_attributes, 'a="1" b=\'2\' a="3"', {"a": "3", "b": "2"}),
    ],
)
def test_strings(spark, f, text, want):
    assert one(spark, f(F.col("v")), text) == want


def test_iri(spark):
    prefixes = {"ex": "http://e/", "long": "http://e/long/"}
    assert one(spark, iri.expand(F.col("v"), prefixes), "ex:a:b") == "http://e/a:b"
    assert one(spark, iri.expand(F.col("v"), prefixes), "no:a") == "no:a"
    assert one(spark, iri.compact(F.col("v"), prefixes), "http://e/long/x") == "ex:long/x"
    assert one(spark, iri.compact(F.col("v"), prefixes), "http://other/") is None
    assert one(spark, iri.literal(F.col("v")), 'a"b\\') == '"a\\"b\\\\"'


@pytest.mark.parametrize("text,member", [("12", "integer"), (" 12 ", "integer"), ("1.5", "float"), ("yes", "boolean"), ("NaN", "string"), ("word", "string"), (None, None)])
def test_union(spark, text, member):
    assert one(spark, variants.union(F.col("v"), ["integer", "float", "boolean", "string"]).member, text) == member


def test_union_order():
    with pytest.raises(ValueError):
        variants.union(F.lit("x"), ["string", "integer"])
