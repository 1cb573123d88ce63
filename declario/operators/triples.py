"""Linked data: rows to triples, triples to Turtle and JSON-LD, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declario.functions import iri
from declario.operators.collection import Collection

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def triples(df: DataFrame, subject: Column, predicates: dict[str, Column], type_: str | None = None) -> DataFrame:
    """(s, p, o): one row per predicate whose value isn't null, in one pass."""
    pairs = [F.when(c.isNotNull(), F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"))) for p, c in predicates.items()]
    if type_:
        pairs.insert(0, F.struct(F.lit(TYPE).alias("p"), F.lit(type_).alias("o")))
    return df.select(subject.alias("s"), F.explode(F.array_compact(F.array(*pairs))).alias("t")).select("s", "t.*")


def match(graph: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Subjects with one column per predicate (the least object if there are several)."""
    rows = graph.where(F.col("p").isin(list(predicates)))
    return rows.groupBy("s").agg(*(F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for p, name in predicates.items()))


def turtle(df: DataFrame, subject: Column, predicates: dict[str, tuple[Column, str]], type_: str | None = None) -> DataFrame:
    """One Turtle statement per row. Kinds of value: a Spark type, or ``iri``."""
    parts = [F.lit(f"a <{type_}>")] if type_ else []
    for p, (c, kind) in predicates.items():
        value = iri.resource(c) if kind == "iri" else iri.literal(c, kind)
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"<{p}> "), value)))
    return df.select(F.concat(iri.resource(subject), F.lit(" "), F.concat_ws(" ;\n    ", *parts), F.lit(" .")).alias("value"))


STRING = r'"(?:[^"\\]|\\.)*+"'
IRI = r"<[^>]*>"
#: A statement up to its dot, a predicate's part up to its semicolon, and a term.
STATEMENT = rf"(?s)((?:{STRING}|{IRI}|[^\s<\".]|(?<=\S)\.(?=[\w])|\s)++)\.(?=\s|$)"
PART = rf"(?s)(?:{STRING}|{IRI}|[^;<\"])++"
TERM = rf"(?s)({IRI}|{STRING}|[^\s,<\"]+)(?:@([A-Za-z][A-Za-z0-9-]*)|\^\^({IRI}|[\w-]*:[\w.-]+))?"
#: Types of numbers and truth values that are written bare.
BARE = {r"^[+-]?[0-9]+$": "integer", r"^[+-]?[0-9]*\.[0-9]+$": "decimal", r"^[+-]?[0-9.]+[eE][+-]?[0-9]+$": "double", "^(?:true|false)$": "boolean"}


def unescape(c: Column) -> Column:
    """The text of a string with Turtle's escapes, backslash pairs first."""
    mark = "\x00"  # can't be written in Turtle
    out = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for raw, written in (("\\t", "\t"), ("\\r", "\r"), ("\\n", "\n"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        out = F.replace(out, F.lit(raw), F.lit(written))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def read_turtle(texts: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(s, p, o, lang, datatype) of Turtle texts, each one statement or a document.

    Read are prefixes, IRIs, prefixed names, strings in quotes with language or
    type, bare numbers and truth values, ``a``, ``;`` and ``,``. Blank nodes,
    collections, bases, comments and long strings aren't.
    """
    head = r"(?i)@?prefix\s+([\w-]*):\s*<([^>]*)>\s*\.?"
    names, iris = (F.regexp_extract_all(column, F.lit(head), F.lit(i)) for i in (1, 2))
    body = F.concat(F.regexp_replace(column, head, ""), F.lit("\n"))
    rows = texts.select(*keep, F.arrays_zip(names.alias("name"), iris.alias("iri")).alias("_names"), F.explode(F.regexp_extract_all(body, F.lit(STATEMENT), F.lit(1))).alias("_statement"))

    def full(term: Column) -> Column:
        """An IRI from <...> or a prefixed name."""
        local = F.substr(term, F.instr(term, ":") + 1)
        base = F.get(F.transform(F.filter("_names", lambda n: n["name"] == F.substring_index(term, ":", 1)), lambda n: n["iri"]), F.lit(0))
        return F.when(F.startswith(term, F.lit("<")), F.substr(term, F.lit(2), F.length(term) - 2)).when(F.instr(term, ":") > 0, F.concat(base, local))

    rows = rows.select(*keep, "_names", F.regexp_extract("_statement", r"^\s*(\S+)", 1).alias("_s"), F.explode(F.regexp_extract_all(F.regexp_replace("_statement", r"^\s*\S+\s", ""), F.lit(PART), F.lit(0))).alias("_part"))
    rows = rows.where(F.trim("_part") != "").withColumn("_p", F.regexp_extract("_part", r"^\s*(\S+)", 1))
    objects = F.regexp_replace("_part", r"^\s*\S+\s", "")
    get = lambda i: F.regexp_extract_all(objects, F.lit(TERM), F.lit(i))
    terms = F.arrays_zip(get(1).alias("term"), get(2).alias("lang"), get(3).alias("kind"))
    rows = rows.select(*keep, "_names", "_s", "_p", F.explode(terms).alias("t")).select(*keep, "_names", "_s", "_p", "t.*")
    quoted = F.startswith("term", F.lit('"'))
    bare = F.lit(None).cast("string")
    for pattern, kind in BARE.items():
        bare = F.when(F.col("term").rlike(pattern), iri.XSD + kind).otherwise(bare)
    text = F.when(quoted, unescape(F.substr("term", F.lit(2), F.length("term") - 2))).when(bare.isNotNull(), F.col("term")).otherwise(full(F.col("term")))
    return rows.select(
        *keep,
        full(F.col("_s")).alias("s"),
        F.when(F.col("_p") == "a", TYPE).otherwise(full(F.col("_p"))).alias("p"),
        text.alias("o"),
        F.nullif("lang", F.lit("")).alias("lang"),
        F.when(quoted, full(F.nullif("kind", F.lit("")))).otherwise(bare).alias("datatype"),
    )


def json_ld(df: DataFrame, subject: Column, type_: str, context: dict[str, str], fields: dict[str, Column]) -> DataFrame:
    """One JSON-LD document per row."""
    ctx = F.struct(*(F.lit(v).alias(k) for k, v in context.items()))
    doc = F.struct(ctx.alias("@context"), subject.alias("@id"), F.lit(type_).alias("@type"), *(c.alias(k) for k, c in fields.items()))
    return df.select(F.to_json(doc).alias("value"))


def language_map(df: DataFrame, lang: str, text: str, ord_: list[str], *by: str) -> DataFrame:
    """Tagged values as {lang: text}; the last of a language wins, untagged ones go."""
    return Collection(df, ord_).keyed_map(lang, text, *by)
