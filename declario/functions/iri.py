"""IRIs, literals and language tags of linked data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
#: Spark type: datatype of its literals. Strings have none.
DATATYPES = {"bigint": "integer", "int": "integer", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}


def expand(c: Column, prefixes: dict[str, str]) -> Column:
    """``prefix:local`` with the prefix's IRI; an unknown prefix stays."""
    at = F.instr(c, ":")
    prefix, local = F.substr(c, F.lit(1), at - 1), F.substr(c, at + 1)
    out = c
    for p, uri in prefixes.items():
        out = F.when((at > 0) & (prefix == p), F.concat(F.lit(uri), local)).otherwise(out)
    return out


def compact(c: Column, prefixes: dict[str, str]) -> Column:
    """``prefix:local`` by the first namespace that begins the IRI, else null."""
    out = F.lit(None).cast("string")
    for p, uri in reversed(prefixes.items()):
        short = F.concat(F.lit(f"{p}:"), F.substr(c, F.lit(len(uri) + 1)))
        out = F.when(F.startswith(c, F.lit(uri)), short).otherwise(out)
    return out


def escape(c: Column) -> Column:
    out = c
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(written))
    return out


def literal(c: Column, kind: str = "string", lang: Column | None = None) -> Column:
    """A Turtle literal with its language or datatype."""
    quoted = F.concat(F.lit('"'), escape(c.cast("string")), F.lit('"'))
    if lang is not None:
        return F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).otherwise(quoted)
    if kind in DATATYPES:
        return F.concat(quoted, F.lit(f"^^<{XSD}{DATATYPES[kind]}>"))
    return quoted


def resource(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))
