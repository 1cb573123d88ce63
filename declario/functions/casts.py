"""Value types: how text becomes a value and a value becomes text.

A cast that fails gives null, with two exceptions: a float reads the longest
numeric prefix and is 0.0 without one; a boolean that is neither a yes nor a no
word is null here, and raw_boolean() keeps its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]
FLOAT_PREFIX = r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})\s*$"
#: Fixed value: only seconds have a fraction.
DURATION = r"^P(?:([0-9]+)Y)?(?:([0-9]+)M)?(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?$"
PARTS = ["years", "months", "days", "hours", "minutes", "seconds"]


def text(c: Column) -> Column:
    return c.cast("string")


def integer(c: Column) -> Column:
    """Leading 0 and octal digits: octal. Decimal or exponent: cut, not rounded."""
    s = text(c)
    return (
        F.when(F.lower(s) == "true", F.lit(1).cast("bigint"))
        .when(F.lower(s) == "false", F.lit(0).cast("bigint"))
        .when(s.rlike(r"^0[0-7]+$"), F.conv(s, 8, 10).try_cast("bigint"))
        .when(s.rlike(r"^-?[0-9]+([.][0-9]+)?([eE]-?[0-9]+)?$"), s.try_cast("double").try_cast("bigint"))
        .otherwise(s.try_cast("bigint"))
    )


def real(c: Column) -> Column:
    s = text(c)
    found = F.regexp_extract(s, FLOAT_PREFIX, 1).try_cast("double")
    return F.when(s.isNotNull(), F.coalesce(found, F.lit(0.0)))


def decimal(c: Column) -> Column:
    return text(c).try_cast("decimal(38,18)")


def boolean(c: Column) -> Column:
    s = F.lower(text(c))
    return F.when(s.isin(TRUE_WORDS), True).when(s.isin(FALSE_WORDS), False)


def raw_boolean(c: Column) -> Column:
    """The text that boolean() can't read, else null."""
    return F.when(boolean(c).isNull(), text(c))


def date(c: Column) -> Column:
    return F.substring(text(c), 1, 10).try_cast("date")


def date_time(c: Column) -> Column:
    return F.try_to_timestamp(text(c))


def zone(c: Column) -> Column:
    """The zone at the end, kept beside a date or time because casts normalise it."""
    return F.nullif(F.regexp_extract(text(c), ZONE, 1), F.lit(""))


def zone_seconds(c: Column) -> Column:
    z = zone(c)
    sign = F.when(F.startswith(z, F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(z, "[^0-9]", "")
    value = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    return F.when(z == "Z", 0).otherwise(sign * value)


def time_of_day(c: Column) -> Column:
    """HH:mm:ss; hours from 24 on are null; fractions are dropped."""
    s = F.regexp_extract(text(c), r"([0-9]{1,2}:[0-9]{2}:[0-9]{2})", 1)
    hour = F.substring_index(s, ":", 1).try_cast("int")
    return F.when((s != "") & (hour < 24), F.lpad(s, 8, "0"))


def duration(c: Column) -> Column:
    return F.when(text(c).rlike(DURATION), text(c))


def duration_parts(c: Column) -> Column:
    one = lambda i: F.coalesce(F.regexp_extract(text(c), DURATION, i).try_cast("double"), F.lit(0.0))
    parts = F.struct(*(one(i + 1).alias(p) for i, p in enumerate(PARTS)))
    return F.when(text(c).rlike(DURATION), parts)


def qname(c: Column) -> Column:
    """struct(prefix, local), cut at the first colon."""
    s, at = text(c), F.instr(text(c), ":")
    prefix = F.when(at > 0, F.substr(s, F.lit(1), at - 1))
    return F.when(s.isNotNull(), F.struct(prefix.alias("prefix"), F.when(at > 0, F.substr(s, at + 1)).otherwise(s).alias("local")))


def symbol(c: Column) -> Column:
    return F.nullif(F.regexp_replace(text(c), "^:(.+):$", "$1"), F.lit(""))


#: Type code: (Spark type, cast).
TYPES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "string": ("string", text),
    "integer": ("bigint", integer),
    "float": ("double", real),
    "double": ("double", real),
    "decimal": ("decimal(38,18)", decimal),
    "boolean": ("boolean", boolean),
    "date": ("date", date),
    "date_time": ("timestamp", date_time),
    "time": ("timestamp", date_time),
    "time_without_date": ("string", time_of_day),
    "duration": ("string", duration),
    "uri": ("string", text),
    "qname": ("struct<prefix: string, local: string>", qname),
    "base64_binary": ("string", text),
    "hex_binary": ("string", text),
    "hash": ("variant", lambda c: F.try_parse_json(text(c))),
    "symbol": ("string", symbol),
    "reference": ("string", text),
}


def register_type(code: str, kind: str, read: Callable[[Column], Column], write: Callable[[Column, str], Column] | None = None) -> None:
    """A value type of one's own: its Spark type, its cast, and how it is written
    (a function of the value and the format; plain text if there is none)."""
    TYPES[code] = (kind, read)
    if write is not None:
        WRITERS[code] = write


#: Types of one's own: how they are written.
WRITERS: dict[str, Callable[[Column, str], Column]] = {}


def cast(code: str, c: Column) -> Column:
    return TYPES[code][1](c)


def _plain(c: Column) -> Column:
    """A decimal without exponent and without trailing zeros, at least one decimal."""
    return F.regexp_replace(F.regexp_replace(text(c), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ".0")


def _stamp(c: Column) -> Column:
    """ISO text in the session zone, fraction of three digits or as many as needed."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    digits = F.when(F.endswith(fraction, F.lit("000")), F.substring(fraction, 1, 3)).otherwise(F.rtrim(fraction, F.lit("0")))
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), digits)), F.lit("+00:00"))


def serialize(code: str, c: Column, fmt: str = "json") -> Column:
    """The text of a value in a format (json, yaml, toml, xml or hash)."""
    if code in WRITERS:
        return WRITERS[code](c, fmt)
    if code == "decimal":
        return _plain(c)
    if code == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if code in ("date_time", "time"):
        stamp = _stamp(c)
        return F.regexp_replace(stamp, r"\+00:00$", "Z") if fmt == "xml" else stamp
    if code == "time_without_date":
        return F.concat(c, F.lit(".000")) if fmt == "toml" else c
    if code == "symbol" and fmt in ("json", "xml", "toml"):
        return F.concat(F.lit(":"), c, F.lit(":"))
    if code == "qname":
        return F.concat_ws(":", c["prefix"], c["local"])
    if code == "hash":
        return F.to_json(c)
    return text(c)
