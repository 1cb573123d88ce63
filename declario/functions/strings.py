"""Names, encodings and tests on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column, kind: str = "string") -> Column:
    """Null, or empty text, array or map. False and 0 are present."""
    if kind == "string":
        return c.isNull() | (c == "")
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def present(c: Column, kind: str = "string") -> Column:
    return ~blank(c, kind)


def _capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))


def camel_case(c: Column) -> Column:
    """``a/b_c-d`` to ``A::BCD``."""
    part = lambda p: F.array_join(F.transform(F.split(p, "[_-]"), _capital), "")
    return F.array_join(F.transform(F.split(c, "/"), part), "::")


def classify(c: Column) -> Column:
    """A class name: words behind ``_``, ``-`` or ``/`` get capitals, a ``/`` becomes
    ``::``, dots go; anything else stays."""
    s = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit("::"), F.lit("/"))
    part = r"([_/-]?)([A-Za-z0-9]*)([^_/-]*)"
    get = lambda i: F.regexp_extract_all(s, F.lit(part), F.lit(i))
    words = F.transform(F.arrays_zip(get(1).alias("mark"), get(2).alias("word"), get(3).alias("rest")), lambda w: F.concat(F.when(w["mark"] == "/", "::").otherwise(""), _capital(w["word"]), w["rest"]))
    return F.array_join(words, "")


def snake_case(c: Column) -> Column:
    """Words split before capitals, acronyms kept whole, hyphens and dots to
    underscores. Text without A-Z, hyphen or ``::`` only loses its dots."""
    s = F.translate(c, ".", "_")
    parts = F.regexp_replace(F.replace(s, F.lit("::"), F.lit("/")), "([A-Z]+)(?=[A-Z][a-z])|([a-z0-9])(?=[A-Z])", "$1$2_")
    return F.when(s.rlike("[A-Z-]|::"), F.lower(F.translate(parts, "-", "_"))).otherwise(s)


def pluralize(c: Column) -> Column:
    return (
        F.when(c == "", c)
        .when(c.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es")))
        .when(c.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(c, "y$", ""), F.lit("ies")))
        .otherwise(F.concat(c, F.lit("s")))
    )


def last_of_split(c: Column, mark: str = ":") -> Column:
    """Empty pieces at the end don't count; null where nothing else is there."""
    return F.nullif(F.substring_index(F.rtrim(c, F.lit(mark)), mark, -1), F.lit(""))


def fetch(members: Column, key: Column | str) -> Column:
    """A map's value by a key given as text or as a symbol (``:name``)."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(members, k), F.try_element_at(members, F.regexp_replace(k, "^:", "")), F.try_element_at(members, F.concat(F.lit(":"), k)))


def base64_encode(c: Column) -> Column:
    return F.base64(c.cast("binary"))


def base64_decode(c: Column) -> Column:
    """Null for what isn't strict base64."""
    return F.try_to_binary(c, F.lit("base64")).cast("string")


def hex_encode(c: Column) -> Column:
    return F.lower(F.hex(c.cast("binary")))


def hex_decode(c: Column) -> Column:
    return F.when(c.rlike("^(?:[0-9a-fA-F]{2})*$"), F.unhex(c).cast("string"))


def uri_valid(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull()


def fpi_to_urn(c: Column) -> Column:
    """A formal public identifier as a urn; anything else stays."""
    body = F.replace(F.replace(F.replace(F.substr(c, F.lit(4)), F.lit("//"), F.lit(":")), F.lit(" "), F.lit("+")), F.lit("::"), F.lit(":"))
    return F.when(F.startswith(c, F.lit("-//")), F.concat(F.lit("urn:publicid:-:"), body)).otherwise(c)


def repair_utf8(c: Column) -> Column:
    """Bytes that aren't UTF-8 are dropped; so is a genuine U+FFFD."""
    return F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))


def pi_attributes(c: Column) -> Column:
    """Pseudo-attributes of a processing instruction as a map; the last of a name wins."""
    pairs = r"""([A-Za-z_][\w.-]*)\s*=\s*["']([^"']*)["']"""
    names, values = F.regexp_extract_all(c, F.lit(pairs), F.lit(1)), F.regexp_extract_all(c, F.lit(pairs), F.lit(2))
    entries = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = F.filter(entries, lambda e, i: F.array_position(F.reverse(names), e["k"]) == F.size(names) - i)
    return F.map_from_entries(last)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def close_enough(a: Column, b: Column) -> Column:
    """At most half the longer word and one more."""
    return edit_distance(a, b) <= F.floor(F.greatest(F.length(a), F.length(b)) / 2) + 1


#: Fixed values that attributes of the XML, XSI and XLink vocabularies allow.
W3C = {
    "xml:space": ["default", "preserve"],
    "xsi:nil": ["true", "false", "1", "0"],
    "xlink:type": ["simple", "extended", "locator", "arc", "resource", "title", "none"],
    "xlink:show": ["new", "replace", "embed", "other", "none"],
    "xlink:actuate": ["onLoad", "onRequest", "other", "none"],
}


def w3c_value(name: str, c: Column) -> Column:
    """The value if the vocabulary allows it, else null; other names take any."""
    return F.when(c.isin(W3C[name]), c) if name in W3C else c
