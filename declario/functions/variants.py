"""Unions, polymorphism and enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from declario.functions import casts


def conforms(code: str, c: Column) -> Column:
    """Whether text is a lexical form of a union's member. A string always is."""
    s = c.cast("string")
    if code == "integer":
        return s.rlike(r"^\s*[+-]?[0-9]+\s*$")
    if code == "boolean":
        return F.lower(s).isin(casts.TRUE_WORDS + casts.FALSE_WORDS)
    if code in ("float", "double", "decimal"):
        d = s.try_cast("double")
        return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    if code == "string":
        return s.isNotNull()
    return casts.cast(code, c).isNotNull()


def union(c: Column, members: list[str]) -> Column:
    """The first member that conforms: a struct of ``member`` and a field per member."""
    if "string" in members[:-1]:
        raise ValueError("string must be the last member of a union")
    member = F.lit(None).cast("string")
    for code in reversed(members):
        member = F.when(conforms(code, c), code).otherwise(member)
    trimmed = F.trim(c.cast("string"))
    fields = [F.when(member == code, casts.cast(code, c if code == "string" else trimmed)).alias(code) for code in members]
    return F.struct(member.alias("member"), *fields)


def member_keys_fit(text: Column, names: list[str]) -> Column:
    """Whether a JSON object's keys are all among a model member's mapped names."""
    keys = F.json_object_keys(text)
    return keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0)


def polymorphic(tag: Column, types: dict[str, dict[str, Column]]) -> Column:
    """A superset struct: ``type`` and each subtype's own fields where the tag names it."""
    fields = [
        F.when(tag == value, expr).alias(f"{value}_{name}") for value, own in types.items() for name, expr in own.items()
    ]
    return F.struct(F.when(tag.isin(list(types)), tag).alias("type"), *fields)


def enum(c: Column, values: list[str]) -> Column:
    """The value if it is one of ``values``, else null."""
    return F.when(c.isin(values), c)


def enum_flags(c: Column, values: list[str], kind: str = "string") -> Column:
    """A predicate for each value, of one value or of an array of them."""
    has = lambda v: F.array_contains(c, v) if kind.startswith("array") else c == v
    return F.struct(*(F.coalesce(has(v), F.lit(False)).alias(f"is_{v}") for v in values))
