"""Structural comparison: scores and a long table of differences.

Attribute score: equal 0; arrays by position; same type but unequal 0.5; null
against a value, or true against false, 1. A nested model that differs scores
0.5 flat; models inside arrays are compared attribute by attribute. The object's
score is the mean. Division is true division; ``integer_mean`` floors the mean
where every attribute scored 0 or 1, as integer arithmetic would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(c: Column, kind: T.DataType) -> Column:
    """Maps have no equality; their sorted entries do."""
    return F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c


def attribute_score(a: Column, b: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        both = a.isNotNull() & b.isNotNull()
        return F.when(both, array_score(a, b, kind.elementType)).otherwise(F.when(a.isNull() & b.isNull(), 0.0).otherwise(1.0))
    equal = _comparable(a, kind).eqNullSafe(_comparable(b, kind))
    other = a.isNull() | b.isNull() | F.lit(isinstance(kind, T.BooleanType))
    return F.when(equal, 0.0).when(other, 1.0).otherwise(0.5)


def array_score(a: Column, b: Column, kind: T.DataType) -> Column:
    """By position over the longer array; a missing element scores 1."""
    wrap = lambda arr: F.transform(arr, lambda x: F.struct(x.alias("v")))  # noqa: E731  padding is not a null element

    def one(x: Column, y: Column) -> Column:
        missing = x.isNull() | y.isNull()
        if isinstance(kind, T.StructType):
            score = F.when(x.v.isNull() | y.v.isNull(), F.when(x.v.eqNullSafe(y.v), 0.0).otherwise(1.0)).otherwise(object_score(x.v, y.v, kind))
        else:
            score = attribute_score(x.v, y.v, kind)
        return F.when(missing, 1.0).otherwise(score)

    scores = F.zip_with(wrap(a), wrap(b), one)
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    size = F.greatest(F.size(a), F.size(b))
    return F.when(size > 0, total / size).otherwise(0.0)


def object_score(a: Column, b: Column, kind: T.StructType, integer_mean: bool = False) -> Column:
    scores = [attribute_score(a[f.name], b[f.name], f.dataType) for f in kind.fields]
    if not scores:
        return F.lit(0.0)
    mean = sum(scores[1:], scores[0]) / len(scores)
    if integer_mean:
        whole = F.lit(True)
        for s in scores:
            whole = whole & ((s == 0.0) | (s == 1.0))
        return F.when(whole, F.floor(mean).cast("double")).otherwise(mean)
    return mean


def similarity(score: Column) -> Column:
    return F.round((1 - score) * 100, 2)


def equal(a: Column, b: Column, kind: T.StructType) -> Column:
    out = F.lit(True)
    for f in kind.fields:
        out = out & _comparable(a[f.name], f.dataType).eqNullSafe(_comparable(b[f.name], f.dataType))
    return out


def structural_hash(df: DataFrame) -> Column:
    return F.xxhash64(*(_comparable(F.col(f.name), f.dataType) for f in df.schema.fields))


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, a, b): rows of both sides by key, null where a side has none."""
    one = left.select(F.col(key).alias("_l"), F.struct(*left.columns).alias("a"))
    two = right.select(F.col(key).alias("_r"), F.struct(*right.columns).alias("b"))
    return one.join(two, F.col("_l") == F.col("_r"), "full").select(F.coalesce("_l", "_r").alias(key), "a", "b")


def score_pairs(left: DataFrame, right: DataFrame, key: str, integer_mean: bool = False) -> DataFrame:
    """(key, score, similarity); a row on one side only scores 1."""
    fields = T.StructType([f for f in left.schema.fields if f.name != key])
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    score = F.when(both, object_score(F.col("a"), F.col("b"), fields, integer_mean)).otherwise(1.0)
    return paired(left, right, key).select(key, score.alias("score")).withColumn("similarity", similarity(F.col("score")))


#: One difference.
DIFFERENCE = "array<struct<path: string, index: int, op: string, old: string, new: string>>"


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, path, index, op, old, new): added, removed and changed values.

    One join; nested models are compared attribute by attribute (their paths are
    joined by dots) and arrays by position, the outermost of which is ``index``.
    """
    found = [_differ(f.name, F.lit(None).cast("int"), F.col(f"a.{f.name}"), F.col(f"b.{f.name}"), f.dataType) for f in left.schema.fields if f.name != key]
    return paired(left, right, key).select(key, F.explode(F.concat(*found)).alias("d")).select(key, "d.*")


def _differ(path: str, index: Column, a: Column, b: Column, kind: T.DataType, here: Column | None = None) -> Column:
    """The differences of two values as an array. ``here``: (in a, in b), for
    elements of arrays, where null is a value and not absence."""
    if isinstance(kind, T.StructType):
        return F.concat(*(_differ(f"{path}.{f.name}", index, a[f.name], b[f.name], f.dataType) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        none = F.array().cast(kind)
        wrap = lambda c: F.transform(F.coalesce(c, none), lambda x: F.struct(x.alias("v")))
        pairs = F.zip_with(wrap(a), wrap(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        each = lambda p, i: _differ(path, F.coalesce(index, i), p.x.v, p.y.v, kind.elementType, F.struct(p.x.isNotNull().alias("a"), p.y.isNotNull().alias("b")))
        return F.flatten(F.transform(pairs, each))
    was, is_ = (here.a, here.b) if here is not None else (a.isNotNull(), b.isNotNull())
    op = F.when(~was, "added").when(~is_, "removed").otherwise("changed")
    one = F.struct(F.lit(path).alias("path"), index.alias("index"), op.alias("op"), a.cast("string").alias("old"), b.cast("string").alias("new"))
    same = _comparable(a, kind).eqNullSafe(_comparable(b, kind)) & (was == is_)
    return F.when(same, F.array().cast(DIFFERENCE)).otherwise(F.array(one).cast(DIFFERENCE))
