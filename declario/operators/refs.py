"""References: keys of other collections, resolved by joins.

The target is cut to one row per key first (the last in order wins, null keys
aren't indexed), so a resolved column that nobody selects costs no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declario.operators.collection import Collection


def target_of(target: DataFrame, key: str, ord_: list[str]) -> DataFrame:
    """(_key, _row): each key's last row."""
    index = Collection(target.where(F.col(key).isNotNull()), ord_).index(key, "_key")
    return index.select("_key", F.struct(*target.columns).alias("_row"))


def resolve(df: DataFrame, key: str, target: DataFrame, target_key: str, into: str, ord_: list[str] | None = None) -> DataFrame:
    """``df`` with the referenced row as struct ``into``, null if there is none."""
    build = target_of(target, target_key, ord_ or [target_key]).withColumnRenamed("_row", into)
    return df.join(build, df[key] == build["_key"], "left").drop("_key")


def resolve_all(
    df: DataFrame, keys: str, target: DataFrame, target_key: str, into: str, row_id: str, ord_: list[str] | None = None
) -> DataFrame:
    """An array of keys to an array of rows, in the order of the keys, null where
    unresolved; an empty array stays empty and a null one null.

    ``row_id`` says which keys belong together; rows that share it, or have none,
    are told apart by their keys, and rows with the same of both get the same.
    """
    build = target_of(target, target_key, ord_ or [target_key])
    each = df.select(F.col(row_id).alias("_id"), F.col(keys).alias("_keys"), F.posexplode(keys).alias("_pos", "_ref"))
    found = each.join(build, F.col("_ref") == F.col("_key"), "left").groupBy("_id", "_keys").agg(F.array_sort(F.collect_list(F.struct("_pos", "_row"))).alias("_all"))
    # Equal rows bring each place as often as there are of them.
    one = F.transform("_keys", lambda _, i: F.get("_all", i * (F.size("_all") / F.size("_keys")).cast("int"))["_row"])
    found = found.select("_id", "_keys", one.alias(into))
    same = df[row_id].eqNullSafe(found["_id"]) & (df[keys] == found["_keys"])
    empty = F.when(F.size(df[keys]) == 0, F.array().cast(found.schema[into].dataType))
    return df.join(found, same, "left").withColumn(into, F.coalesce(F.col(into), empty)).drop("_id", "_keys")


def dangling(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose reference resolves to nothing."""
    return df.where(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
