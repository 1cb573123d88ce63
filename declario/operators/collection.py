"""Ordered collections.

Rows have no order of their own, so a collection names the columns that order
it (``ord``): what is first, last or wins is decided by them. No operator
numbers all rows in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declario.functions import strings


def order_key(df: DataFrame, ord_: list[str]) -> Column:
    return F.struct(*ord_) if len(ord_) > 1 else F.col(ord_[0])


@dataclass(frozen=True)
class Collection:
    df: DataFrame
    ord: list[str]

    # sorting and position

    def sort(self, by: str | Column, order: str = "asc") -> DataFrame:
        """Nulls last; ties in order. Descending is the ascending order reversed."""
        key = F.col(by) if isinstance(by, str) else by
        if order == "desc":
            return self.df.orderBy(key.desc_nulls_first(), *(F.desc(o) for o in self.ord))
        return self.df.orderBy(key.asc_nulls_last(), *self.ord)

    def first(self, n: int = 1) -> DataFrame:
        return self.df.orderBy(*self.ord).limit(n)

    def last(self, n: int = 1) -> DataFrame:
        return self.df.orderBy(*(F.desc(o) for o in self.ord)).limit(n)

    def at(self, i: int) -> DataFrame:
        """One row by position, from the end if negative."""
        if i < 0:
            return self.df.orderBy(*(F.desc(o) for o in self.ord)).offset(-i - 1).limit(1)
        return self.df.orderBy(*self.ord).offset(i).limit(1)

    # filters and maps

    def select(self, where: Column) -> Collection:
        return replace(self, df=self.df.where(where))

    def reject(self, where: Column) -> Collection:
        """Rows where the predicate is null stay."""
        return replace(self, df=self.df.where(~F.coalesce(where, F.lit(False))))

    def find(self, where: Column) -> DataFrame:
        return self.df.where(where).orderBy(*self.ord).limit(1)

    def map(self, *columns: Column | str) -> DataFrame:
        return self.df.select(*columns)

    def flat_map(self, array: str | Column, name: str, *keep: str) -> DataFrame:
        return self.df.select(*keep, F.explode(array).alias(name))

    def fold(self, value: str | Column, start: Column, merge, *by: str) -> DataFrame:
        """Reduce values in order, by group. For sums and the like use aggregates."""
        listed = F.array_sort(F.collect_list(F.struct(order_key(self.df, self.ord).alias("o"), F.col(value).alias("v") if isinstance(value, str) else value.alias("v"))))
        return self.df.groupBy(*by).agg(F.aggregate(F.transform(listed, lambda x: x.v), start, merge).alias("value"))

    # indexes

    def index(self, key: str | Column, name: str = "key") -> DataFrame:
        """The last row of each key, null included: (key, columns...)."""
        k = (F.col(key) if isinstance(key, str) else key).alias(name)
        rows = self.df.select(k, F.struct(*self.df.columns).alias("row"), order_key(self.df, self.ord).alias("o"))
        return rows.groupBy(name).agg(F.max_by("row", "o").alias("row")).select(name, "row.*")

    def fetch(self, key: str | Column, value) -> DataFrame:
        k = F.col(key) if isinstance(key, str) else key
        return self.df.where(k.eqNullSafe(F.lit(value))).orderBy(*(F.desc(o) for o in self.ord)).limit(1)

    def keyed(self, key: str, skip_empty: list[str] | None = None) -> DataFrame:
        """As an object by key: null keys and empty items go, later rows replace."""
        rows = self.df.where(F.col(key).isNotNull())
        for c in skip_empty or []:
            rows = rows.where(F.col(c).isNotNull())
        return Collection(rows, self.ord).index(key, "_key").drop("_key")

    def keyed_map(self, key: str, value: str | Column, *by: str) -> DataFrame:
        """One map per group, from text of the key to the value; the last of a key wins."""
        v = F.col(value) if isinstance(value, str) else value
        rows = self.df.select(*by, F.col(key).cast("string").alias("_k"), v.alias("_v"), order_key(self.df, self.ord).alias("_o"))
        rows = rows.where("_k IS NOT NULL AND _v IS NOT NULL").groupBy(*by, "_k").agg(F.max_by("_v", "_o").alias("_v"))
        return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("map"))

    # sets

    def union(self, other: DataFrame) -> DataFrame:
        """Distinct rows of both."""
        return self.df.unionByName(other).distinct()

    def intersection(self, other: DataFrame) -> DataFrame:
        return self.df.intersect(other.select(self.df.columns))

    def difference(self, other: DataFrame) -> DataFrame:
        """Rows without a match in ``other``; their duplicates stay."""
        cols = self.df.columns
        right = other.select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(cols))).distinct()
        same = [self.df[c].eqNullSafe(right[f"_r{i}"]) for i, c in enumerate(cols)]
        return self.df.join(right, same, "left_anti")

    # counts and checks

    def count(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("count"))

    def empty(self) -> bool:
        return self.df.isEmpty()

    def duplicates(self, field: str) -> DataFrame:
        """Values that occur more than once; null doesn't count."""
        return self.df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n")).where("n > 1")

    def missing(self, *fields: str) -> DataFrame:
        """How many rows have each field blank, in one pass."""
        kinds = dict(self.df.dtypes)
        return self.df.agg(*(F.count_if(strings.blank(F.col(f), kinds[f])).alias(f) for f in fields))

    def summary(self, value: str, *by: str) -> DataFrame:
        """count, min, max, average and total, the last two to two decimals."""
        return self.df.groupBy(*by).agg(
            F.count(value).alias("count"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.round(F.avg(value), 2).alias("average"),
            F.round(F.sum(value), 2).alias("total"),
        )

    # changes

    def push(self, rows: DataFrame) -> Collection:
        """Rows at the end; they bring their own order columns."""
        return replace(self, df=self.df.unionByName(rows))

    def replace_all(self, rows: DataFrame) -> Collection:
        """Other rows in place of these, brought to the same columns and types."""
        return replace(self, df=Collection.coerce(rows, self.df.schema))

    @staticmethod
    def coerce(rows: DataFrame, schema) -> DataFrame:
        """Rows as items of a type: its columns in order, cast, null where absent."""
        have = set(rows.columns)
        return rows.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))

    def put(self, where: Column, **values: Column) -> Collection:
        """Replace fields of the rows that match, such as a position."""
        cols = {c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}
        return replace(self, df=self.df.withColumns(cols))


def array_at(array: Column, i: int) -> Column:
    """An element by position from 0, from the end if negative, null outside."""
    return F.try_element_at(array, F.lit(i if i < 0 else i + 1))


def array_put(array: Column, i: int, value: Column) -> Column:
    return F.transform(array, lambda x, k: F.when(k == i, value).otherwise(x))


def sort_array_by(array: Column, field: str, order: str = "asc") -> Column:
    """An array of structs sorted by a field, nulls last; descending is reversed."""

    def compare(a: Column, b: Column) -> Column:
        x, y = a[field], b[field]
        return (
            F.when(x.isNull() & y.isNull(), 0)
            .when(x.isNull(), 1)
            .when(y.isNull(), -1)
            .when(x < y, -1)
            .when(x > y, 1)
            .otherwise(0)
        )

    found = F.array_sort(array, compare)
    return F.reverse(found) if order == "desc" else found


def slices(df: DataFrame, group: str, position: str, rules: dict[str, int | tuple[int | None, int | None]]) -> DataFrame:
    """Positional mapping: rows labelled by the rules their place in the group fits.

    A rule is a position, or an inclusive range with open ends; negative counts
    from the end. Positions are 0-based; ranges are clamped to the group.
    """
    sizes = df.groupBy(group).agg(F.max(position).alias("_last"))
    at, last = F.col(position), F.col("_last")
    place = lambda i: F.lit(i) if i >= 0 else last + 1 + i
    labels = []
    for name, rule in rules.items():
        low, high = rule if isinstance(rule, tuple) else (rule, rule)
        fits = F.lit(True)
        if low is not None:
            fits = fits & (at >= (place(low) if not isinstance(rule, tuple) else F.greatest(F.lit(0), place(low)).cast("long")))
        if high is not None:
            fits = fits & (at <= place(high))
        labels.append(F.when(fits, name))
    return df.join(sizes, group).withColumn("slot", F.explode(F.array_compact(F.array(*labels)))).drop("_last")
