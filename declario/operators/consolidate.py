"""Consolidation: group and route, and chunks of an ordered stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declario.operators import shared
from declario.operators.collection import order_key


@dataclass(frozen=True)
class Dispatch:
    """Items go to the attribute that their discriminator names; the last wins."""

    by: str
    routes: dict[str, str]
    value: str | None = None  # this field instead of the whole item


@dataclass(frozen=True)
class Grouping:
    by: str
    ord: list[str]
    gather: dict[str, str] = field(default_factory=dict)  # attribute: source field of the first item
    dispatch: Dispatch | None = None


def consolidate(df: DataFrame, g: Grouping) -> DataFrame:
    """One row per value of ``by`` (null is one), with ``first_seen`` for ordering.

    All attributes come from one aggregation, so there is one shuffle.
    """
    at = order_key(df, g.ord)
    columns = [F.min(at).alias("first_seen")]
    columns += [F.min_by(source, at).alias(name) for name, source in g.gather.items()]
    if g.dispatch:
        item = F.col(g.dispatch.value) if g.dispatch.value else F.struct(*df.columns)
        for value, name in g.dispatch.routes.items():
            hit = F.col(g.dispatch.by) == value
            columns.append(F.max_by(F.when(hit, item), F.when(hit, at)).alias(name))
    return df.groupBy(g.by).agg(*columns)


def chunk(
    tokens: DataFrame, kind: str, value: str, ord_: list[str], trigger: str, routes: dict[str, str], content: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """Cut a token stream into chunks, each opened by ``trigger``.

    ``routes`` maps token kinds to attributes (the last token of a kind wins);
    tokens of kind null are text for ``content``, joined, blanks skipped; other
    kinds are ignored; text before the first mapped token is dropped; any mapped
    token opens a chunk if none is open. Streams are the groups of ``by``; without
    it all tokens are one stream, which is dealt to tasks by ranges of its order:
    each task counts its own part, and the counts of the parts before are added.
    """
    mapped = F.col(kind).isin(list(routes))
    rows = tokens.where(mapped | (F.col(kind).isNull() & (F.trim(value) != "")) if content else mapped)
    opens = F.col(kind) == trigger
    if by:
        w = Window.partitionBy(*by).orderBy(*ord_)
        rows = rows.withColumn("chunk", F.count_if(opens).over(w)).withColumn("_seen", F.count_if(mapped).over(w))
    else:
        rows = shared.written(rows.repartitionByRange(*ord_).withColumn("_part", F.spark_partition_id()))
        w = Window.partitionBy("_part").orderBy(*ord_)
        parts = rows.groupBy("_part").agg(F.count_if(opens).alias("_c"), F.count_if(mapped).alias("_s"))  # a row for each task
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_c", "_s")))
        rows = rows.withColumn("chunk", F.count_if(opens).over(w)).withColumn("_seen", F.count_if(mapped).over(w)).join(F.broadcast(parts), "_part")
        rows = rows.withColumn("chunk", F.col("chunk") + F.col("_c")).withColumn("_seen", F.col("_seen") + F.col("_s")).drop("_part", "_c", "_s")
    rows = rows.where("_seen > 0")
    at = order_key(rows, ord_)
    columns = [F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, at)).alias(name) for k, name in routes.items()]
    if content:
        texts = F.array_sort(F.collect_list(F.when(F.col(kind).isNull(), F.struct(at.alias("o"), F.col(value).alias("v")))))
        columns.append(F.array_join(F.transform(texts, lambda x: x.v), "").alias(content))
    return rows.groupBy(*(by or []), "chunk").agg(*columns)
