"""Streams: validation as it arrives, references, windowed reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from declario.operators import shared, validate


def issues(stream: DataFrame, key: str, rules: list[validate.Rule]) -> DataFrame:
    return validate.issues(stream, key, rules)


def windowed_report(found: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Issues per window and code; rows later than ``late`` are dropped."""
    return found.withWatermark(ts, late).groupBy(F.window(ts, width), "code").agg(F.count("*").alias("n"))


def resolve(stream: DataFrame, key: str, target: DataFrame, into: str) -> DataFrame:
    """A stream-static join with a target of refs.target_of()."""
    build = target.withColumnRenamed("_row", into)
    return stream.join(build, stream[key] == build["_key"], "left").drop("_key")


def run_once(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there, then an end; the result is the view ``name``.

    Rows go to Parquet in the shared folder, where the query keeps its own
    checkpoint too; only other modes than append are held in memory.
    """
    spark = df.sparkSession
    writer = df.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True)
    if mode != "append":
        q = writer.format("memory").start()
        q.awaitTermination()
        return q
    at = f"{shared.shared_dir(spark)}/s-{uuid.uuid4().hex}"
    q = writer.format("parquet").option("checkpointLocation", f"{at}/checkpoint").start(f"{at}/rows")
    q.awaitTermination()
    spark.read.schema(df.schema).parquet(f"{at}/rows").createOrReplaceTempView(name)
    return q


def observed(df: DataFrame, name: str, **measures) -> tuple[DataFrame, Observation]:
    """``df`` with measures that are taken while it runs; subscribe() reads them."""
    o = Observation(name)
    return df.observe(o, *(c.alias(n) for n, c in measures.items())), o


def subscribe(o: Observation, *handlers) -> None:
    """Call each handler with the measures, once the frame has run."""
    for h in handlers:
        h(o.get)
