"""Intermediate tables in the folder that driver and executors share; rows of parsed arrays."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is made only where it is unset
    and Spark runs on this machine alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: later uses see the same rows in the
    same partitions, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/c-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def items(df: DataFrame, array: str | Column, name: str, *keep: str | Column, pos: str = "_pos") -> DataFrame:
    """(keep, pos, name): a row for each item of an array, none for null or empty ones.

    A plain explode lets Spark filter by the array's size beforehand: the array's
    expression, a whole document's parse perhaps, goes into filters and join
    conditions under it and is evaluated for each. The outer one is not filtered
    so; its rows without an item go after it.
    """
    each = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return each.where(F.col(pos).isNotNull())
