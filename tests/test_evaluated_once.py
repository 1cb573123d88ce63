"""What a query parses or writes is evaluated once for each row, and by all cores."""

import pytest
from pyspark.sql import functions as F

from declario.operators.shared import items
from declario.queries import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q54_xml_mapping", "q59_xml_rootless_and_cdata"])
def test_documents_are_parsed_once(spark, sf_dir, name):
    assert optimized(QUERIES[name](spark, sf_dir)).count("from_xml(") == 1


def test_items_are_those_of_explode(spark):
    rows = [(1, [3, None, 3]), (2, []), (3, None), (None, [4])]
    df = spark.createDataFrame(rows, "id long, a array<int>")
    got = items(df, "a", "x", "id").select("id", "x").collect()
    assert sorted(got, key=str) == sorted(df.select("id", F.explode("a").alias("x")).collect(), key=str)


@pytest.mark.parametrize("name", ["q49_yaml_roundtrip", "q50_toml_roundtrip"])
def test_documents_are_dealt_to_all_cores(spark, sf_dir, name):
    """The table is one file of one row group, which one task would read and round-trip."""
    where = QUERIES[name](spark, sf_dir).withColumn("at", F.spark_partition_id())
    counts = [r["count"] for r in where.groupBy("at").count().collect()]
    assert len(counts) >= spark.sparkContext.defaultParallelism and max(counts) <= 2 * min(counts)
