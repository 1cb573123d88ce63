"""JSON, JSON Lines and XML through Spark's own readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_documents(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, value): whole files as text; bytes that don't decode become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", encoding).alias("value") if encoding != "UTF-8" else F.make_valid_utf8(F.col("content").cast("string")).alias("value"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One document per file, or an array of documents."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    df.write.option("ignoreNullFields", not keep_nulls).json(path)


def to_json(df: DataFrame, pretty: bool = False, keep_nulls: bool = False) -> DataFrame:
    options = {"pretty": str(pretty).lower(), "ignoreNullFields": str(not keep_nulls).lower()}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("value"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, keep_bad: bool = False) -> DataFrame:
    """Blank lines are skipped and malformed ones dropped, or kept in _corrupt_record."""
    if not keep_bad:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_xml(
    spark: SparkSession, path: str, schema: T.StructType | str, row_tag: str, namespaces: bool = False, xsd: str | None = None
) -> DataFrame:
    """Elements of ``row_tag``; attributes are ``_name``, mixed text is ``_VALUE``.

    Declare scalars as strings to tell an empty element from an absent one, and a
    nested element as a string to get its inner XML.
    """
    reader = spark.read.format("xml").schema(schema).option("rowTag", row_tag).option("ignoreNamespace", not namespaces)
    return (reader.option("rowValidationXSDPath", xsd) if xsd else reader).load(path)


def write_xml(df: DataFrame, path: str, root_tag: str, row_tag: str) -> None:
    df.write.format("xml").option("rootTag", root_tag).option("rowTag", row_tag).save(path)


def to_xml(df: DataFrame, row_tag: str = "ROW") -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row_tag}).alias("value"))


def from_xml(df: DataFrame, column: str, schema: str, namespaces: bool = False) -> DataFrame:
    options = {"ignoreNamespace": str(not namespaces).lower()}
    return df.withColumn(column, F.from_xml(column, schema, options))


def rootless(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Items that follow each other without a root, wrapped in one for reading."""
    return df.withColumn(column, F.from_xml(F.concat(F.lit("<r>"), F.col(column), F.lit("</r>")), schema))


def cdata(c, read: bool = False):
    """Text as a CDATA section, or the text of one."""
    if read:
        return F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
