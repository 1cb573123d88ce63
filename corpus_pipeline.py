"""A training-data pipeline over documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.

* language: drops documents in no learned language (``und``) or with a score
  below 0.5. The model is trained on the rows of its own input that aren't held
  out, so it can be rerun on any corpus.
* line_dedup: takes later copies of repeated runs of 25 words or more out of the
  texts, corrects n_chars, and drops documents that consist of nothing else.
* near_dedup: one row of each group of near duplicates stays, that of the smallest
  id; repeated rows and copies among rows without id count as such a group, and
  texts that share an id are documents of their own.
* decontaminate: drops documents that hold a 10-word window of a benchmark item.
* sentencepiece: doc_id, lang, source, text, the model's ids, whether they decode
  to the text, and two sampled segmentations with inclusion scores.

Defined results: texts that are null, empty or without letters are in no language
and go at the first stage; rows without id are documents like others; very long
texts are read whole; other columns, whatever their names, pass through all stages
but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declario.llm import decontaminate as dc
from declario.llm import language, lines, minhash, pieces
from declario.llm.common import drop, free_name, materialise, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    languages, logp = language.train(docs)
    out = free_name(docs, "language")
    got = language.identify(docs, languages, logp, out=out)
    return got.where((F.col(out).lang != "und") & (F.col(out).score >= 0.5)).drop(out)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = free_name(docs, "dedup")
    got = lines.dedup_lines(docs, out=out)
    changed = F.col(out).n_removed > 0
    got = got.where(~changed | (F.length("text") > 0))
    return got.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = free_name(docs, "overlap")
    got = dc.decontaminate(docs, table(spark, sf_dir, "benchmark"), out=out)
    return got.where(F.col(out).n_hit == 0).drop(out)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "text", "pieces.*")


STAGES = [
    ("language", by_language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: No SQL: the language model, and sampling, can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made: list[str] = []
    for _, stage in STAGES[:-1]:
        before, made = made, []
        docs = materialise(stage(spark, docs, sf_dir), made)
        drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
