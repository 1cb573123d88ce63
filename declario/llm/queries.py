"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declario.llm import decontaminate as dc
from declario.llm import extract, language, lines, minhash, neighbours, pieces, private, quality
from declario.llm import urls
from declario.llm.common import held_out, table


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, keep_text=False).select("doc_id", "pieces.*")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages, logp = language.train(docs)
    got = language.identify(docs.select("doc_id", "text"), languages, logp)
    return got.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "dedup.n_lines", "dedup.n_removed", "text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    got = quality.score(docs, model)
    return got.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = private.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans = private.listed()
    kinds = F.transform("private.base", lambda s: s.kind)
    counts = [F.size(F.filter(kinds, private.is_kind(k))).cast("long").alias(f"n_{k}") for k in private.KINDS]
    every = (F.size("private.base") + F.size("private.terms")).cast("long")
    return got.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), every.alias("n_spans"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return got.select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = dc.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id",
        "overlap.n_words",
        "overlap.n_hit",
        "overlap.n_items",
        "overlap.items_sha256",
        (F.col("overlap.n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_extract": op1_extract,
    "op2_minhash": op2_minhash,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language": op4_language,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_neighbours": op8_neighbours,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
}

_WORDS = r"""list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP10_SQL = rf"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
 win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
   array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
   FROM iw, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
 dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
 occ AS (SELECT d.doc_id, i, s.n, win.item_id FROM
   (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
    FROM dw, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)) d
   JOIN (SELECT DISTINCT n FROM win) s ON s.n = d.n JOIN win ON win.p = d.p AND win.n = d.n),
 hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM
   (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM occ) GROUP BY 1),
 its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM
   (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: Every row is a document of its own, also where an id comes again; rows without id are linked with nothing.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g, len(w) < 5 AS small
   FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
 n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
 k AS (SELECT s.* FROM s JOIN d USING (r) WHERE doc_id IS NOT NULL),
 p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM k a JOIN k b
   ON a.g = b.g AND a.small = b.small AND a.r < b.r GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 t AS (SELECT r, doc_id AS c FROM d WHERE doc_id IS NOT NULL UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, coalesce(d.doc_id = m.c, true) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT r, min(c) AS c FROM t GROUP BY 1) m USING (r)
"""

OP5_SQL = r"""
WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
 y AS (SELECT doc_id, i AS no, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM x,
   LATERAL (SELECT unnest(generate_series(1, len(ls))) AS i)),
 z AS (SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS seq,
   len(list_filter(string_split_regex(line, '\s+'), lambda t: t <> '')) AS w FROM y WHERE line <> ''),
 c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY seq) AS cw FROM z),
 runs AS (
  SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id
   AND b.seq BETWEEN a.seq AND a.seq + 25 AND b.cw - a.cw + a.w >= 25 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.seq), b.seq FROM c a JOIN c b ON a.doc_id = b.doc_id
   AND a.seq BETWEEN b.seq - 25 AND b.seq AND b.cw - a.cw + a.w >= 25 GROUP BY b.doc_id, b.seq),
 whole AS (SELECT doc_id, list(line ORDER BY seq) AS l FROM c GROUP BY 1),
 named AS (SELECT r.*, array_to_string(list_slice(l, s, e), chr(10)) AS k FROM runs r JOIN whole USING (doc_id)),
 firsts AS (SELECT k, min((doc_id, s)) AS f FROM named GROUP BY 1),
 dead AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS seq FROM named JOIN firsts USING (k) WHERE (doc_id, s) <> f),
 gone AS (SELECT c.doc_id, list(no) AS g, count(*) AS n FROM dead JOIN c USING (doc_id, seq) GROUP BY 1),
 total AS (SELECT doc_id, count(*) AS m FROM c GROUP BY 1)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n, 0) AS n_removed,
 CASE WHEN n IS NULL THEN text WHEN n = m THEN '' ELSE array_to_string(list_transform(
  list_filter(generate_series(1, len(ls)), lambda i: NOT list_contains(g, i)), lambda i: ls[i]), chr(10)) END AS text
FROM x LEFT JOIN gone USING (doc_id) LEFT JOIN total USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op2_minhash": OP2_SQL,
    "op10_decontaminate": OP10_SQL,
}
