import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_corpus_operators import plain_components, plain_dedup

from declario.llm import language, pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    """Each stage on what its predecessor kept, read again from Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= before.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS and docs.schema == before.schema
        if name == "language":
            assert docs.count() >= 0.98 * before.count()
        if name == "line_dedup":
            long = docs.select(F.explode(F.split("text", "\n")).alias("line")).where("size(split(trim(line), ' +')) >= 25")
            assert long.groupBy(F.trim("line")).count().where("count > 1").count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert docs.where("NOT round_trip").count() == 0


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def hashes(spark, texts):
    """Spark's hash of texts, 0 for null."""
    rows = spark.createDataFrame([(t,) for t in {t for t in texts if t is not None}] or [("",)], "t string")
    return {None: 0} | {r.t: r.h for r in rows.select("t", F.xxhash64("t").alias("h")).collect()}


def keys_of(spark, rows, hash_null=0):
    h = hashes(spark, [r["text"] for r in rows])
    return [(r["doc_id"] is None, r["doc_id"] or 0, h[r["text"]]) for r in rows]


def plain_language(spark, rows, docs):
    languages, logp = language.train(docs)
    kept = []
    for r in rows:
        c = language.normalise(r["text"] or "")
        if len(c):
            total = logp[-1].astype(float) + logp[language.buckets(c, 16)].sum(axis=0, dtype=float)
            if 1 / np.exp(total - total.max()).sum() >= 0.5:
                kept.append(r)
    return kept


def plain_lines(spark, rows):
    keys = keys_of(spark, rows)
    # A repeated key is one document, but for text null, whose hash is Spark's own of null.
    done = plain_dedup(sorted({(k, r["text"]) for k, r in zip(keys, rows, strict=True)}, key=lambda x: x[0]), 25)
    out = []
    for k, r in zip(keys, rows, strict=True):
        text, n = done[k]
        if n == 0:
            out.append(r)
        elif text:
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_near(spark, rows):
    keys = keys_of(spark, rows)
    named = {d: c for d, _, c in plain_components(list(enumerate(r["text"] for r in rows)))}
    groups = {}
    for i, r in enumerate(rows):
        worded = bool((r["text"] or "").split())
        groups.setdefault(("g", named[i]) if worded else ("k", keys[i]), []).append(i)
    order = lambda r: [(r[c] is not None, r[c]) for c in COLUMNS]
    return [rows[min(own, key=lambda i: (keys[i], order(rows[i])))] for own in groups.values()]


def plain_clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[i : i + 10]) for t in items if (w := words(t)) for i in range(max(1, len(w) - 9))}
    sizes = {len(p) for p in windows}
    return [r for r in rows if not any(tuple(w[i : i + n]) in windows for w in [words(r["text"])] for n in sizes for i in range(len(w) - n + 1))]


def test_run_equals_a_plain_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(110)
    own = [r.asDict() for r in docs.collect()]
    a, b = own[0]["text"], own[1]["text"]
    passage = "\n".join(own[2]["text"].split()[i] + " and " + " ".join(f"said{i}x{j}" for j in range(9)) for i in range(4))
    long = "\n".join(" ".join(f"the word{i % 499}of{k} is {i}" for i in range(9_000)) for k in range(5))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("size(split(text, ' ')) > 14").first().text
    extra = [(3, a), (5, a), (5, b), (7, b + " end"), (9, passage), (9, passage), (9, passage), (None, b), (None, "a text of its own without an id, " + a[::-1])]
    extra += [(None, None), (8001, None), (8002, ""), (8003, "12 34"), (8004, long), (8005, long + " more"), (8006, "own words before " + item + " and after")]
    extra += [(8007, "first own line of it\n" + passage), (8008, passage + "\nlast own line of it")]
    own += [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in extra]
    own += [own[-1] | {"source": "other"}]
    frame = spark.createDataFrame([[r[c] for c in COLUMNS] for r in own], docs.select(COLUMNS).schema)
    clash = frame.withColumns({"dedup": F.lit(1), "Language": F.lit("x"), "overlap": F.lit(2), "_th": F.lit(3), "pieces": F.lit("p")})
    clash.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = plain_language(spark, own, frame)
    rows = plain_near(spark, plain_lines(spark, rows))
    rows = plain_clean(rows, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(pieces.default_model()))
    want = sorted(((str(r["doc_id"]), r["lang"], r["source"], r["text"], tuple(sp.encode(r["text"]))) for r in rows), key=str)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in got)
    assert sorted(((str(r.doc_id), r.lang, r.source, r.text, tuple(r.ids)) for r in got), key=str) == want
    assert 8006 not in [r.doc_id for r in got] and len(want) > 60
