"""Row-wise operators against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from declario.llm import decontaminate as dc
from declario.llm import extract, language, pieces, private, quality, urls
from declario.llm.common import held_out

LONG = "word and another " * 20000


def rows_of(df):
    return [r.asDict(True) for r in df.collect()]


# extraction

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="ad">Buy this thing now, it is really cheap.</div><article><h1>A big   story</h1><p><b>One &amp; two&nbsp;&lt;3.<br><p>Second
paragraph with enough words to be one.</p><p>Ok.</p></article><section class="comments"><p>A reader says that this is wrong, at length.</p></section>
<form><label>Mail address, please.</label></form><footer>&copy; somebody</footer>"""


def test_main_text():
    assert extract.main_text(PAGE) == "A big story\nOne & two <3.\nSecond paragraph with enough words to be one.\nOk."
    assert extract.main_text("<p>a <i>b</i>c<br>d goes on.</p>x < y <!-- <p>hidden") == "a bc d goes on.\nx < y"
    assert extract.main_text("") == extract.main_text(None) == extract.main_text("<nav><a>x</a></nav>") == ""
    assert extract.main_text("<p>" + LONG + "end.</p>") == LONG + "end."
    assert len(extract.main_text("<div><p>Some words here.</p>" * 3000).split("\n")) == 3000


@pytest.mark.parametrize("seed", range(20))
def test_minimum_cut_is_minimal(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 9))
    gains = rng.normal(0, 2, n).tolist()
    edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

    def cost(kept):
        return sum(g for g, k in zip(gains, kept) if g > 0 and not k) + sum(-g for g, k in zip(gains, kept) if g < 0 and k) + sum(w for a, b, w in edges if kept[a] != kept[b])

    best = min(cost(k) for k in itertools.product([False, True], repeat=n))
    assert cost(extract.minimum_cut(gains, edges)) == pytest.approx(best)


def test_extract_frame(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y"), (1, PAGE, "x")], "id long, html string, main_text string")
    got = rows_of(extract.extract(df))
    assert [r["main_text"] for r in got] == ["x", "y", "x"] and got[1]["main_text_"] == "" and got[0]["main_text_"] == got[2]["main_text_"] != ""
    assert extract.extract(df.limit(0)).count() == 0


# decontamination


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_overlap(text, items, size):
    w, hit, ids = plain_words(text), set(), set()
    for item, t in items:
        iw = plain_words(t)
        for p in {tuple(iw[i : i + size]) for i in range(max(1, len(iw) - size + 1))} if iw else ():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    ids.add(item)
    return len(w), len(hit), sorted(map(str, ids - {None}))


@pytest.mark.parametrize("bound", [1 << 20, 40])
def test_decontaminate(spark, bound):
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(rng.choice(["Ab", "c,d", "é!", "x9", "ZZ"], n))
    items = [(i, say(int(n))) for i, n in enumerate([2, 4, 6, 9, 1])] + [(7, None), (8, "..."), (None, "Ab c,d é! x9 ZZ Ab")]
    texts = [say(int(n)) for n in rng.integers(0, 60, 12)] + [None, "", "!!", LONG]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 1)], "doc_id long, text string, overlap int")
    got = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), window=4, max_block_bytes=bound)
    for r in rows_of(got):
        n, hit, ids = plain_overlap(r["text"], items, 4)
        o = r["overlap_"]
        assert (o["n_words"], o["n_hit"], o["item_ids"]) == (n, hit, ids), r["doc_id"]
        assert o["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert sum(len(plain_words(r["text"][s["start"] : s["end"]])) for s in o["spans"]) == hit
    assert rows_of(dc.decontaminate(docs.limit(0), spark.createDataFrame(items, "item_id long, text string"))) == []
    assert all(r["overlap_"]["n_hit"] == 0 for r in rows_of(dc.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))))


# URLs


def test_urls(spark):
    cases = [
        ("http://a.net", "a.net", "", None),
        ("http://A.NET/x?y", "a.net", "/x", "net/"),
        ("https://m.example.net/en/25#top", "m.example.net", "/en/25", "example.net/en/"),
        ("https://notexample.com/de/1", "notexample.com", "/de/1", None),
        ("http://b.example.com/de/", "b.example.com", "/de/", "example.com/de/"),
        ("x://q.org/fr/a", "q.org", "/fr/a", "org/fr/"),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
        ("http://h?p=/de/", "h", "", None),
        ("http://" + "a" * 50000 + ".net/" + "b" * 50000, "a" * 50000 + ".net", "/" + "b" * 50000, "net/"),
    ]
    df = spark.createDataFrame([(i, c[0], "z") for i, c in enumerate(cases)], "page_id long, url string, url_host string")
    got = {r["page_id"]: r for r in rows_of(urls.filter_urls(df))}
    for i, (_, host, path, rule) in enumerate(cases):
        r = got[i]
        assert (r["url_host_"], r["url_path"], r["url_rule"]) == (host, path, rule) and r["url_host"] == "z"
        if rule:
            assert r["url_verdict"] == dict((b, a) for a, b in urls.RULES)[rule]
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_url_model():
    w, b = urls.train()
    score = lambda u: b + w[f := urls.features(*urls.split_url(u), 14)].sum() / np.sqrt(len(f))
    right = sum((score(u) > 0) == bool(y) for u, y in urls.LABELLED)
    assert right >= 0.95 * len(urls.LABELLED)
    assert score("https://www.casino-win.other.example/en/14") > 0 > score("https://blog.ththan.other.example/en/14")


# language and quality


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages, logp = language.train(docs)
    got = rows_of(language.identify(docs.where(held_out(F.col("doc_id"))), languages, logp))
    assert np.mean([r["language"]["lang"] == r["lang"] for r in got]) >= 0.95
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "123 !?", 0), (4, "the and of that is", 0), (4, "the and of that is", 0), (5, LONG * 4, 0)], "i int, text string, language int")
    found = {r["i"]: r["language_"] for r in rows_of(language.identify(odd, languages, logp))}
    assert all(found[i] == {"lang": "und", "score": 0.0} for i in (1, 2, 3)) and found[4]["lang"] == "en" and 0 < found[4]["score"] <= 1
    none, flat = language.train(docs.limit(0))
    assert none == [] and rows_of(language.identify(odd, none, flat))[3]["language_"]["lang"] == "und"
    assert language.identify(odd.limit(0), languages, logp).count() == 0


def test_language_matches_plain_counts():
    counts = Counter()
    c = language.normalise("Ab, c")
    assert "".join(map(chr, c)) == " ab c "
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            counts[tuple(c[i : i + n])] += 1
    assert sum(counts.values()) == len(language.buckets(c, 16))
    assert len(set(language.buckets(c, 16))) == len(counts)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    m = quality.Attention(hidden=4, gate=3)
    x, first, want = rng.random((7, quality.SIZE)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        y = m.forward(x, first)["y"]
        return -np.mean(want * np.log(y) + (1 - want) * np.log(1 - y)) + 0.5e-4 * sum((v**2).sum() for v in m.p.values())

    g = m.gradients(m.forward(x, first), first, want)
    for name, at in (("W", (5, 1)), ("V", (1, 2)), ("U", (0, 0)), ("w", (1,)), ("c", (2,)), ("b", (0,))):
        before = m.p[name][at]
        m.p[name][at] = before + 1e-5
        up = loss()
        m.p[name][at] = before - 1e-5
        down = loss()
        m.p[name][at] = before
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = rows_of(quality.score(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))))
    assert np.mean([(r["quality_score"] >= 0.3) == (r["quality"] == 1) for r in got]) >= 0.8
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, LONG * 3, 0), (3, LONG * 3, 0)], "i int, text string, quality_score int")
    scores = [r["quality_score_"] for r in rows_of(quality.score(odd, model))]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[2] == scores[3]
    text = docs.first().text * 40
    whole = model.forward(quality.encode(quality.passages(text)), np.array([0]))["y"][0]
    assert model.score(text) == pytest.approx(whole)
    assert quality.train(docs, labels.limit(0)).score("any") == pytest.approx(0.5, abs=0.5)
    assert quality.score(odd.limit(0), model).count() == 0


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    twice = [int(c) * 2 for c in d[-2::-2]]
    return (sum(map(int, d[-1::-2])) + sum(v - 9 if v > 9 else v for v in twice)) % 10 == 0


def plain_spans(text):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if good[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_private(spark):
    texts = [
        "a@b.c_d@e.f x@y @z.q a..b@c-.d",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3",
        "4111 1111 1111 1111, 4111-1111-1111-1112 411111111111111 1",
        "+1 (212) 555-0100 +49  30 1234567 +1+2 ++44 20 7946 0958.",
        "é🙂 a@b.co 4111111111111111é+49 301234567",
        "7" * 5000,
        "1.2.3.4@5.6 a@1.2.3.4 +4111111111111111",
        None,
        "",
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, texts[4], 1)], "doc_id long, text string, private int")
    got = private.personal_data(df)
    base, everything = private.listed("private_")
    rows = rows_of(got.select("doc_id", "text", base.alias("b"), everything.alias("s")))
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r["b"] == r["s"] == plain_spans(r["text"]), r["text"]
    assert private.personal_data(df.limit(0)).count() == 0


def test_terms_that_disclose(spark):
    """A word that only ever stands with one address discloses it; common words don't."""
    known = [(i, f"the Zorblax wrote to max@corp.example again\nthe end {i}") for i in range(4)]
    other = [(10 + i, f"the plain text wrote to nobody again {i}") for i in range(40)]
    got = private.personal_data(spark.createDataFrame(known + other, "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in rows_of(private.sanitise(got))}
    for i in range(4):
        text = rows[i]["text"]
        assert [text[s["start"] : s["end"]] for s in rows[i]["private"]["terms"]] == ["Zorblax"]
        assert rows[i]["clean"] == f"the  wrote to [corp.example] again\nthe end {i}"
    assert all(rows[10 + i]["clean"] == rows[10 + i]["text"] for i in range(40))


# SentencePiece


@pytest.fixture(scope="module")
def lattices():
    pytest.importorskip("public_tokenizers")
    with open(pieces.default_model(), "rb") as f:
        return pieces.lattices(f.read())


def test_pieces_are_the_models(lattices):
    for t in ["m² a² x².", "  a  b ", "a\n\n b\n", " ", "\n", "x1y2_z 12,5 %%% ab***cd 漢字🙂 é̂", "tab\there", "", "l'été d'1 ²³ ²."]:
        r = pieces.encode_batch(lattices, [t], np.array([5], np.uint64), 3)[0].as_py()
        assert r["ids"] == lattices.sp.encode(t) and r["round_trip"]
        assert all(lattices.sp.decode(s["ids"]) == t for s in r["samples"])
        assert len({tuple(s["ids"]) for s in r["samples"]}) == len(r["samples"])


def test_samples_follow_their_probabilities(lattices):
    """First samples by p, second ones without replacement, estimates unbiased."""

    def segmentations(w):
        if not w:
            yield (), 0.0
        for j in range(1, len(w) + 1):
            if (p := lattices.piece.get(w[:j])) is not None:
                for rest, s in segmentations(w[j:]):
                    yield (p, *rest), lattices.logp[p] + s

    found = dict(segmentations("▁this▁cat"))
    total = np.logaddexp.reduce(list(found.values()))
    p = {k: np.exp(v - total) for k, v in found.items()}
    n = 20000
    b = pieces.Batch(lattices, ["this cat"] * n, np.random.default_rng(0).integers(0, 2**64, n, np.uint64))
    first, second, weight = Counter(), Counter(), Counter()
    for *got, threshold in b.sample(2):
        ids = [tuple(b.ids(e).tolist()) for e, _, _ in got]
        assert ids[0] != ids[1] and got[0][2] >= got[1][2] >= threshold
        first[ids[0]] += 1
        second[ids[1]] += 1
        for i, (_, logp, _) in zip(ids, got):
            assert logp == pytest.approx(np.log(p[i]))
            weight[i] += p[i] / np.exp(pieces.log_inclusion(logp, threshold))
    for s in sorted(p, key=p.get)[-4:]:
        assert first[s] / n == pytest.approx(p[s], abs=0.015)
        assert second[s] / n == pytest.approx(sum(p[x] * p[s] / (1 - p[x]) for x in p if x != s), abs=0.015)
        assert weight[s] / n == pytest.approx(p[s], abs=0.015)


def test_encode_frame(spark, lattices):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, "c d", 0), (2, None, 0), (3, "", 0), (4, LONG + "x" * 5000, 0)], "doc_id long, text string, pieces int")
    got = rows_of(pieces.encode(df))
    assert got[0]["pieces_"] == got[1]["pieces_"] and all(r["pieces_"]["round_trip"] for r in got)
    assert got[3]["pieces_"]["ids"] == got[4]["pieces_"]["ids"] == [] and got[3]["pieces_"]["samples"] == []
    ids = pieces.encode(df).select("doc_id", "text", F.col("pieces_.ids").alias("ids"))
    assert all(r["decoded"] == (r["text"] or "") for r in rows_of(pieces.decode(ids)))
    assert pieces.encode(df.limit(0)).count() == 0
    alone = pieces.encode_batch(lattices, ["a b"], np.array([9], np.uint64), 2)[0].as_py()
    among = pieces.encode_batch(lattices, ["z", "a b"], np.array([8, 9], np.uint64), 2)[1].as_py()
    assert [s["ids"] for s in among["samples"]] == [s["ids"] for s in alone["samples"]]
    assert [s["logp"] for s in among["samples"]] == pytest.approx([s["logp"] for s in alone["samples"]])


def test_forgotten_words_change_nothing(lattices, monkeypatch):
    """Samples don't depend on which words a worker has kept."""
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("aeiourstnl"), rng.integers(1, 9))) for _ in range(60)) + "\n." for _ in range(40)]
    keys = np.arange(40, dtype=np.uint64)
    lattices.forget()
    whole = pieces.encode_batch(lattices, texts, keys, 2).to_pylist()
    monkeypatch.setattr(pieces, "EDGES", 500)
    monkeypatch.setattr(pieces, "LEARNED", 7)
    lattices.forget()
    each = [pieces.encode_batch(lattices, [t], keys[i : i + 1], 2)[0].as_py() for i, t in enumerate(texts)]
    assert [[s["ids"] for s in r["samples"]] for r in whole] == [[s["ids"] for s in r["samples"]] for r in each]
    assert all(r["round_trip"] and r["ids"] == lattices.sp.encode(t) for r, t in zip(each, texts, strict=True))
    lattices.forget()


def test_every_segmentation_is_found(lattices):
    """More samples asked for than there are: all come, also such of tiny probability."""

    def count(w):
        return 1 if not w else sum(count(w[j:]) for j in range(1, len(w) + 1) if w[:j] in lattices.piece)

    for text in ("to", "cat", "tion", "a b"):
        n = count(pieces.SPACE + text.replace(" ", pieces.SPACE))
        r = pieces.encode_batch(lattices, [text], np.array([3], np.uint64), n + 3)[0].as_py()
        assert len({tuple(s["ids"]) for s in r["samples"]}) == len(r["samples"]) == n
        assert abs(sum(np.exp(s["logp"]) for s in r["samples"]) - 1) < 1e-9


def plain_terms(rows, min_together=3, alpha=0.8):
    """Spans of terms by the definition, counted context by context in plain Python."""
    place, lines, n_t, n = {}, [], {}, 0
    name = lambda k, v: v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)

    def mask(k, v):
        d = re.sub("[^0-9]", "", v)
        return v.split("@", 1)[1] if k == "email" else ".".join(v.split(".")[:2]) if k == "ip" else d[:6] if k == "card" else "+" + d[:2]

    for doc, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            if line:
                n += 1
                for w in {x.lower() for x in re.findall(r"[^\W_]+", line)}:
                    n_t[w] = n_t.get(w, 0) + 1
                spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in plain_spans(line).split(",") if s)]
                if spans:
                    lines.append((doc, at, line, spans, {(k, name(k, line[a:b]), mask(k, line[a:b])) for k, a, b in spans}))
            at += len(line) + 1
    together, n_e, n_g = {}, {}, {}
    for _, _, line, _, entities in lines:
        for k, e, _ in entities:
            n_e[k, e] = n_e.get((k, e), 0) + 1
            for w in {x.lower() for x in re.findall(r"[^\W_]+", line)}:
                together[k, e, w] = together.get((k, e, w), 0) + 1
        for g in {(k, g) for k, _, g in entities}:
            n_g[g] = n_g.get(g, 0) + 1
    for doc, at, line, spans, entities in lines:
        for k, e, g in entities:
            for m in re.finditer(r"[^\W_]+", line):
                both = together[k, e, m[0].lower()]
                if both < min_together or any(a < m.end() and m.start() < b for _, a, b in spans):
                    continue
                pmi = np.log2(n * both / (n_t[m[0].lower()] * n_e[k, e]))
                bound = alpha * -np.log2(n_e[k, e] / n)
                if n_g[k, g] > n_e[k, e]:
                    bound = max(bound, -np.log2(n_g[k, g] / n))
                if pmi > bound:
                    place.setdefault(doc, set()).add((at + m.start(), at + m.end()))
    return place


def test_terms_equal_plain_counts(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    people = ["ann@corp.example", "bob@corp.example", "10.1.2.3", "10.1.9.9", "+49 30 1234567", "4111 1111 1111 1111"]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choices(words, k=5)) for _ in range(4)]
        if i % 2:
            who = rng.randrange(len(people))
            lines.append(f"{rng.choice(words)} nick{who} {people[who]} {rng.choice(words)} Étage{who % 2}")
        rows.append((i, "\n".join(lines) + "\n" * (i % 3)))
    got = rows_of(private.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    want = plain_terms(rows)
    assert want and {r["doc_id"]: {(s["start"], s["end"]) for s in r["private"]["terms"]} for r in got if r["private"]["terms"]} == want


def test_dense_text(spark):
    """A text of many lines and spans, and one of a single line without a space."""
    lines = [f"user{i}@host{i % 7}.example called 10.0.{i % 200}.{i // 200}" for i in range(20_000)]
    run = ",".join(f"a{i}@b.co" for i in range(2_000))
    got = {r["doc_id"]: r["private"]["base"] for r in rows_of(private.personal_data(spark.createDataFrame([(1, "\n".join(lines)), (2, run)], "doc_id long, text string")))}
    for i, text in ((1, "\n".join(lines)), (2, run)):
        assert ",".join(f"{private.KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in got[i]) == plain_spans(text)


def test_unclosed_tags_take_linear_time():
    import time

    def seconds(n):
        began = time.process_time()
        extract.blocks("<i>" * n + "<hr>x</q>" * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(0.05, seconds(4_000))


def test_largest_of_each_group():
    x = np.array([1.0, 3, 3, -np.inf, 2, -np.inf, 5])
    group = np.array([0, 0, 0, 0, 1, 1, 4])
    for k in (0, 1, 2, 3, 9):
        rank = np.lexsort((-x, group))
        place = np.arange(len(rank)) - np.searchsorted(group[rank], group[rank])
        want = [i for i in rank[place < k].tolist() if x[i] > -np.inf]
        assert sorted(pieces.largest(x, group, k).tolist()) == sorted(want)
    assert len(pieces.largest(x[:0], group[:0], 2)) == 0


def test_a_worker_encodes_on_its_own_core(lattices, monkeypatch):
    """Threads of the tokenizer cost more than they encode; a task has one core."""
    asked = []
    for name in ("_decode_raw",):
        real = getattr(lattices.sp, name)
        monkeypatch.setattr(lattices.sp, name, lambda *a, real=real, **k: (asked.append(a[2]), real(*a, **k))[1])
    pieces.encode_batch(lattices, ["one text", "another one"], np.arange(2, dtype=np.uint64), 2)
    assert lattices.sp._num_threads == 1 and asked and set(asked) == {1}
