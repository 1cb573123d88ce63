"""URL filter: fixed rules first, then logistic regression on hashed n-grams.

The model is trained from a small table of labelled URLs (LABELLED below, or any
list of (url, blocked) pairs the caller gives) on hashed character n-grams of
host and path. Host, path and rules are column expressions; only what no rule
decides needs the model, whose weights are a vector of 2**bits floats. The table
holds more blocked URLs than the web does; ``prior`` is the share expected there,
and moves the bias accordingly.

Defined results: a null URL, or one without "://", has an empty host and path,
fits no rule, and gets the model's verdict on empty features (its bias).
Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.llm.common import ascii_lower, free_name, spared

#: Rules (action, host and path); the longest that fits wins.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: Small labelled table: what is to be blocked, by subject, and everyday sites.
#: Paths and hosts' front parts are dealt alike to both, so that only names count.
BLOCKED = """
casino-palace royal-casino casinospins mobile-casino slots-king slotmachines poker-room pokerstars24
betting-tips sportsbet bet-now livebets bets-online jackpot-city roulette-live lottery-winners
pharmacy-discount pills-direct buy-pills diet-pills pills4you viagra-shop cialis-online meds-no-prescription
porn-videos pornhub24 xxx-movies xxx-live adult-chat adult-dating adult-films sex-cams nude-pics escort-girls
spam-mail spam-links link-farm seo-farm content-farm click-farm buy-backlinks bulk-mailer
ads-server adserver banner-ads popup-ads ad-clicks track-pixel user-tracking tracking-stats clicktracker
free-iphone free-money free-gifts win-prizes prize-winner get-rich-quick fast-cash payday-loans crypto-doubler
warez-download cracked-software keygen-files torrent-movies phishing-login fake-watches replica-bags
""".split()
ALLOWED = """
city-library daily-post morning-news weather-today gardening-tips university museum-visit cycling-forum
history-wiki travel-blog hospital-info science-articles theatre-tickets music-school old-books recipes-home
python-guide river-cruise mountain-hotel bakery-street school-board court-records tax-office town-hall
football-club chess-league bird-watch solar-panels electric-cars bus-timetable train-station airport-guide
physics-notes maths-course language-lab dictionary-online poetry-archive film-review art-gallery photo-diary
dental-care family-doctor pet-clinic veterinary flower-shop furniture-maker carpenter plumbing-service
house-rental land-registry bank-branch insurance-advice savings-plan job-centre startup-weekly law-review
open-source kernel-docs database-tuning network-admin robotics-club astronomy sailing-school hiking-trails
wine-cellar cheese-market farm-produce forest-trust ocean-research climate-data energy-report water-works
paper-mill tournament-results harbour-master book-reviews research-group interior-design mother-and-child
""".split()
FRONTS = ["", "www.", "blog.", "m."]
PATHS = ["/en/12", "/de/3.html", "/fr/450?page=2", "/es/7/", "/", "/news/2024/05", "/index.html", "/a/b?x=1"]
LABELLED = [
    (f"{'https' if i % 2 else 'http'}://{FRONTS[i % 4]}{name}.example{PATHS[i % 8]}", label) for label, names in ((1, BLOCKED), (0, ALLOWED)) for i, name in enumerate(names)
]


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits host and path, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def features(host: str, path: str, bits: int) -> list[int]:
    """Buckets of the distinct 3- to 5-grams of host and path, framed."""
    out = set()
    for kind, s in (("h", f"^{host}$" if host else ""), ("p", f"{path}$" if path else "")):
        for n in (3, 4, 5):
            out.update(f"{kind}{s[i : i + n]}" for i in range(len(s) - n + 1))
    return sorted({zlib.crc32(x.encode()) & ((1 << bits) - 1) for x in out})


def split_url(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    return rest[:cut].lower(), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def train(labelled=LABELLED, bits: int = 14, steps: int = 400, rate: float = 0.5, l2: float = 1e-3, prior: float | None = None):
    """(weights, bias) by full-batch gradient descent; the table is small by design."""
    rows = [features(*split_url(u), bits) for u, _ in labelled]
    x = np.zeros((len(rows), 1 << bits))
    for i, r in enumerate(rows):
        x[i, r] = 1 / max(1.0, np.sqrt(len(r)))
    y = np.array([v for _, v in labelled], float)
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ g + l2 * w)
        b -= rate * g.mean()
    if prior is not None and 0 < y.mean() < 1:
        b += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    return w.astype(np.float32), float(b)


def _scorer(w: np.ndarray, b: float, bits: int, at: tuple[int, int], name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            hosts, paths = (batch.column(i).to_pylist() for i in at)
            for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                f = features(h, p, bits)
                out[i] = b + (w[f].sum() / np.sqrt(len(f)) if f else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-out)))], names=[*batch.schema.names, name]
            )

    return spared(score)


def filter_urls(
    pages: DataFrame, url: str = "url", rules=RULES, labelled=LABELLED, bits: int = 14, threshold: float = 0.5, prior: float = 0.2
) -> DataFrame:
    """``pages`` with url_host, url_path, url_rule, url_score (probability of block)
    and url_verdict; names that ``pages`` already has get an underscore more."""
    w, b = train(labelled, bits, prior=prior)
    names = [free_name(pages, f"url_{x}") for x in ("host", "path", "rule", "score", "verdict")]
    host, path, rule, score, verdict = names
    df = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    at = (df.columns.index(host), df.columns.index(path))
    df = df.mapInArrow(
        _scorer(w, b, bits, at, score), T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())])
    )
    found, action = rule_of(F.col(host), F.col(path), rules)
    by_model = F.when(F.col(score) >= threshold, "block").otherwise("allow")
    return df.withColumns({rule: found, verdict: F.coalesce(action, by_model)})
