"""Personal data: patterns, and terms that give protected entities away.

Native: DataFrame functions only. Base spans are emails, IPv4 addresses, card
numbers and phone numbers; their places come from splitting a text at a pattern
and adding up the lengths of the parts.

The information-theoretic part protects every entity that a base span names
(an address, a number). A term t reveals an entity e as far as their pointwise
mutual information goes, PMI(t; e) = log2(N n(t, e) / (n(t) n(e))), with lines as
contexts (a line of more than 512 characters is cut at the next white space, or
at 1,024), counted over the whole corpus. Masking e as a generalisation g(e) (an
email's domain, half an address, a card's issuer, a phone's country) already
admits IC(g(e)) = -log2(n(g) / N); a term that stands with e in at least
``min_together`` lines and in more than that reveals is disclosed when
PMI(t; e) > max(IC(g(e)), alpha * IC(e)), the first only where g(e) stands in
more lines than e and so is more general. Its occurrences in lines with e become
spans of kind "term". sanitise() writes base spans as their generalisation and
removes terms.

Scale: only contexts with entities are joined, and they are written once for all
their uses; term counts aggregate before they are shuffled; all joins are on
hashed keys that adaptive execution can split. Work grows with the power 1.5 of
the spans of one text, as sums run in blocks (see running()); what is quadratic
is so in a context only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declario.llm.common import drop, free_name, materialise

#: Kinds in order and their patterns. Each is the kind's own
#: pattern, written so that no run of characters is scanned from every start:
#: a run is entered at its front or where the last match ended (\\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: What a text must hold for a kind to be looked for.
NEEDS = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
SPAN = "array<struct<kind: int, start: bigint, end: bigint, value: string>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True if the digit string passes Luhn's check."""

    def value(x: Column, i: Column) -> Column:
        twice = x.cast("int") * 2
        return F.when(i % 2 == 0, x.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(F.reverse(d), "(?<=.)(?=.)"), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def is_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & luhn(d)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")),
    "card": lambda v: let(digits(v), is_card),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def running(lengths: Column) -> Column:
    """For each length the sum of those before it.

    A fold that grows an array copies it at every step, so sums run inside
    blocks of about sqrt(n) lengths, then over the blocks.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("sums"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc.at + x).alias("at"), F.concat(acc.sums, F.array(acc.at)).alias("sums"))

    def by_block(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")
        heads = F.when(F.size(own) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(own), size))
        parts = F.transform(heads, lambda h: F.aggregate(F.slice(own, h, size), start, add))
        return let(parts, whole)

    def whole(parts: Column) -> Column:
        before = F.aggregate(F.transform(parts, lambda p: p.at), start, add, lambda a: a.sums)
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p.sums, lambda x: x + b)))

    return let(lengths, by_block)


def placed(text: Column, pattern: str) -> Column:
    """(start, end, value) of the matches of a pattern, in order."""
    both = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"))
    )

    def add_up(pairs: Column) -> Column:
        starts = running(F.transform(pairs, lambda p: (p.gap + F.coalesce(F.length(p.value), F.lit(0))).cast("bigint")))
        return F.filter(F.zip_with(pairs, starts, span), lambda s: s.value.isNotNull())

    def span(p: Column, at: Column) -> Column:
        begin = at + p.gap
        return F.struct(begin.alias("start"), (begin + F.length(p.value)).alias("end"), p.value.alias("value"))

    return let(both, add_up)


def matches(text: Column, kind: str) -> Column:
    """Spans of one kind: leftmost, not overlapping, checked without retries."""
    right = F.filter(placed(text, PATTERNS[kind]), lambda s: VALID[kind](s.value))
    spans = F.transform(right, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.value.alias("value")))
    return F.when(NEEDS[kind](text), spans).otherwise(F.array().cast(SPAN))


def generalised(kind: Column, value: Column) -> Column:
    """What an entity is masked as."""
    return (
        F.when(kind == 0, F.regexp_extract(value, r"@(.*)$", 1))
        .when(kind == 1, F.regexp_extract(value, r"^([0-9]+\.[0-9]+)\.", 1))
        .when(kind == 2, F.substring(digits(value), 1, 6))
        .otherwise(F.concat(F.lit("+"), F.substring(digits(value), 1, 2)))
    )


def entity(kind: Column, value: Column) -> Column:
    """One name for all ways to write an entity."""
    return F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(digits(value))


WORD = r"[\p{L}\p{N}]+"
#: Contexts and the line breaks between them; together they are the text.
CONTEXT = r"\n++|[^\n]{1,512}+[^\n\s]{0,512}+"


def contexts(text: Column) -> Column:
    """(start, line) of the contexts of a text."""

    def add_up(parts: Column) -> Column:
        starts = running(F.transform(parts, lambda x: F.length(x).cast("bigint")))
        both = F.zip_with(parts, starts, lambda x, at: F.struct(at.alias("start"), x.alias("line")))
        return F.filter(both, lambda c: ~F.startswith(c.line, F.lit("\n")))

    return let(F.regexp_extract_all(text, F.lit(CONTEXT), F.lit(0)), add_up)


def words_of(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)))


def found_entities(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, th, kind, start, end, value, entity) of all base spans."""
    spans = F.concat(*(matches(F.col(text), k) for k in KINDS))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.explode(spans).alias("s"))
    return rows.select("id", "th", "s.*").withColumn("entity", entity(F.col("kind"), F.col("value")))


def term_spans(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_together: int = 3,
    alpha: float = 0.8,
    made: list[str] | None = None,
) -> DataFrame:
    """(id, th, terms): places of the terms that disclose an entity of their context.

    Entities in fewer than ``min_together`` contexts can't have a term that meets
    the support, so only the contexts of the others are opened.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    any_base = F.lit(False)
    for k in KINDS:
        any_base = any_base | NEEDS[k](F.col("text"))
    lines = source.where(any_base).select("id", "th", F.explode(contexts(F.col("text"))).alias("c")).select("id", "th", "c.*")
    lines = lines.withColumn("spans", F.concat(*(matches(F.col("line"), k) for k in KINDS))).where("size(spans) > 0")
    lines = materialise(lines, made)  # read for each of the counts below
    named = F.array_distinct(
        F.transform("spans", lambda s: F.struct(s.kind.alias("kind"), entity(s.kind, s.value).alias("entity"), generalised(s.kind, s.value).alias("general")))
    )
    place = ["id", "th", "start"]
    uses = lines.select(*place, "line", "spans", F.explode(named).alias("e")).select(*place, "line", "spans", "e.*")
    n_entity = uses.groupBy("kind", "entity").agg(F.count("*").alias("n_e"), F.first("general").alias("general"))
    n_general = uses.select("kind", "general", *place).distinct().groupBy("kind", "general").agg(F.count("*").alias("n_g"))
    often = n_entity.where(F.col("n_e") >= min_together).join(n_general, ["kind", "general"])
    often = materialise(often.select("kind", "entity", "n_e", "n_g"), made)
    opened = uses.join(often, ["kind", "entity"])

    together = (
        opened.select("kind", "entity", "n_e", "n_g", F.explode(words_of(F.col("line"))).alias("term"))
        .groupBy("kind", "entity", "n_e", "n_g", "term")
        .agg(F.count("*").alias("n_te"))
        .where(F.col("n_te") >= min_together)
    )
    # One pass counts terms and, as the term null, contexts.
    parts = F.filter(F.regexp_extract_all("text", F.lit(CONTEXT), F.lit(0)), lambda x: ~F.startswith(x, F.lit("\n")))
    none = F.array(F.lit(None).cast("string"))
    said = source.select(F.explode(F.flatten(F.transform(parts, lambda x: F.concat(none, words_of(x))))).alias("term"))
    n_term = materialise(said.groupBy("term").agg(F.count("*").alias("n_t")), made)
    n = F.lit((n_term.where("term IS NULL").first() or [None, 0])[1])
    ic = lambda c: -F.log2(F.col(c) / n)
    told = (
        together.join(n_term, "term")
        .withColumn("pmi", F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))))
        .where(F.col("pmi") > F.greatest(F.when(F.col("n_g") > F.col("n_e"), ic("n_g")), F.lit(alpha) * ic("n_e")))
        .select("kind", "entity", "term")
    )
    said_at = opened.select("kind", "entity", *place, "spans", F.explode(placed(F.col("line"), WORD)).alias("w"))
    outside = ~F.exists("spans", lambda b: (b.start < F.col("w.end")) & (F.col("w.start") < b.end))
    said_at = said_at.where(outside).select("kind", "entity", "id", "th", "start", "w", F.lower("w.value").alias("term"))
    hit = said_at.join(told, ["kind", "entity", "term"])
    span = F.struct((F.col("start") + F.col("w.start")).alias("start"), (F.col("start") + F.col("w.end")).alias("end"))
    return hit.groupBy("id", "th").agg(F.collect_set(span).alias("terms"))


def personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "private", min_together: int = 3, alpha: float = 0.8
) -> DataFrame:
    """``docs`` with a struct ``out``: base (spans of the four kinds by kind, then
    start) and terms (spans by start that the method adds, outside the base spans
    of their context).

    Defined results: a null text is empty and has no spans; rows that share id
    and text share spans; a null id is an id like others; an empty table gives
    an empty result; other columns pass through whatever their names.
    """
    out = free_name(docs, out)
    key = [free_name(docs, "_id"), free_name(docs, "_th")]
    made: list[str] = []
    added = materialise(term_spans(docs, doc_id, text, min_together, alpha, made))
    drop(docs.sparkSession, made)
    added = added.withColumnsRenamed({"id": key[0], "th": key[1], "terms": out})
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.withColumn(key[1], F.xxhash64(text))
    same = [own[doc_id].eqNullSafe(added[key[0]]), own[key[1]] == added[key[1]]]
    both = own.join(added, same, "left").drop(added[key[1]]).drop(key[0])
    base = F.concat(*(matches(t, k) for k in KINDS))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    found = F.struct(base.alias("base"), F.array_sort(F.coalesce(F.col(out), none)).alias("terms"))
    return both.withColumn(out, found).select(*docs.columns, out)


def is_kind(kind: str):
    """A test of a span's kind; a lambda of one argument, for a second would be the index."""
    return lambda k: k == KINDS.index(kind)


def listed(private: str = "private") -> tuple[Column, Column]:
    """(base, all): spans as kind:start:end, by kind, then start."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda name, s: F.concat_ws(":", name, s.start.cast("string"), s.end.cast("string"))
    base = F.transform(f"{private}.base", lambda s: text(F.get(names, s.kind), s))
    terms = F.transform(f"{private}.terms", lambda s: text(F.lit("term"), s))
    return F.concat_ws(",", base), F.concat_ws(",", F.concat(base, terms))


def sanitise(found: DataFrame, text: str = "text", private: str = "private", out: str = "clean") -> DataFrame:
    """``found`` of personal_data() with a text in which base spans are written as
    their generalisation and terms are removed. Of base spans that overlap, the
    first by start counts (the longer on a tie)."""
    cut = lambda s, kind, value: F.struct(s.start.alias("start"), (-s.end).alias("end"), kind.alias("kind"), value.alias("value"))
    base = F.transform(f"{private}.base", lambda s: cut(s, s.kind, s.value))
    terms = F.transform(f"{private}.terms", lambda s: cut(s, F.lit(-1), F.lit("")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text"))

    def add(acc: Column, s: Column) -> Column:
        mask = F.when(s.kind < 0, "").otherwise(F.concat(F.lit("["), generalised(s.kind, s.value), F.lit("]")))
        piece = F.substr(F.col(text), (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        return F.when(s.start < acc.at, acc).otherwise(F.struct((-s.end).alias("at"), F.concat(acc.text, piece, mask).alias("text")))

    rest = lambda acc: F.concat(acc.text, F.substr(F.col(text), (acc.at + 1).cast("int")))
    return found.withColumn(free_name(found, out), F.aggregate(F.array_sort(F.concat(base, terms)), start, add, rest))
