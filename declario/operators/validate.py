"""Validation: rules are predicates, violations are rows.

Row rules are evaluated in one pass: an array of issues per row, exploded.
Nothing stops at the first violation; raise_issues() is the form that does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.functions import strings
from declario.plans.model import Model

SEVERITIES = ["error", "warning", "info", "notice"]


@dataclass(frozen=True)
class Rule:
    """``broken``: a column that is true where the rule is violated (null is not)."""

    code: str
    path: str
    broken: Column
    severity: str = "error"
    message: str = ""
    applies: Column | None = None


def required(f: str, kind: str = "string", **k) -> Rule:
    return Rule("required", f, strings.blank(F.col(f), kind), message=f"{f} is missing", **k)


def one_of(f: str, values: list, **k) -> Rule:
    return Rule("enum", f, F.col(f).isNotNull() & ~F.col(f).isin(values), message=f"{f} is not an allowed value", **k)


def pattern(f: str, regex: str, array: bool = False, **k) -> Rule:
    """Unanchored; ^ and $ are line anchors."""
    good = (lambda c: F.forall(c, lambda x: x.rlike(f"(?m){regex}"))) if array else (lambda c: c.rlike(f"(?m){regex}"))
    return Rule("pattern", f, ~good(F.col(f)), message=f"{f} does not match", **k)


def size_between(f: str, low: int = 0, high: int | None = None, **k) -> Rule:
    n = F.coalesce(F.size(F.col(f)), F.lit(0))
    return Rule("collection_size", f, (n < low) | (n > high if high is not None else F.lit(False)), message=f"{f} has a wrong size", **k)


def length_between(f: str, low: int = 0, high: int | None = None, **k) -> Rule:
    n = F.length(f)
    return Rule("length", f, (n < low) | (n > high if high is not None else F.lit(False)), message=f"{f} has a wrong length", **k)


def number(f: str, less: float | None = None, greater: float | None = None, equal: float | None = None, integer: bool = False, **k) -> Rule:
    bad = F.lit(False)
    c = F.col(f)
    if less is not None:
        bad = bad | (c >= less)
    if greater is not None:
        bad = bad | (c <= greater)
    if equal is not None:
        bad = bad | (c != equal)
    if integer:
        bad = bad | (c != F.floor(c))
    return Rule("numericality", f, bad, message=f"{f} is out of range", **k)


def type_in(tag: str, types: list[str], **k) -> Rule:
    return Rule("polymorphic", tag, F.col(tag).isNotNull() & ~F.col(tag).isin(types), message=f"{tag} is not an allowed type", **k)


def present_count(fields: dict[str, str]) -> Column:
    """How many of the fields (name: kind) are present."""
    parts = [F.when(strings.present(F.col(f), kind), 1).otherwise(0) for f, kind in fields.items()]
    return sum(parts[1:], parts[0])


def choice(path: str, fields: dict[str, str], low: int = 1, high: int = 1, **k) -> Rule:
    return Rule("choice", path, ~present_count(fields).between(low, high), message=f"{path} needs {low} to {high} of its attributes", **k)


def in_sequence(f: str, names: list[str], **k) -> Rule:
    """An array of element names must follow the declared order; unknown names are passed over."""
    places = F.array(*map(F.lit, names))
    at = F.filter(F.transform(F.col(f), lambda x: F.array_position(places, x)), lambda p: p > 0)
    return Rule("sequence", f, ~at.eqNullSafe(F.array_sort(at)), message=f"{f} is out of order", **k)


def of_model(model: Model, elements: str | None = None, above: str = "") -> list[Rule]:
    """The rules that a model declares: required and allowed values, patterns,
    sizes of collections, choices, nested models, and with the column ``elements``
    (names in the order of the document) its sequence.

    A collection inside a choice has no size of its own to keep, and a choice of
    which nothing is present is kept where one of its collections may be empty.
    """
    chosen = {n for c in model.choices for n in c.names}
    kinds = {a.name: "array" if a.collection else "string" if isinstance(a.spark_type(), T.StringType) else "other" for a in model.attributes}
    out = []
    for a in model.attributes:
        f = f"{above}{a.name}"
        c = F.col(f)
        if a.required:
            out.append(required(f, kinds[a.name]))
        if a.values:
            bad = ~F.forall(c, _among(a.values)) if a.collection else c.isNotNull() & ~c.isin(list(a.values))
            out.append(Rule("enum", f, bad, message=f"{f} is not an allowed value"))
        if a.pattern:
            out.append(pattern(f, a.pattern, array=bool(a.collection)))
        if isinstance(a.collection, tuple) and a.name not in chosen:
            out.append(size_between(f, *a.collection))
        if isinstance(a.type, Model) and not a.collection:
            out += [replace(r, applies=c.isNotNull() if r.applies is None else c.isNotNull() & r.applies) for r in of_model(a.type, None, f"{f}.")]
    for c in model.choices:
        fields = {f"{above}{n}": kinds[n] for n in c.names}
        rule = choice("|".join(c.names), fields, c.low, c.high)
        may_be_empty = any(isinstance(model[n].collection, tuple) and model[n].collection[0] == 0 for n in c.names)
        out.append(replace(rule, broken=rule.broken & (present_count(fields) > 0)) if may_be_empty else rule)
    if model.sequence and elements:
        out.append(in_sequence(elements, list(model.sequence)))
    return out


def _among(values: tuple) -> Callable[[Column], Column]:
    return lambda x: x.isin(list(values))


def nested(path: str, rules: Callable[[Callable[[str], str]], list[Rule]]) -> list[Rule]:
    """Rules of a nested model, on ``path.field``."""
    return rules(lambda f: f"{path}.{f}")


def issues(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(row_id, path, code, severity, message), one row per violation."""
    found = []
    for r in rules:
        broken = F.coalesce(r.broken, F.lit(False))
        if r.applies is not None:
            broken = broken & F.coalesce(r.applies, F.lit(False))
        item = F.struct(F.lit(r.path).alias("path"), F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))
        found.append(F.when(broken, item))
    return df.select(F.col(key).alias("row_id"), F.explode(F.array_compact(F.array(*found))).alias("issue")).select("row_id", "issue.*")


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Nulls take their default before the other checks."""
    return df.withColumns({f: F.coalesce(F.col(f), d) for f, d in defaults.items()})


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"))


def raise_issues(found: DataFrame, most: int = 20) -> None:
    rows = found.limit(most).collect()
    if rows:
        raise ValueError("; ".join(f"{r.row_id}: {r.path}: {r.code}" for r in rows))


# rules on whole collections


def unique(df: DataFrame, f: str) -> DataFrame:
    """(value, n) of values that occur more than once."""
    return df.where(F.col(f).isNotNull()).groupBy(F.col(f).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def counts_between(df: DataFrame, parent: DataFrame, key: str, parent_key: str, low: int, high: int | None = None) -> DataFrame:
    """(key, n) of parents with too few or too many rows."""
    n = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    rows = parent.select(F.col(parent_key).alias("key")).join(n, F.col("key") == F.col("_k"), "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.where((F.col("n") < low) | (F.col("n") > high if high is not None else F.lit(False)))


def all_present(df: DataFrame, f: str, key: str, severity: str = "error") -> DataFrame:
    """An issue for every row of a collection in which a field is missing."""
    return issues(df, key, [required(f, dict(df.dtypes)[f], severity=severity)])


def misshapen(df: DataFrame, model) -> list[str]:
    """Attributes whose column is a collection and shouldn't be, or the reverse."""
    have = {f.name: f.dataType for f in df.schema.fields}
    several = {a.name: bool(a.collection) for a in model.attributes if a.name in have}
    return [f"{n} is {'a collection' if want else 'one value'} in {model.name}" for n, want in several.items() if isinstance(have[n], T.ArrayType) != want]


@dataclass
class CollectionRule:
    """``check`` gives an issue table from the collection and a shared context."""

    name: str
    check: Callable[[DataFrame, dict], DataFrame | None]
    if_cond: Callable[[dict], bool] | None = None
    unless_cond: Callable[[dict], bool] | None = None


class Stop(Exception):
    """Raised by a rule to end the chain."""


@dataclass
class Profile:
    """Named rules in order, with those of imported profiles first."""

    name: str
    rules: list[CollectionRule]
    imports: list[Profile] = field(default_factory=list)

    def all(self, above: tuple[str, ...] = ()) -> list[CollectionRule]:
        if self.name in above:
            raise ValueError(f"profiles import each other: {' > '.join((*above, self.name))}")
        return [r for p in self.imports for r in p.all((*above, self.name))] + self.rules

    @staticmethod
    def parse(text: str, rules: dict[str, CollectionRule], known: dict[str, Profile]) -> Profile:
        """A profile from YAML: name, rules and imports by name."""
        import yaml

        doc = yaml.safe_load(text)
        lost = [r for r in doc.get("rules", []) if r not in rules] + [p for p in doc.get("imports", []) if p not in known]
        if lost:
            raise KeyError(f"profile {doc['name']} names {', '.join(lost)}, which isn't there")
        return Profile(doc["name"], [rules[r] for r in doc.get("rules", [])], [known[p] for p in doc.get("imports", [])])

    def run(self, df: DataFrame) -> dict[str, DataFrame]:
        """Each rule's issues; conditions see the context the rules before left."""
        context: dict = {}
        found = {}
        for r in self.all():
            if (r.if_cond and not r.if_cond(context)) or (r.unless_cond and r.unless_cond(context)):
                continue
            try:
                out = r.check(df, context)
            except Stop:
                break
            if out is not None:
                found[r.name] = out
        return found


def remediate(df: DataFrame, fixes: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(fixed rows, preview of what changes: key, path, old, new)."""
    fixed = df.withColumns(fixes)
    rows = [
        F.when(~F.col(f).eqNullSafe(c), F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("old"), c.cast("string").alias("new")))
        for f, c in fixes.items()
    ]
    preview = df.select(F.col(key).alias("row_id"), F.explode(F.array_compact(F.array(*rows))).alias("c")).select("row_id", "c.*")
    return fixed, preview
