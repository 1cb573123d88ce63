"""Mappings to column expressions: JSON text to attributes and back.

Reading is one projection: extract, map missing states, load, cast, default.
Every object is parsed once, to a map of its keys' texts, however many attributes
and aliases look into it. Writing is one expression per row: dump, map missing
states, assemble.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declario.functions import casts, variants
from declario.operators.shared import items
from declario.plans.mapping import Keyed, Mapping, Rule
from declario.plans.model import Attribute, Model, Reference


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def members(text: Column) -> Column:
    """The members of a JSON object as texts by key; null where it isn't one."""
    return F.from_json(text, "map<string,string>")


def extract(obj: Column, rule: Rule) -> tuple[Column, Column]:
    """(raw text, present): of the first of the rule's names that is present in
    members(), null values included."""
    for key in rule.path:
        obj = members(F.try_element_at(obj, F.lit(key)))
    raw, found = F.lit(None).cast("string"), F.lit(False)
    for name in reversed(rule.names):
        here = F.coalesce(F.map_contains_key(obj, name), F.lit(False))
        raw = F.when(here, F.try_element_at(obj, F.lit(name))).otherwise(raw)
        found = found | here
    return raw, found


def _one(raw: Column, a: Attribute) -> Column:
    """A single value from its JSON text."""
    if isinstance(a.type, Model):
        return read(raw, Mapping(a.type))
    if isinstance(a.type, list):
        return variants.union(raw, a.type)
    return casts.cast("string" if isinstance(a.type, Reference) else a.type, raw)


def _value(raw: Column, a: Attribute, rule: Rule) -> Column:
    if not a.collection:
        return _one(raw, a)
    if rule.delimiter is not None:
        items = F.split(raw, f"\\Q{rule.delimiter}\\E")
    else:
        items = F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))  # a single value is a collection of one
    return F.transform(items, lambda x: _one(x, a))


def _state(name: str, raw: Column, kind: T.DataType) -> Column:
    """The value that a missing state is read as."""
    if name == "empty":
        return F.array().cast(kind) if isinstance(kind, T.ArrayType) else F.lit("").cast(kind) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)
    if name in ("true", "false"):
        return F.lit(name == "true")
    return F.lit(None).cast(kind)


def _by_format(f, fmt: str):
    return f.get(fmt) if isinstance(f, dict) else f


def attribute(obj: Column, rule: Rule, a: Attribute, fmt: str = "json") -> Column:
    """One attribute from the members() of a document."""
    if rule.reader:
        return rule.reader(obj)

    def of(found: Column) -> Column:
        return _attribute(found.raw, found.here, rule, a)

    raw, here = extract(obj, rule)
    if load := _by_format(rule.load, fmt):
        raw = load(raw)
    return let(F.struct(raw.alias("raw"), here.alias("here")), of)


def _attribute(raw: Column, found: Column, rule: Rule, a: Attribute) -> Column:
    value = _value(raw, a, rule)
    if rule.attribute_load:
        value = rule.attribute_load(value)
    kind = a.spark_type()
    empty = (raw == "[]") if a.collection else (raw == "")
    omitted = a.default if a.default is not None and not callable(a.default) else None
    when_omitted = F.lit(omitted).cast(kind) if omitted is not None else _state(rule.taken("omitted"), raw, kind)
    return (
        F.when(~found, when_omitted)
        .when(raw.isNull(), _state(rule.taken("nil"), raw, kind))
        .when(empty, _state(rule.taken("empty"), raw, kind))
        .otherwise(value)
    )


def read(text: Column, mapping: Mapping, fmt: str = "json") -> Column:
    """A struct of the model from JSON text, null where it isn't an object."""
    if mapping.whole:
        return F.struct(text.alias(mapping.whole))

    def fields(obj: Column) -> Column:
        own = {r.to: r for r in mapping.all()}
        out = []
        for a in mapping.model.attributes:
            if a.derived is None and a.name in own and not own[a.name].delegate:
                out.append(attribute(obj, own[a.name], a, fmt).alias(a.name))
            elif a.derived is None and isinstance(a.type, Model) and any(r.delegate == a.name for r in own.values()):
                inner = [attribute(obj, r, a.type[r.to], fmt).alias(r.to) for r in own.values() if r.delegate == a.name]
                out.append(F.struct(*inner).alias(a.name))
        return F.when(obj.isNotNull(), F.struct(*out))

    obj = members(text)
    return let(members(F.try_element_at(obj, F.lit(mapping.root))) if mapping.root else obj, fields)


def finish(df: DataFrame, model: Model) -> DataFrame:
    """Defaults that use other attributes, and derived attributes."""
    late = {a.name: F.coalesce(F.col(a.name), a.default(df)) for a in model.attributes if callable(a.default)}
    df = df.withColumns(late) if late else df
    derived = {a.name: a.derived(df) for a in model.attributes if a.derived is not None}
    return df.withColumns(derived) if derived else df


def read_frame(df: DataFrame, mapping: Mapping, column: str = "value", keep: tuple[str, ...] = (), fmt: str = "json") -> DataFrame:
    """Documents of a text column as rows of the model."""
    rows = df.select(*keep, read(F.col(column), mapping, fmt).alias("_m")).select(*keep, "_m.*")
    return finish(rows, mapping.model)


def written(value: Column, a: Attribute, rule: Rule, fmt: str) -> Column:
    """A value as JSON text."""

    def one(c: Column) -> Column:
        if isinstance(a.type, Model):
            return write(c, Mapping(a.type), fmt)
        if isinstance(a.type, list):
            return F.coalesce(*(F.to_json(F.struct(c[m].alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c[m].alias("v")))) - 6) if m == "string" else casts.serialize(m, c[m], fmt) for m in a.type))
        code = "string" if isinstance(a.type, Reference) else a.type
        text = casts.serialize(code, c, fmt)
        if code in ("integer", "float", "double", "boolean", "hash", "decimal"):
            return text
        return quoted(text)

    if a.collection and rule.delimiter is not None:
        return quoted(F.array_join(value, rule.delimiter))
    if a.collection:
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.coalesce(one(x), F.lit("null"))), ","), F.lit("]"))
    return one(value)


def quoted(c: Column) -> Column:
    """A JSON string."""
    return F.when(c.isNotNull(), let(F.to_json(F.struct(c.alias("v"))), lambda s: F.substr(s, F.lit(6), F.length(s) - 6)))


def write(row: Column, mapping: Mapping, fmt: str = "json") -> Column:
    """JSON text of a model struct; fields are written, null, or left out by rule."""
    if mapping.whole:
        return row[mapping.whole]
    parts = []
    for rule in mapping.all():
        source = row[rule.delegate] if rule.delegate else row
        model = mapping.model[rule.delegate].type if rule.delegate else mapping.model
        a = model[rule.to]
        value = source[rule.to]
        if rule.attribute_dump:
            value = rule.attribute_dump(value)
        if dump := _by_format(rule.dump, fmt):
            value = dump(value)
        empty = F.size(value) == 0 if a.collection else (value == "") if isinstance(a.spark_type(), T.StringType) else F.lit(False)
        state = {"omitted": F.lit(None).cast("string"), "nil": F.lit("null"), "empty": F.lit("[]" if a.collection else '""')}
        body = F.when(source[rule.to].isNull(), state[rule.given("nil")]).when(empty, state[rule.given("empty")]).otherwise(written(value, a, rule, fmt))
        if rule.writer:
            body = rule.writer(row)
        if a.default is not None and not callable(a.default) and not rule.render_default and a.derived is None and not a.collection:
            body = F.when(~source[rule.to].eqNullSafe(F.lit(a.default)), body)
        for key in reversed((*rule.path, rule.names[0])):
            body = F.concat(F.lit(f'"{key}":' if key == (*rule.path, rule.names[0])[0] else f'{{"{key}":'), body, F.lit("" if key == (*rule.path, rule.names[0])[0] else "}"))
        parts.append(body)
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    text = F.when(row.isNotNull(), text)
    return F.concat(F.lit(f'{{"{mapping.root}":'), text, F.lit("}")) if mapping.root else text


def write_frame(df: DataFrame, mapping: Mapping, fmt: str = "json", column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the model as documents of a text column."""
    names = [a.name for a in mapping.model.attributes]
    return df.select(*keep, write(F.struct(*(F.col(n) for n in names)), mapping, fmt).alias(column))


def unkey(text: Column, key: str, value_schema: str) -> Column:
    """A keyed object to an array of (key, value): the key becomes an attribute."""
    return F.transform(F.map_entries(F.from_json(text, f"map<string,{value_schema}>")), lambda e: F.struct(e.key.alias(key), e.value.alias("value")))


def read_keyed(df: DataFrame, keyed: Keyed, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents that are maps: one row of the model for each member, in no order."""
    entries = items(df, F.map_entries(members(F.col(column))), "_e", *keep)
    key, value = F.col("_e.key"), F.col("_e.value")
    model, fields = keyed.mapping.model, []
    rules = {r.to: r for r in keyed.mapping.all()}
    obj = members(value)
    for a in model.attributes:
        where = keyed.parts.get(a.name)
        if where is None:  # an attribute of the value object
            fields.append(attribute(obj, rules[a.name], a).alias(a.name))
        elif isinstance(where, str) and where in (":key", ":value"):
            fields.append(_one(key if where == ":key" else value, a).alias(a.name))
        else:
            path = (where,) if isinstance(where, str) else where
            fields.append(attribute(obj, Rule((path[-1],), a.name, path=tuple(path[:-1])), a).alias(a.name))
    return entries.select(*keep, *fields)


def write_keyed(df: DataFrame, keyed: Keyed, by: tuple[str, ...], fmt: str = "json", column: str = "value") -> DataFrame:
    """Rows of the model as one map document for each group, ordered by key."""
    model = keyed.mapping.model
    name = next(n for n, where in keyed.parts.items() if where == ":key")
    only = next((n for n, where in keyed.parts.items() if where == ":value"), None)
    if only:
        body = written(F.col(only), model[only], Rule((only,), only), fmt)
    else:
        names = [a.name for a in model.attributes]
        body = write(F.struct(*(F.col(n) for n in names)), keyed.mapping.without(name), fmt)
    key = F.col(name).cast("string")
    rows = df.where(key.isNotNull()).select(*by, key.alias("_k"), F.concat(quoted(key), F.lit(":"), body).alias("_v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda x: x["_v"])
    return rows.groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias(column))


def read_instances(df: DataFrame, name: str, mapping: Mapping, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents whose member ``name`` is an array of items: a row of the model for
    each, with its place."""
    listed = F.from_json(F.try_element_at(members(F.col(column)), F.lit(name)), "array<string>")
    return read_frame(items(df, listed, "_i", *keep, pos="pos"), mapping, "_i", (*keep, "pos"))


def with_parent(df: DataFrame, parent: str, children: str, keep: tuple[str, ...]) -> DataFrame:
    """Items of a nested collection as rows that can see their parent and its place."""
    kept = F.struct(*(F.col(f"{parent}.{k}") for k in keep)).alias("parent")
    return items(df, f"{parent}.{children}", "_i", kept, pos="pos").select("parent", "pos", "_i.*")
