"""Model declarations: plain Python, no Spark job.

A model compiles to a StructType. Everything here runs on the driver, on
declarations of a few dozen names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from declario.functions.casts import TYPES


@dataclass(frozen=True)
class Reference:
    """A key of another model's collection."""

    model: str
    key: str


@dataclass(frozen=True)
class Attribute:
    """``type``: a type code, a Model, a Reference, or a list of codes (a union).

    ``collection``: False, True, or (min, max) with None for an open end.
    ``derived``: computed, never read. ``default``: a literal or a callable that
    gets the other columns by name and returns a column.
    """

    name: str
    type: Any = "string"
    collection: bool | tuple[int, int | None] = False
    default: Any = None
    values: tuple = ()
    pattern: str | None = None
    required: bool = False
    derived: Any = None

    def spark_type(self) -> T.DataType:
        one = self._one()
        return T.ArrayType(one) if self.collection else one

    def _one(self) -> T.DataType:
        if isinstance(self.type, Model):
            return self.type.schema()
        if isinstance(self.type, Reference):
            return T.StringType()
        if isinstance(self.type, list):
            fields = ["member string", *(f"{c} {TYPES[c][0]}" for c in self.type)]
            return T._parse_datatype_string(f"struct<{', '.join(f.replace(' ', ': ', 1) for f in fields)}>")
        return T._parse_datatype_string(TYPES[self.type][0])


@dataclass(frozen=True)
class Choice:
    """Between ``low`` and ``high`` of these attributes are present."""

    names: tuple[str, ...]
    low: int = 1
    high: int = 1

    def without(self, name: str) -> Choice:
        return replace(self, names=tuple(n for n in self.names if n != name))


@dataclass(frozen=True)
class Model:
    name: str
    attributes: tuple[Attribute, ...]
    choices: tuple[Choice, ...] = ()
    root: str | None = None
    sequence: tuple[str, ...] = ()

    def __getitem__(self, name: str) -> Attribute:
        return next(a for a in self.attributes if a.name == name)

    def schema(self) -> T.StructType:
        """Without derived attributes, which aren't read."""
        return T.StructType([T.StructField(a.name, a.spark_type()) for a in self.attributes if a.derived is None])

    def ddl(self) -> str:
        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema().fields)

    # composition

    def extend(self, name: str, *attributes: Attribute, **more) -> Model:
        """Inheritance: attributes of the same name are overridden in place."""
        own = {a.name: a for a in attributes}
        base = tuple(own.pop(a.name, a) for a in self.attributes)
        return replace(self, name=name, attributes=base + tuple(own.values()), **more)

    def restrict(self, attribute: str, **options) -> Model:
        """Merge options into an attribute."""
        if attribute not in [a.name for a in self.attributes]:
            raise KeyError(f"{self.name} has no attribute {attribute}")
        return replace(self, attributes=tuple(replace(a, **options) if a.name == attribute else a for a in self.attributes))

    def include_attributes(self, other: Model, *names: str) -> Model:
        """Import attributes only, all or some, without choices."""
        if other.root:
            raise ValueError(f"{other.name} has a root and can't be imported")
        own = tuple(a for a in other.attributes if not names or a.name in names)
        taken = {a.name for a in own}
        return replace(self, attributes=tuple(a for a in self.attributes if a.name not in taken) + own)

    def remove(self, name: str) -> Model:
        """Without an attribute, in choices too."""
        kept = tuple(c for c in (c.without(name) for c in self.choices) if c.names)
        return replace(self, attributes=tuple(a for a in self.attributes if a.name != name), choices=kept)

    def include(self, other: Model) -> Model:
        """Import another model's attributes and choices; one with a root can't be."""
        if other.root:
            raise ValueError(f"{other.name} has a root and can't be imported")
        own = {a.name for a in other.attributes}
        kept = tuple(a for a in self.attributes if a.name not in own)
        return replace(self, attributes=kept + other.attributes, choices=self.choices + other.choices)


@dataclass
class Register:
    """Names to models and type codes: own ones, then fallbacks depth first.

    ``substitutes`` rewrite a type wherever it is resolved. A name may be
    declared later than it is used: link() resolves it.
    """

    name: str
    fallbacks: list[Register] = field(default_factory=list)
    models: dict[str, Model] = field(default_factory=dict)
    substitutes: dict[str, str] = field(default_factory=dict)
    namespaces: dict[str, Register] = field(default_factory=dict)  # by namespace IRI

    def add(self, model: Model) -> Model:
        self.models[model.name] = model
        return model

    def add_tree(self, model: Model) -> None:
        self.add(model)
        for a in model.attributes:
            if isinstance(a.type, Model):
                self.add_tree(a.type)

    def bind(self, uri: str, register: Register) -> None:
        """Names written ``{uri}Name`` are looked up in ``register``."""
        self.namespaces[uri] = register

    def derive(self, name: str) -> Register:
        """A register of its own that falls back on this one."""
        return Register(name, [self])

    def isolate(self, name: str) -> Register:
        """A copy that later changes to this one don't reach."""
        return Register(name, list(self.fallbacks), dict(self.models), dict(self.substitutes), dict(self.namespaces))

    @contextlib.contextmanager
    def scope(self, *models: Model) -> Iterator[Register]:
        """Further models while a block runs."""
        before = dict(self.models)
        self.models |= {m.name: m for m in models}
        try:
            yield self
        finally:
            self.models = before

    def resolve(self, name: str) -> Model | str:
        if name.startswith("{"):
            uri, _, local = name[1:].partition("}")
            if uri not in self.namespaces:
                raise KeyError(f"no register is bound to {uri}")
            return self.namespaces[uri].resolve(local)
        name = self.substitutes.get(name, name)
        if name in self.models:
            return self.models[name]
        for r in self.fallbacks:
            try:
                return r.resolve(name)
            except KeyError:
                pass
        if name in TYPES:
            return name
        raise KeyError(f"{name} is neither a model nor a type of {self.name}")

    def link(self, model: Model, above: tuple[str, ...] = ()) -> Model:
        """A model whose types given by name are resolved; recursion is refused,
        because a StructType can't hold itself."""
        if model.name in above:
            raise ValueError(f"models contain each other: {' > '.join((*above, model.name))}")
        out = []
        for a in model.attributes:
            kind = a.type
            if isinstance(kind, str):
                kind = self.resolve(kind)
            if isinstance(kind, Model):
                kind = self.link(kind, (*above, model.name))
            out.append(replace(a, type=kind))
        return replace(model, attributes=tuple(out))
