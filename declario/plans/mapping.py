"""Mappings: how a document's fields become a model's attributes and back.

Three missing states are kept apart where the source can tell them: a field is
omitted, null, or empty. Each rule maps them on reading (``take``) and on
writing (``give``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from declario.plans.model import Model

STATES = ("omitted", "nil", "empty")
#: What a state becomes by default, reading and writing.
TAKE = {"omitted": "nil", "nil": "nil", "empty": "empty"}
GIVE = {"omitted": "omitted", "nil": "omitted", "empty": "omitted"}


@dataclass(frozen=True)
class Rule:
    """``names``: the first that is present counts on reading, the first is
    written. ``path``: nested keys around them. ``delegate``: the attribute is a
    field of this nested model. ``load`` and ``dump`` are column functions, for
    the rule; ``attribute_load`` and ``attribute_dump`` for the attribute: load
    runs rule then attribute, dump attribute then rule. ``load`` and ``dump`` may
    also be dicts by format. ``reader`` makes the value from the document's members
    (a map of texts by key), ``writer`` its JSON text from the model's struct.
    """

    names: tuple[str, ...]
    to: str
    path: tuple[str, ...] = ()
    delegate: str | None = None
    take: dict[str, str] = field(default_factory=dict)
    give: dict[str, str] = field(default_factory=dict)
    render_default: bool = False
    delimiter: str | None = None
    load: Callable[[Column], Column] | dict[str, Callable[[Column], Column]] | None = None
    dump: Callable[[Column], Column] | dict[str, Callable[[Column], Column]] | None = None
    attribute_load: Callable[[Column], Column] | None = None
    attribute_dump: Callable[[Column], Column] | None = None
    reader: Callable[[Column], Column] | None = None
    writer: Callable[[Column], Column] | None = None

    def taken(self, state: str) -> str:
        return (TAKE | self.take)[state]

    def given(self, state: str) -> str:
        return (GIVE | self.give)[state]


def field_(name: str | list[str], to: str, render_nil: bool | str = False, render_empty: bool | str = False, **k) -> Rule:
    """A rule, with the short options for missing values.

    render_nil and render_empty: False omits, True writes the state as it is,
    or ``omit``, ``as_nil``, ``as_empty``.
    """
    words = {"omit": "omitted", "as_nil": "nil", "as_empty": "empty"}
    give = dict(k.pop("give", {}))
    for state, option in (("nil", render_nil), ("empty", render_empty)):
        give.setdefault(state, state if option is True else "omitted" if option is False else words[option])
    return Rule(tuple(name) if isinstance(name, list) else (name,), to, give=give, **k)


@dataclass(frozen=True)
class Mapping:
    """Rules of one format. ``root``: the key that wraps the document. ``whole``: the
    attribute that takes the document as it is written, beside which no rule may stand.
    """

    model: Model
    rules: tuple[Rule, ...] = ()
    root: str | None = None
    whole: str | None = None

    def __post_init__(self):
        if self.whole and self.rules:
            raise ValueError(f"{self.whole} takes the whole document, so there can be no other rules")

    def all(self) -> tuple[Rule, ...]:
        """Without rules, every attribute under its own name."""
        if self.whole:
            return ()
        return self.rules or tuple(Rule((a.name,), a.name) for a in self.model.attributes)

    def only(self, *names: str) -> Mapping:
        return Mapping(self.model, tuple(r for r in self.all() if r.to in names), self.root)

    def without(self, *names: str) -> Mapping:
        return Mapping(self.model, tuple(r for r in self.all() if r.to not in names), self.root)


@dataclass(frozen=True)
class Transformer:
    """Conversions of a value by format: ``loads`` on reading, ``dumps`` on writing."""

    loads: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    dumps: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def options(self) -> dict:
        """For a rule: Rule(..., **t.options())."""
        return {"load": self.loads, "dump": self.dumps}


@dataclass(frozen=True)
class Keyed:
    """A document that is a map of items. ``parts``: attributes and where they come
    from: ``:key``, ``:value``, or a path of keys in the value. With ``:key`` alone
    the value is an object of the other attributes.
    """

    mapping: Mapping
    parts: dict[str, str | tuple[str, ...]]


@dataclass
class Mappings:
    """Mappings by format; JSON Lines and YAML streams fall back to the base format's."""

    by_format: dict[str, Mapping]

    #: Whose mapping a format uses if it has none.
    BASE = {"jsonl": "json", "yamls": "yaml", "jsonld": "json", "yamlld": "yaml"}

    def of(self, fmt: str) -> Mapping:
        if fmt in self.by_format:
            return self.by_format[fmt]
        return self.by_format[self.BASE[fmt]]
