"""Model to model: a mapping compiled to the target's columns, both ways."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Move:
    """``source`` and ``target`` are dotted names. ``nested`` maps a struct's
    fields, ``each`` those of every element of an array."""

    source: str
    target: str
    forth: Callable[[Column], Column] | None = None
    back: Callable[[Column], Column] | None = None
    nested: ModelMap | None = None
    each: ModelMap | None = None

    def reversed(self) -> Move:
        return Move(
            self.target, self.source, self.back, self.forth, self.nested and self.nested.reversed(), self.each and self.each.reversed()
        )


@dataclass(frozen=True)
class ModelMap:
    moves: tuple[Move, ...]

    def reversed(self) -> ModelMap:
        return ModelMap(tuple(m.reversed() for m in self.moves))

    def columns(self, get: Callable[[str], Column]) -> list[Column]:
        """Target columns, dotted targets packed into structs."""
        tree: dict = {}
        for m in self.moves:
            c = get(m.source)
            if m.nested:
                c = F.when(c.isNotNull(), F.struct(*m.nested.columns(_getter(c))))
            elif m.each:
                c = F.transform(c, _packer(m.each))
            if m.forth:
                c = m.forth(c)
            *above, last = m.target.split(".")
            node = tree
            for k in above:
                node = node.setdefault(k, {})
            node[last] = c
        return _packed(tree)


def _packer(m: ModelMap) -> Callable[[Column], Column]:
    return lambda x: F.struct(*m.columns(_getter(x)))


def _getter(c: Column) -> Callable[[str], Column]:
    def get(path: str) -> Column:
        out = c
        for k in path.split("."):
            out = out[k]
        return out

    return get


def _packed(tree: dict) -> list[Column]:
    return [(F.struct(*_packed(v)) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()]


def transform(df: DataFrame, m: ModelMap, *keep: str) -> DataFrame:
    return df.select(*keep, *m.columns(F.col))


def reverse(df: DataFrame, m: ModelMap, *keep: str) -> DataFrame:
    return transform(df, m.reversed(), *keep)
