"""Metadata predicates: a small tree and its two compilers.

``direct`` judges each row: a row without the key is unequal to everything, so
``!=`` and ``not in`` hold for it. ``indexed`` judges by postings: a row without
the key is in no posting list, so they do not. Direct is the default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecmill.types import Meta


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def leaves(self) -> Iterator[Leaf]:
        raise NotImplementedError

    def keys(self) -> set[str]:
        return {leaf.key for leaf in self.leaves()}


@dataclass(frozen=True)
class Leaf(Predicate):
    key: str

    def leaves(self) -> Iterator[Leaf]:
        yield self


@dataclass(frozen=True)
class Equals(Leaf):
    value: Meta | str


@dataclass(frozen=True)
class NotEquals(Leaf):
    value: Meta | str


@dataclass(frozen=True)
class In(Leaf):
    values: tuple[Meta | str, ...]


@dataclass(frozen=True)
class NotIn(Leaf):
    values: tuple[Meta | str, ...]


@dataclass(frozen=True)
class _Both(Predicate):
    left: Predicate
    right: Predicate

    def leaves(self) -> Iterator[Leaf]:
        yield from self.left.leaves()
        yield from self.right.leaves()


class And(_Both):
    pass


class Or(_Both):
    pass


def tagged(value: Meta | str) -> Column:
    """A value with its kind, comparable with a metadata entry: text 1 is not image byte 0x31."""
    v = Meta.of(value)
    empty = F.lit(None)
    return F.struct(F.lit(v.kind).alias("kind"), (F.lit(v.data) if v.kind == "str" else empty).cast("string").alias("str"),
        (F.lit(bytearray(v.data)) if v.kind != "str" else empty).cast("binary").alias("bin"))


def entry(value: str = "value") -> Callable[[str], Column]:
    """How to reach a key's entry in a map column."""
    return lambda key: F.try_element_at(F.col(value), F.lit(key))


def columns_entry(columns: dict[str, str]) -> Callable[[str], Column]:
    """How to reach entries kept as plain string columns: a null is a missing key, filters reach the scan."""
    return lambda key: F.col(columns[key])


def compile_predicate(condition: Predicate | None, get: Callable[[str], Column] | None = None, semantics: str = "direct",
    literal: Callable[[Meta | str], Column] = tagged, posted: set[str] | None = None) -> Column:
    """A Boolean column, never null.

    ``indexed`` applies to the keys in ``posted`` (to all, if that is None);
    the other keys are judged directly.
    """
    if semantics not in ("direct", "indexed"):
        raise ValueError(f"no such semantics: {semantics}")
    get = get or entry()

    def any_of(key: str, values: Sequence[Meta | str]) -> Column:
        found = F.lit(False)
        for v in values:
            found = found | get(key).eqNullSafe(literal(v))
        return found

    def build(p: Predicate) -> Column:
        match p:
            case And():
                return build(p.left) & build(p.right)
            case Or():
                return build(p.left) | build(p.right)
            case Equals():
                return get(p.key).eqNullSafe(literal(p.value))
            case In():
                return any_of(p.key, p.values)
            case NotEquals():
                refused = get(p.key).eqNullSafe(literal(p.value))
            case NotIn():
                refused = any_of(p.key, p.values)
            case _:
                raise ValueError(f"not a predicate: {p!r}")
        if semantics == "indexed" and (posted is None or p.key in posted):
            return get(p.key).isNotNull() & ~refused
        return ~refused

    return build(condition) if condition is not None else F.lit(True)


def plain(value: Meta | str) -> Column:
    """Text values for entries kept as string columns."""
    v = Meta.of(value)
    if v.kind != "str":
        raise ValueError("string columns hold texts alone")
    return F.lit(v.data)
