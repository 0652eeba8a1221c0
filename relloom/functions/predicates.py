"""Conjunctive filters: comparisons joined by AND, with a readable label."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "LIKE": lambda c, v: c.like(v),
    "NOT LIKE": lambda c, v: ~c.like(v),
    "IN": lambda c, v: c.isin(*v),
    "NOT IN": lambda c, v: ~c.isin(*v),
}
_UNARY = {"IS NULL": Column.isNull, "IS NOT NULL": Column.isNotNull}


@dataclass(frozen=True)
class Comparison:
    """``column op value``; without a value the operator is a unary test.

    ``title`` is how labels name the column. A hidden comparison filters rows but
    stays out of labels and of the count of filters.
    """

    column: str
    op: str
    value: Any = None
    title: str | None = None
    hidden: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "op", " ".join(self.op.upper().split()))
        known = _UNARY if self.value is None else _BINARY
        if self.op not in known:
            raise ValueError(f"unknown operator {self.op!r} for value {self.value!r}")

    def to_column(self) -> Column:
        column = F.col(f"`{self.column}`")
        return _UNARY[self.op](column) if self.value is None else _BINARY[self.op](column, self.value)

    @property
    def label(self) -> str:
        value = "" if self.value is None else self.value
        return f"{self.title or self.column}{self.op}{value}"


@dataclass(frozen=True)
class Predicate:
    comparisons: tuple[Comparison, ...]
    given_label: str | None = None
    interval: int | None = None

    @classmethod
    def of(cls, *conditions: tuple[str, str, Any] | Comparison) -> Predicate:
        return cls(tuple(c if isinstance(c, Comparison) else Comparison(*c) for c in conditions))

    @property
    def label(self) -> str:
        if self.given_label is not None:
            return self.given_label
        return "_AND_".join(c.label for c in self.comparisons if not c.hidden)

    @property
    def columns(self) -> frozenset[str]:
        return frozenset(c.column for c in self.comparisons)

    @property
    def visible_titles(self) -> tuple[str, ...]:
        return tuple(c.title or c.column for c in self.comparisons if not c.hidden)

    def to_column(self) -> Column:
        return reduce(Column.__and__, (c.to_column() for c in self.comparisons))

    def __and__(self, other: Predicate) -> Predicate:
        label = "_AND_".join(text for text in (self.label, other.label) if text)
        numbers = [n for n in (self.interval, other.interval) if n is not None]
        return Predicate(self.comparisons + other.comparisons, label, max(numbers, default=None))
