"""Registry of the aggregates used in feature synthesis.

Every function maps a column to an aggregate expression, so all functions of one
edge run in one ``groupBy``. ``not_over`` lists aggregates that may not appear on
the lineage of the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    name: str
    build: Callable[[Column], Column]
    not_over: frozenset[str] = frozenset()
    counts_rows: bool = False


AGGREGATES: dict[str, Aggregate] = {}


def register_aggregate(
    name: str, build: Callable[[Column], Column], not_over: tuple[str, ...] = (), counts_rows: bool = False
) -> None:
    """Add an aggregate; synthesis applies them in order of registration."""
    AGGREGATES[name] = Aggregate(name, build, frozenset(not_over), counts_rows)


# Names, order and prohibited inputs of the built-in aggregates.
register_aggregate("COUNT", F.count, counts_rows=True)
register_aggregate("sum", lambda c: F.sum(c).cast("double"), not_over=("max", "min"))
register_aggregate("avg", lambda c: F.avg(c).cast("double"))
register_aggregate("max", lambda c: F.max(c).cast("double"), not_over=("min",))
register_aggregate("std", lambda c: F.stddev_pop(c.cast("double")), not_over=("std",))
register_aggregate("min", lambda c: F.min(c).cast("double"), not_over=("max",))
