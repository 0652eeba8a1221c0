"""Aggregates of child rows per parent key, all functions of an edge in one pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.functions.aggregates import AGGREGATES
from relloom.functions.predicates import Predicate
from relloom.operators.lookup import attach, hot_keys

# From this many equality counts on one column, a pivot beats conditional counts.
PIVOT_FROM = 32
# Values that a function's state holds; from this many functions on, rows may be sent instead.
STATE_VALUES = {"avg": 2, "std": 3}
WIDE_FROM = 16
# How many times the bytes of one merged state a key's rows may be: rows that do not lie by
# their key make a state in nearly every task.
ROWS_FOR_STATE = 2


@dataclass(frozen=True)
class AggSpec:
    """``function(column)`` of the rows passing ``predicate``, stored as ``name``."""

    name: str
    function: str
    column: str | None = None
    predicate: Predicate | None = None


def _expression(spec: AggSpec, fk: str, already: frozenset) -> Column:
    """The aggregate, conditional on comparisons the scan does not already apply."""
    function = AGGREGATES[spec.function]
    rest = [c for c in spec.predicate.comparisons if c not in already] if spec.predicate else []
    source = F.col(f"`{fk if function.counts_rows else spec.column}`")
    if not rest:
        return function.build(source).alias(spec.name)
    inside = F.when(Predicate(tuple(rest)).to_column(), source)
    value = function.build(inside)
    if function.counts_rows:
        value = F.nullif(value, F.lit(0))
    return value.alias(spec.name)


def _rows_are_smaller(keys: DataFrame, fk: str, specs: Sequence[AggSpec]) -> bool:
    """Whether the rows of a key are few enough to be sent instead of the states of tasks.

    Then summing up before the shuffle saves little and may cost much. Hot keys keep their states.
    """
    if len(specs) < WIDE_FROM:
        return False
    columns = {s.column for s in specs if s.column} | {c for s in specs if s.predicate for c in s.predicate.columns} | {fk}
    wide = sum(STATE_VALUES.get(s.function, 1) for s in specs)
    found = keys.agg(F.count(f"`{fk}`").alias("n"), F.approx_count_distinct(f"`{fk}`").alias("keys")).first()
    few = found["n"] * len(columns) <= ROWS_FOR_STATE * wide * found["keys"]
    return few and not any(key is not None for key in hot_keys(keys, fk))


def aggregate(
    child: DataFrame, fk: str, specs: Sequence[AggSpec], keys_from: DataFrame | None = None
) -> DataFrame:
    """One row per foreign key value, one column per spec; NULL where no row counts.

    Comparisons shared by all specs become one filter that reaches the scan. Counts
    of many values of a column, and functions repeated over many time windows, are
    pivots: a row is added to the one group it belongs to instead of being tested
    against every condition; the results are the same. ``keys_from``, the table that the
    foreign keys come from, tells whether rows are sent to their key before they are summed up.
    """
    rows = child.where(F.col(f"`{fk}`").isNotNull())
    shared = _shared_comparisons(specs)
    if shared:
        rows = rows.where(Predicate(tuple(shared)).to_column())
    by_value, by_window = defaultdict(list), defaultdict(list)
    for spec in specs:
        rest = _rest(spec, shared)
        if AGGREGATES[spec.function].counts_rows and len(rest) == 1 and rest[0].op == "=":
            by_value[rest[0].column].append(spec)
        elif spec.predicate and spec.predicate.interval is not None and len({c.column for c in rest}) == 1:
            by_window[rest[0].column].append(spec)
    pivots = []
    for column, found in by_value.items():
        if len(found) >= PIVOT_FROM:
            pivots.append((found, _pivot_values(rows, fk, column, found, shared)))
    for found in by_window.values():
        if len(found) >= PIVOT_FROM:
            pivots.append((found, _pivot_windows(rows, fk, found, shared)))
    pivoted = {s.name for found, _ in pivots for s in found}
    # Without plain specs a count of rows keeps every key of the pivots in one frame.
    plain = [_expression(s, fk, shared) for s in specs if s.name not in pivoted]
    if keys_from is not None and not pivots and _rows_are_smaller(keys_from, fk, specs):
        rows = rows.repartition(F.col(f"`{fk}`"))
    out = rows.groupBy(fk).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
    for _, pivot in pivots:
        out = attach(out, fk, pivot, fk)
    return out.select(fk, *[s.name for s in specs])


def _shared_comparisons(specs: Sequence[AggSpec]) -> frozenset:
    sets = [frozenset(s.predicate.comparisons) if s.predicate else frozenset() for s in specs]
    return frozenset.intersection(*sets) if sets else frozenset()


def _rest(spec: AggSpec, shared: frozenset) -> list:
    """The comparisons of a spec that the shared filter does not cover."""
    return [c for c in spec.predicate.comparisons if c not in shared] if spec.predicate else []


def _pivot_values(rows: DataFrame, fk: str, column: str, specs: Sequence[AggSpec], shared: frozenset) -> DataFrame:
    """Functions of the rows that have a value: every row goes to its own value only."""
    values = list(dict.fromkeys(_rest(s, shared)[0].value for s in specs))
    functions = list(dict.fromkeys(s.function for s in specs))
    built = [AGGREGATES[f].build(F.col(f"`{fk}`")).alias(f"_{i}") for i, f in enumerate(functions)]
    wide = rows.groupBy(fk).pivot(column, values).agg(*built)
    cells = {(v, f): f"_{i}" for i, (v, f) in enumerate((v, f) for v in values for f in functions)}
    wide = wide.toDF(fk, *cells.values())
    # as without a pivot, a function of no rows is NULL
    return wide.select(
        fk, *[F.nullif(F.col(cells[_rest(s, shared)[0].value, s.function]), F.lit(0)).alias(s.name) for s in specs]
    )


def _pivot_windows(rows: DataFrame, fk: str, specs: Sequence[AggSpec], shared: frozenset) -> DataFrame:
    """Functions of disjoint time windows: every row goes to its own window only."""
    windows = {s.predicate.interval: Predicate(tuple(_rest(s, shared))) for s in specs}
    number = F.coalesce(*[F.when(p.to_column(), F.lit(n)) for n, p in windows.items()])
    functions = dict.fromkeys((s.function, s.column) for s in specs)
    values = []
    for function, column in functions:
        build = AGGREGATES[function]
        values.append(build.build(F.col(f"`{fk if build.counts_rows else column}`")))
    inside = rows.withColumn("_window", number).where(F.col("_window").isNotNull())
    aliased = [v.alias(f"_{i}") for i, v in enumerate(values)]
    wide = inside.groupBy(fk).pivot("_window", list(windows)).agg(*aliased)
    cells = [(n, f) for n in windows for f in functions]
    names = {(s.predicate.interval, (s.function, s.column)): s.name for s in specs}
    wide = wide.toDF(fk, *[names.get(cell, f"_unused_{i}") for i, cell in enumerate(cells)])
    return wide.select(fk, *[s.name for s in specs])


def category_counts(
    child: DataFrame, fk: str, column: str, names: dict[Any, str], predicate: Predicate | None = None
) -> DataFrame:
    """``COUNT`` of the child rows for every value of a category."""
    specs = []
    for value, name in names.items():
        equal = Predicate.of((column, "=", value))
        specs.append(AggSpec(name, "COUNT", None, equal & predicate if predicate else equal))
    return aggregate(child, fk, specs)


def aggregate_onto(
    parent: DataFrame, key: str, child: DataFrame, fk: str, specs: Sequence[AggSpec]
) -> DataFrame:
    """Aggregates attached to the parent; a parent without matching rows keeps NULL."""
    return attach(parent, key, aggregate(child, fk, specs), fk)


def mean_gap_days(child: DataFrame, fk: str, ts: str, name: str = "mean_gap") -> DataFrame:
    """Mean whole days between the events of a key; NULL for a single event."""
    span = F.timestamp_diff("DAY", F.min(ts), F.max(ts))
    gap = span / F.nullif(F.count(ts) - 1, F.lit(0))
    return child.where(F.col(fk).isNotNull()).groupBy(fk).agg(gap.alias(name))


def distinct_per_key(child: DataFrame, fk: str, column: str, name: str) -> DataFrame:
    """Distinct values per key; Spark groups by key and value first, so hot keys spread."""
    return child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count_distinct(column).alias(name))
