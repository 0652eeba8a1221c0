"""Time windows that walk back from the latest timestamp of a table."""

from __future__ import annotations

from datetime import datetime, time, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.functions.predicates import Comparison, Predicate
from relloom.operators.profile import wall_range


def _text(moment: datetime) -> str:
    return moment.isoformat(sep=" ")


def window_bounds(latest: Any, earliest: Any, n: int = 10, days: int = 7) -> list[tuple[int, str, str]]:
    """Windows ``(lower, upper]`` as ``(number, lower, upper)``, newest first.

    The newest has number ``n - 1``. The walk stops at ``n`` windows or once the
    lower bound has passed the earliest value.
    """
    if latest is None:
        return []
    if not isinstance(latest, datetime):
        latest, earliest = (datetime.combine(d, time()) for d in (latest, earliest))
    bounds = []
    for number in range(n - 1, -1, -1):
        lower = latest - timedelta(days=days)
        bounds.append((number, _text(lower), _text(latest)))
        latest = lower
        if lower < earliest:
            break
    return bounds


def interval_predicates(
    column: str, latest: Any, earliest: Any, n: int = 10, days: int = 7, title: str | None = None
) -> list[Predicate]:
    return [
        Predicate(
            (Comparison(column, "<=", upper, title), Comparison(column, ">", lower, title)),
            f"int={number}",
            number,
        )
        for number, lower, upper in window_bounds(latest, earliest, n, days)
    ]


def interval_number(ts: str, bounds: list[tuple[int, str, str]]) -> Column:
    """Number of the window a timestamp falls in, NULL before the oldest window."""
    if not bounds:
        return F.lit(None).cast("int")
    number = None
    for n, lower, _ in bounds:
        inside = F.col(ts) > lower
        number = F.when(inside, n) if number is None else number.when(inside, n)
    return number


def interval_rows(
    child: DataFrame, fk: str, ts: str, value: str, n: int = 10, days: int = 7
) -> DataFrame:
    """Long form: ``fk, interval, n, total`` for every window that has rows."""
    extent = wall_range(child, ts).first()
    bounds = window_bounds(extent.max_value, extent.min_value, n, days)
    return (
        child.where(F.col(fk).isNotNull())
        .select(fk, value, interval_number(ts, bounds).alias("interval"))
        .where(F.col("interval").isNotNull())
        .groupBy(fk, "interval")
        .agg(F.count(fk).alias("n"), F.sum(value).alias("total"))
    )
