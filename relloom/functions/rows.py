"""Registry of row functions: one value of a row in, one value out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowFunction:
    name: str
    label: str
    build: Callable[[Column], Column]
    accepts: str  # "text" or "date"
    numeric: bool
    categorical: bool


ROW_FUNCTIONS: dict[str, RowFunction] = {}


def register_row_function(
    name: str,
    label: str,
    build: Callable[[Column], Column],
    accepts: str,
    numeric: bool = False,
    categorical: bool = False,
) -> None:
    ROW_FUNCTIONS[name] = RowFunction(name, label, build, accepts, numeric, categorical)


# Text length counts bytes, weekdays run from Monday = 0 to Sunday = 6.
register_row_function("text_length", "length", F.octet_length, "text", numeric=True)
register_row_function("weekday", "weekday", F.weekday, "date", categorical=True)
register_row_function("month", "month", F.month, "date", categorical=True)


def chosen_row_functions(
    included: Iterable[str] | None = None, excluded: Iterable[str] = ()
) -> list[RowFunction]:
    """Functions left after the include and exclude lists; all when none is included.

    A function answers to its name and to its label.
    """
    excluded = set(excluded)
    wanted = None if included is None else set(included)
    return [
        f
        for f in ROW_FUNCTIONS.values()
        if (wanted is None or wanted & {f.name, f.label}) and not excluded & {f.name, f.label}
    ]


def is_date(dtype: str) -> bool:
    return dtype in ("date", "timestamp", "timestamp_ntz")


def add_row_features(
    df: DataFrame,
    keys: Iterable[str] = (),
    text: Iterable[str] = (),
    included: Iterable[str] | None = None,
    excluded: Iterable[str] = (),
) -> DataFrame:
    """All chosen row functions over all allowed non-key columns, in one projection."""
    keys, text = set(keys), set(text)
    existing = set(df.columns)
    added = []
    for func in chosen_row_functions(included, excluded):
        for name, dtype in df.dtypes:
            allowed = name in text if func.accepts == "text" else is_date(dtype)
            target = f"{func.label}({name})"
            if allowed and name not in keys and target not in existing:
                added.append(func.build(F.col(f"`{name}`")).alias(target))
    return df.select("*", *added)
