"""Counts of categories with any number of values, as sparse blocks.

Values are numbered by a dictionary *table*, never collected. Counts are one ``groupBy`` of
the child by key and value (and time window), meet their numbers in a join, and are folded
to one row per key: the places that are not zero and their counts. A wide column per value is
made only of values the caller names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relloom.functions.predicates import Predicate
from relloom.operators.lookup import lookup_join
from relloom.operators.ordered import with_position
from relloom.operators.profile import distinct_values, wall_range
from relloom.runtime import materialize

DAY = 86_400_000_000  # microseconds


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``value, place``: the sorted distinct values numbered from 0; no NULL, no empty text."""
    codes = with_position(distinct_values(df, column), [F.col("value").asc()], "place")
    return materialize(codes, "dictionary")


def _known(child: DataFrame, fk: str, column: str, predicate: Predicate | None) -> DataFrame:
    rows = child.where(F.col(f"`{fk}`").isNotNull() & F.col(f"`{column}`").isNotNull())
    return rows.where(predicate.to_column()) if predicate else rows


def _folded(counts: DataFrame, fk: str, place: Column) -> DataFrame:
    """One row per key: the places and their counts, in ascending order of places.

    A key holds at most one entry for each place, whatever the number of its rows.
    """
    entry = F.struct(place.cast("long").alias("place"), F.col("n"))
    folded = counts.groupBy(F.col(fk).alias(fk)).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    return folded.select(fk, F.col("_entries.place").alias("places"), F.col("_entries.n").alias("counts"))


def _placed(counts: DataFrame, codes: DataFrame) -> DataFrame:
    """Counts with the place of their value; values outside the dictionary are left out."""
    right = codes.select(F.col("value").alias("_code"), F.col("place").alias("_place"))
    return lookup_join(counts, "_value", right, "_code").where(F.col("_place").isNotNull())


def sparse_counts(
    child: DataFrame, fk: str, column: str, codes: DataFrame, predicate: Predicate | None = None
) -> DataFrame:
    """``fk, places, counts``: how many rows of a key have each value of ``codes``.

    Keys without such rows have no row; NULL keys are left out, as in every aggregate.
    """
    rows = _known(child, fk, column, predicate).select(fk, F.col(f"`{column}`").alias("_value"))
    counts = rows.groupBy(fk, "_value").agg(F.count(F.lit(1)).alias("n"))
    return _folded(_placed(counts, codes), fk, F.col("_place"))


def window_number(ts: str, latest: Any, days: int, n: int) -> Column:
    """The number of the window ``(latest - (b + 1) days, latest - b days]``, by arithmetic.

    The newest of ``n`` is ``n - 1``; NULL before the oldest and after ``latest``.
    """
    wall = F.col(f"`{ts}`").cast("timestamp_ntz")
    back = F.timestamp_diff("MICROSECOND", wall, F.lit(latest).cast("timestamp_ntz"))
    steps = F.floor(back / F.lit(days * DAY))
    return F.when((steps >= 0) & (steps < n), F.lit(n - 1) - steps)


def sparse_cells(
    child: DataFrame, fk: str, ts: str, column: str, codes: DataFrame, n: int = 10, days: int = 7,
    predicate: Predicate | None = None,
) -> DataFrame:
    """``fk, places, counts`` over the cells of window and value.

    A cell's place is ``window * values + place of the value``. The child is scanned once,
    whatever the number of windows and values; the latest time comes from the file's
    statistics or a scan of that column alone.
    """
    latest = wall_range(child, ts).first()["max_value"]
    width = codes.count()
    rows = _known(child, fk, column, predicate)
    rows = rows.select(fk, F.col(f"`{column}`").alias("_value"), window_number(ts, latest, days, n).alias("_window"))
    counts = rows.where(F.col("_window").isNotNull()).groupBy(fk, "_window", "_value").agg(F.count(F.lit(1)).alias("n"))
    return _folded(_placed(counts, codes), fk, F.col("_window") * F.lit(width) + F.col("_place"))


def chosen(sparse: DataFrame, fk: str, names: Mapping[int, str]) -> DataFrame:
    """A column for each named place; NULL where a key has none, as without sparse blocks."""
    counts = F.map_from_arrays("places", "counts")
    return sparse.select(fk, *[F.try_element_at(counts, F.lit(p).cast("long")).alias(name) for p, name in names.items()])


def chosen_values(sparse: DataFrame, fk: str, codes: DataFrame, names: Mapping[Any, str]) -> DataFrame:
    """:func:`chosen` by values; one that the dictionary lacks is NULL everywhere."""
    # as many rows as there are names
    found = {r["value"]: r["place"] for r in codes.where(F.col("value").isin(list(names))).collect()}
    wide = chosen(sparse, fk, {found[v]: name for v, name in names.items() if v in found})
    absent = [F.lit(None).cast("long").alias(name) for v, name in names.items() if v not in found]
    return wide.select("*", *absent).select(fk, *names.values())


def one_hot_places(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``df`` with ``places`` and ``counts``: the value's place and 1; empty if it has none."""
    right = codes.select(F.col("value").alias("_code"), F.col("place").alias("_place"))
    placed = lookup_join(df, column, right, "_code")
    none = F.array().cast("array<bigint>")
    one = F.when(F.col("_place").isNotNull(), F.array(F.col("_place"))).otherwise(none)
    count = F.when(F.col("_place").isNotNull(), F.array(F.lit(1).cast("long"))).otherwise(none)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], one.alias("places"), count.alias("counts"))


def as_vectors(sparse: DataFrame, key: str, width: int, output: str = "features") -> DataFrame:
    """``key`` and a sparse ML vector of ``width`` columns, made batch by batch."""
    name = sparse.schema[key]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)),
                    batch["places"].cast(pa.list_(pa.int32())), batch["counts"].cast(pa.list_(pa.float64())),
                ],
                names=["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([batch[key], vectors], names=[key, output])

    schema = StructType().add(name).add(output, VectorUDT())
    return sparse.select(key, "places", "counts").mapInArrow(made, schema)


def as_text(sparse: DataFrame, fk: str, name: str = "cells") -> DataFrame:
    """``place:count`` pairs in one text, for files and comparisons."""
    pairs = F.transform(F.arrays_zip("places", "counts"), lambda e: F.concat_ws(":", e["places"], e["counts"]))
    return sparse.select(fk, F.array_join(pairs, ",").alias(name))
