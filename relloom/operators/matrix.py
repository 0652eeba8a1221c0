"""Training matrices: label, id, features; null filling and encodings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.operators.lookup import lookup_join
from relloom.operators.ordered import with_position
from relloom.runtime import materialize


def training_matrix(
    df: DataFrame,
    id_column: str,
    label: str,
    features: Sequence[str],
    where: Column | None = None,
    include_unlabeled: bool = True,
) -> DataFrame:
    """``id, label, features``; an unlabeled row counts as class 0 or is left out."""
    if where is not None:
        df = df.where(where)
    if not include_unlabeled:
        df = df.where(F.col(label).isNotNull())
    value = F.coalesce(F.col(label).cast("int"), F.lit(0)).alias(label)
    return df.select(id_column, value, *features)


def zero_filled(column: str) -> Column:
    """The value as a double, with NULL and NaN as 0."""
    return F.coalesce(F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(0.0)), F.lit(0.0))


def null_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: zero_filled(c) for c in columns})


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Code of every value: its rank among the sorted distinct values, from 0.

    NULL is a value of its own and sorts first.
    """
    values = df.select(column).distinct()
    codes = with_position(values, [F.col(column).asc_nulls_first()], name)
    # Written, so that the size of the code table is known to the join.
    codes = materialize(codes.where(F.col(column).isNotNull()).withColumnRenamed(column, "_value"), "codes")
    joined = lookup_join(df, column, codes, "_value")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def one_hot(df: DataFrame, column: str, values: Sequence[Any], prefix: str | None = None) -> DataFrame:
    """A 0/1 column per known value; an unknown value or NULL is all zeros."""
    prefix = prefix or column
    flags = [
        F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in values
    ]
    return df.select("*", *flags)
