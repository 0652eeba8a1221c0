"""Readers of entity tables and id lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """One frame per ``folder/name.parquet``."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}


def catalog_tables(spark: SparkSession, names: Iterable[str]) -> dict[str, DataFrame]:
    """One frame per table of the session catalog."""
    return {n.rsplit(".", 1)[-1]: spark.table(n) for n in names}


def jdbc_tables(
    spark: SparkSession,
    url: str,
    splits: Mapping[str, tuple[str, int, int] | None],
    partitions: int = 200,
    properties: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """One frame per table of a database.

    ``splits`` gives an integer column and its range, by which the table is read in
    ``partitions`` parallel queries; ``None`` reads a small table in one.
    """
    tables = {}
    for name, split in splits.items():
        options: dict[str, Any] = {}
        if split:
            column, lower, upper = split
            options = dict(column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
        tables[name] = spark.read.jdbc(url, name, properties=dict(properties or {}), **options)
    return tables


def id_list(spark: SparkSession, path: str, name: str = "id", dtype: str = "bigint") -> DataFrame:
    """Ids from a text file, one per line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.trim("value").cast(dtype).alias(name)).distinct()
