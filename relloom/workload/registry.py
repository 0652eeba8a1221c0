"""Registry of named queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is one that SQL cannot express."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Sums of amounts are whole cents; means and deviations depend in their last bits on
# the order of addition, so results hold them in single precision. The factor, the same
# in the SQL, keeps exact halves (a mean of 32 amounts) off the rounding boundary.
NUDGE = 1.000000001


def cents(column: str) -> Column:
    return F.round(F.col(f"`{column}`"), 2).alias(column)


def single(column: str) -> Column:
    return (F.col(f"`{column}`") * F.lit(NUDGE)).cast("float").alias(column)
