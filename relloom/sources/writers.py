"""Sinks: predictions, interval matrices, running best, saved feature matrices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators.lookup import lookup_join
from relloom.operators.ordered import with_running
from relloom.plans.features import CATALOG_SCHEMA, Feature, catalog_frame


def write_predictions(
    scored: DataFrame,
    path: str,
    id_column: str,
    header: Sequence[str] | None = None,
    id_map: DataFrame | None = None,
) -> None:
    """CSV of ``id,probability``.

    ``header`` names the columns of a header line. ``id_map`` replaces the id: its
    first column holds the known ids, the others what is written for them.
    """
    out = scored.select(id_column, "probability")
    if id_map is not None:
        known, *written = id_map.columns
        right = id_map.select(F.col(known).alias("_known"), *written)
        out = lookup_join(out, id_column, right, "_known").select(*written, "probability")
    if header:
        out = out.toDF(*header)
    out.write.mode("overwrite").csv(path, header=bool(header))


def interval_long(matrix: DataFrame, key: str, features: Iterable[Feature]) -> DataFrame:
    """Long form of interval features: ``key, interval`` and one column per feature
    that exists in every interval; the columns are named without the interval."""
    by_interval: dict[int, dict[str, str]] = {}
    for f in features:
        if f.interval is not None:
            plain = f.name.replace(f"int={f.interval}", "int")
            by_interval.setdefault(f.interval, {})[plain] = f.column
    names = sorted({n for columns in by_interval.values() for n in columns})
    rows = [
        F.struct(
            F.lit(number).alias("interval"),
            *[(F.col(columns[n]) if n in columns else F.lit(None)).cast("double").alias(n) for n in names],
        )
        for number, columns in sorted(by_interval.items())
    ]
    return matrix.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def write_intervals(long: DataFrame, path: str) -> None:
    """CSV of the long form, a folder per interval."""
    long.write.mode("overwrite").partitionBy("interval").csv(path, header=True)


def best_so_far(scores: DataFrame, step: str, score: str, name: str = "best") -> DataFrame:
    """Largest score of all earlier steps; NULL for the first."""
    return with_running(scores.select(step, score), [F.col(step)], maxima={name: score})


def write_best_so_far(scores: DataFrame, path: str, step: str, score: str) -> None:
    """CSV of ``step,score`` with the best score before each step."""
    best_so_far(scores, step, score).select(step, "best").write.mode("overwrite").csv(path)


def save_features(matrix: DataFrame, features: Iterable[Feature], path: str) -> None:
    """Matrix as Parquet and catalog as JSON below one folder."""
    matrix.write.mode("overwrite").parquet(f"{path}/matrix")
    catalog_frame(matrix.sparkSession, features).write.mode("overwrite").json(f"{path}/catalog")


def load_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The matrix and the catalog saved by :func:`save_features`."""
    return spark.read.parquet(f"{path}/matrix"), spark.read.schema(CATALOG_SCHEMA).json(f"{path}/catalog")
