"""Stored aggregates that grow with appended rows instead of being computed anew.

A state holds, for every key, what merges exactly: rows, and for every column the count, sum,
mean, squared deviations from it, least and largest value. Each batch of child rows is written
as a state of its own under its name, so a batch that is written again, after a failure or by
mistake, replaces itself and is never counted twice. Reading merges the batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators.aggregate import AggSpec

#: Aggregates that a state gives, all of them for any of its columns.
FUNCTIONS = ("COUNT", "sum", "avg", "max", "std", "min")


def _names(column: str) -> dict[str, str]:
    return {part: f"{part}_{column}" for part in ("n", "sum", "mean", "dev", "max", "min")}


def state_of(child: DataFrame, fk: str, columns: Sequence[str]) -> DataFrame:
    """One row per foreign key value; rows without one do not count. Column names become parts
    of other names, so none may end another (``n_x`` beside ``x``)."""
    parts = [F.count(F.lit(1)).alias("rows")]
    for column in columns:
        name, value = _names(column), F.col(f"`{column}`")
        number = value.cast("double")
        parts += [
            F.count(value).alias(name["n"]),
            F.sum(value).cast("double").alias(name["sum"]),
            F.avg(number).alias(name["mean"]),
            (F.var_pop(number) * F.count(value)).alias(name["dev"]),
            F.max(number).alias(name["max"]),
            F.min(number).alias(name["min"]),
        ]
    return child.where(F.col(f"`{fk}`").isNotNull()).groupBy(F.col(f"`{fk}`").alias("key")).agg(*parts)


def append_state(child: DataFrame, fk: str, columns: Sequence[str], path: str, batch: str) -> None:
    """Write the state of a batch of child rows; the same name again replaces the batch."""
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a batch is named by letters, digits, - and _, not {batch!r}")
    state_of(child, fk, columns).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _merged_deviations(name: dict[str, str]) -> Column:
    """Squared deviations of all batches from their common mean, batch after batch."""
    known = F.filter(F.array_sort(F.collect_list(F.struct("batch", *[
        F.col(f"`{name[part]}`").alias(part) for part in ("n", "mean", "dev")
    ]))), lambda s: s["n"] > 0)

    def add(total: Column, s: Column) -> Column:
        n, gap = total["n"] + s["n"], s["mean"] - total["mean"]
        return F.struct(
            n.alias("n"),
            (total["mean"] + gap * s["n"] / n).alias("mean"),
            (total["dev"] + s["dev"] + gap * gap * total["n"] * s["n"] / n).alias("dev"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("dev"))
    return F.aggregate(known, zero, add)


def merge_states(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per key from states with their ``batch``; a group has a row per batch at most."""
    parts = [F.sum("rows").alias("rows")]
    for column in columns:
        name = _names(column)
        parts += [F.sum(f"`{name[p]}`").alias(name[p]) for p in ("n", "sum")]
        parts += [F.max(f"`{name['max']}`").alias(name["max"]), F.min(f"`{name['min']}`").alias(name["min"])]
        parts.append(_merged_deviations(name).alias(f"_all_{column}"))
    merged = states.groupBy("key").agg(*parts)
    for column in columns:
        name, known = _names(column), F.col(f"`_all_{column}`")
        some = known["n"] > 0
        merged = merged.withColumns({
            name["mean"]: F.when(some, known["mean"]), name["dev"]: F.when(some, known["dev"]),
        }).drop(f"_all_{column}")
    return merged.select("key", "rows", *[f"`{n}`" for c in columns for n in _names(c).values()])


def load_state(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All batches below a folder, merged."""
    stored = spark.read.option("basePath", path).parquet(path)
    return merge_states(stored.withColumn("batch", F.col("batch").cast("string")), columns)


def compact(spark: SparkSession, path: str, columns: Sequence[str], target: str, batch: str) -> None:
    """All batches as one in another folder, to which further ones may be appended."""
    load_state(spark, path, columns).write.mode("overwrite").parquet(f"{target}/batch={batch}")


def from_state(state: DataFrame, fk: str, specs: Sequence[AggSpec]) -> DataFrame:
    """What :func:`~relloom.operators.aggregate.aggregate` gives for all rows of all batches."""
    out = []
    for spec in specs:
        if spec.predicate or spec.function not in FUNCTIONS:
            raise ValueError(f"a state holds no {spec.function} under {spec.predicate}")
        if spec.function == "COUNT":
            out.append(F.col("rows").alias(spec.name))
            continue
        name = _names(spec.column)
        n = F.col(f"`{name['n']}`")
        value = {
            "sum": F.col(f"`{name['sum']}`"),
            "avg": F.col(f"`{name['sum']}`") / F.nullif(n, F.lit(0)),
            "std": F.sqrt(F.col(f"`{name['dev']}`") / F.nullif(n, F.lit(0))),
            "max": F.col(f"`{name['max']}`"),
            "min": F.col(f"`{name['min']}`"),
        }[spec.function]
        out.append(value.alias(spec.name))
    return state.select(F.col("key").alias(fk), *out)
