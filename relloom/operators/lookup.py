"""Joins along relationships: lookups from parents, attached aggregates, splits."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from math import ceil
from typing import Any
from weakref import WeakKeyDictionary

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.runtime import fits_broadcast

# Counters of the summary of frequent keys for each key that may be hot, and their limit:
# its error is below a fraction of the share that makes a key hot.
COUNTERS_PER_KEY, MOST_COUNTERS = 16, 1_000_000
# Types the summary takes; keys of others are left to Spark's own skew handling.
SUMMARISED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "string", "decimal")
# Column that tells rows of a table without a key apart, see with_spread.
SPREAD = "_spread"


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# What is known of a frame's columns, as long as the frame is used.
_known_keys: WeakKeyDictionary[DataFrame, dict[tuple, dict[Any, int]]] = WeakKeyDictionary()


def key_summary(df: DataFrame, column: str, keys: int) -> DataFrame:
    """One row: ``n`` rows, ``nulls`` among them, and the ``frequent`` keys with their counts.

    A mergeable summary of frequent items: one pass, no shuffle of the rows, and a size that
    depends on ``keys`` alone.
    """
    counters = min(max(COUNTERS_PER_KEY * keys, 1024), MOST_COUNTERS)
    name = column.replace("`", "``")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"`{name}`").isNull()).alias("nulls"),
        F.expr(f"approx_top_k(`{name}`, {min(keys, counters)}, {counters})").alias("frequent"),
    )


def hot_keys(df: DataFrame, column: str) -> dict[Any, int]:
    """Keys, NULL among them, holding more than an average shuffle partition of the rows.

    With each comes the number of such shares it holds, rounded up. At most as many keys as
    there are shuffle partitions can pass, so the result is small whatever the data. The
    counts are estimates; they decide how rows are spread, never what is joined. A frame is
    summarised once for each column.
    """
    partitions = _shuffle_partitions(df)
    known = _known_keys.setdefault(df, {})
    if (column, partitions) not in known:
        kind = dict(df.dtypes)[column]
        found: dict[Any, int] = {}
        if kind.split("(")[0] in SUMMARISED:
            row = key_summary(df, column, partitions).first()
            share = max(row["n"] / partitions, 1)
            counts = [(r["item"], r["count"]) for r in row["frequent"] or []] + [(None, row["nulls"])]
            found = {key: ceil(n / share) for key, n in counts if n > share}
        known[(column, partitions)] = found
    return known[(column, partitions)]


def _places(key: Column, hot: Mapping[Any, int], most: int) -> Column:
    """Over how many places a key's rows are spread: two to four times its shares, as places collide.

    Powers of two make few classes of keys, each one set to look a key up in.
    """
    classes = defaultdict(list)
    for value, shares in hot.items():
        if value is not None:
            classes[min(2 << shares.bit_length(), 4 * most)].append(value)
    out = F.lit(1)
    for places, values in classes.items():
        out = F.when(key.isin(values), F.lit(places)).otherwise(out)
    return out


def with_spread(df: DataFrame) -> DataFrame:
    """Add the row's place in its file, for salting rows that may be equal otherwise.

    It is the same when a task is repeated, and unlike a generated id it lets filters
    through to the scan. A frame that is not read from files gets a hash of the row.
    """
    try:
        return df.select("*", F.col("_metadata.row_index").alias(SPREAD))
    except AnalysisException:
        return df.withColumn(SPREAD, _row_hash(df))


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])


def lookup_join(
    child: DataFrame, fk: str, parent: DataFrame, key: str, keys_from: DataFrame | None = None
) -> DataFrame:
    """Left join of many child rows to at most one parent row each.

    A parent small enough for Spark to broadcast is left to Spark, as are keys that
    spread well. Otherwise the rows of hot foreign keys, and those without one, are
    spread in proportion to the key's share, and only the parent rows of hot keys are
    repeated, once per place. The place is a hash of the row, so select the needed columns
    first; rows of a table without a key should carry the column of ``with_spread``.

    ``keys_from`` is where to look for hot keys if ``child`` is costly to compute:
    the table its foreign key comes from.
    """
    fk_column, key_column = F.col(f"`{fk}`"), F.col(f"`{key}`")
    hot = {} if fits_broadcast(parent) else hot_keys(child if keys_from is None else keys_from, fk)
    if not hot:
        return child.join(parent, fk_column == key_column, "left").drop(key)
    most = _shuffle_partitions(child)
    row = F.col(SPREAD) if SPREAD in child.columns else _row_hash(child)
    # rows without a key meet no parent row, so they may go anywhere
    places = F.when(fk_column.isNull(), F.lit(most)).otherwise(_places(fk_column, hot, most))
    left = child.withColumn("_salt", F.pmod(row, places).cast("int"))
    every = F.sequence(F.lit(0), _places(key_column, hot, most) - 1)
    right = parent.withColumn("_copy", F.explode(every))
    same = (fk_column == key_column) & (F.col("_salt") == F.col("_copy"))
    return left.join(right, same, "left").drop(key, "_salt", "_copy")


def flatten(
    child: DataFrame,
    fk: str,
    parent: DataFrame,
    key: str,
    columns: Sequence[str],
    prefix: str,
) -> DataFrame:
    """Copy parent columns to the child as ``prefix.column``."""
    right = parent.select(
        F.col(f"`{key}`").alias("_key"), *[F.col(f"`{c}`").alias(f"{prefix}.{c}") for c in columns]
    )
    return lookup_join(child, fk, right, "_key")


def attach(parent: DataFrame, key: str, per_key: DataFrame, per_key_column: str) -> DataFrame:
    """Left join of a frame with one row per key; keys without one keep NULL."""
    right = per_key.withColumnRenamed(per_key_column, "_key")
    return parent.join(right, F.col(f"`{key}`") == F.col("_key"), "left").drop("_key")


def split_by_ids(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside a list of ids (train, test); NULL keys count as outside."""
    known = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return df.join(known, key, "left_anti"), df.join(known, key, "left_semi")


def wide_read(df: DataFrame, columns: Sequence[str | Column], where: Column | None = None,
              order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Chosen columns of a joined frame, filtered; the first ``limit`` rows in an order."""
    if where is not None:
        df = df.where(where)
    out = df.select(*columns)
    if limit is None:
        return out
    return out.orderBy(*order).limit(limit) if order else out.limit(limit)
