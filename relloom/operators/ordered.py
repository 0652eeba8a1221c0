"""Global order at scale: row positions and running totals over a sorted frame.

A window without partitions moves every row into one task. Here rows are range
sorted, each keeps its place within its sorted partition, and only the totals per
partition (a row each) are added up to find where a partition starts. The sort keys
must tell rows apart (by a tie breaker, or by adding up equal rows first): then a
value that fills a third of the table spreads over many partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relloom.operators.lookup import lookup_join
from relloom.runtime import materialize

# monotonically_increasing_id keeps the partition above bit 33, the place below.
_PLACE_BITS = 33


def _sorted_places(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    placed = materialize(
        df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "sorted"
    )
    return placed.withColumn("_part", F.shiftright("_id", _PLACE_BITS))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 0-based place of every row in the global order."""
    placed = _sorted_places(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    place = F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # One row per sorted partition, however many rows there are.
    return placed.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + place).alias(name))


def with_running(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
) -> DataFrame:
    """Add exclusive running sums and maxima: new name -> column, over all rows before.

    The first row gets 0 as a sum and NULL as a maximum.
    """
    sums, maxima = sums or {}, maxima or {}
    placed = _sorted_places(df, order)
    names = list(sums) + list(maxima)
    within = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    totals = placed.groupBy("_part").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()],
    )
    starts = totals.select(
        "_part",
        *[F.sum(f"_t_{n}").over(before).alias(f"_s_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_s_{n}") for n in maxima],
    )
    local = placed.select(
        *df.columns,
        "_part",
        *[F.sum(c).over(within).alias(f"_l_{n}") for n, c in sums.items()],
        *[F.max(c).over(within).alias(f"_l_{n}") for n, c in maxima.items()],
    )

    def combined(name: str) -> Column:
        here, start = F.col(f"_l_{name}"), F.col(f"_s_{name}")
        if name in maxima:
            return F.greatest(here, start)
        return F.coalesce(here, F.lit(0)) + F.coalesce(start, F.lit(0))

    return local.join(F.broadcast(starts), "_part").select(*df.columns, *[combined(n).alias(n) for n in names])


def add_decile(df: DataFrame, column: str, key: str, n: int = 10) -> DataFrame:
    """``round(n * (count - rank + 1) / count)`` with rank 1 for the largest value.

    NULL ranks last; equal values are ordered by the key. The end buckets are half
    as large as the others, unlike ``NTILE``.
    """
    ranked = with_position(
        df.select(key, column), [F.col(column).desc_nulls_last(), F.col(key).asc()], "_before"
    )
    total = F.lit(df.count())
    bucket = F.round(F.lit(float(n)) * (total - F.col("_before")) / total, 0).cast("int")
    return ranked.select(key, column, bucket.alias(f"[{column}]_decile"))


# Quantiles a hot group is cut at in each round of a selection, and their precision.
CUTS, PRECISION = [n / 16 for n in range(1, 16)], 1000
# Distinct values of a group that one task may order.
MOST_RUNS = 200_000
# A round leaves about an eighth of a group; more rounds than this mean values that no cut tells apart.
MOST_ROUNDS = 16


def group_median(df: DataFrame, group: str, value: str, name: str = "median", most: int = MOST_RUNS) -> DataFrame:
    """Exact median per group, NULLs ignored, without gathering a group in one task.

    Equal values of a group are first added up to runs. Groups of at most ``most`` runs are
    ordered as they are. A larger one is narrowed: approximate quantiles cut its values into
    ranges, the runs are counted by range, and only the one or two ranges that hold the middle
    stay, until few runs are left. Cuts decide how fast that is, never the result. NaN is the
    largest value.
    """
    known = df.select(F.col(f"`{group}`").alias("_g"), F.col(f"`{value}`").alias("_v")).dropna(subset=["_g"])
    known = known.where(F.col("_v").isNotNull())
    runs = materialize(known.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")), "runs")
    sizes = runs.groupBy("_g").agg(F.count(F.lit(1)).alias("_runs"), F.sum("_n").alias("_total"))
    large = materialize(sizes.where(F.col("_runs") > most), "large")
    if large.isEmpty():
        small, middles = runs, []
    else:
        small = runs.join(large, "_g", "left_anti")
        middles = _narrowed(runs, large, most)
    total = F.sum("_n").over(Window.partitionBy("_g"))
    middles.append(small.select("_g", "_v", "_n", F.lit(0).cast("long").alias("_skip"), total.alias("_total")))
    held = [_holding_middle(part, "_v", "_n") for part in middles]
    whole = held[0]
    for part in held[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(F.col("_g").alias(group)).agg(F.avg("_v").alias(name))


def _holding_middle(parts: DataFrame, order: str, count: str) -> DataFrame:
    """The rows of each group whose ``count`` positions, after ``_skip`` others, hold a middle of ``_total``."""
    before = Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_skip") + F.coalesce(F.sum(count).over(before), F.lit(0))
    holds = [
        (F.col("_first") <= middle) & (middle < F.col("_first") + F.col(count))
        for middle in (F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2))
    ]
    return parts.withColumn("_first", first).where(holds[0] | holds[1])


def _narrowed(runs: DataFrame, large: DataFrame, most: int) -> list[DataFrame]:
    """What is left of the large groups: ``_g, _v, _n, _skip, _total``, each group in one of the frames."""
    known = large.select(F.col("_g").alias("_k"), "_total", F.lit(0).cast("long").alias("_skip"))
    rest = lookup_join(runs, "_g", known, "_k").where(F.col("_total").isNotNull())
    rest, done = materialize(rest, "rest"), []
    for _ in range(MOST_ROUNDS):
        quantiles = F.percentile_approx("_v", CUTS, PRECISION).alias("_cuts")
        cuts = materialize(rest.groupBy(F.col("_g").alias("_k")).agg(quantiles), "cuts")
        below = F.size(F.filter("_cuts", lambda cut: cut < F.col("_v")))
        placed = lookup_join(rest, "_g", cuts, "_k").withColumn("_cell", below).drop("_cuts")
        cells = placed.groupBy("_g", "_cell").agg(
            F.sum("_n").alias("_m"), F.count(F.lit(1)).alias("_runs"),
            F.first("_skip").alias("_skip"), F.first("_total").alias("_total"),
        )
        # at most two ranges of a group hold its middle, and no run lies between them
        chosen = _holding_middle(cells, "_cell", "_m").groupBy(F.col("_g").alias("_k")).agg(
            F.min("_cell").alias("_low"), F.max("_cell").alias("_high"),
            F.min("_first").alias("_skip"), F.sum("_runs").alias("_runs"),
        )
        chosen = materialize(chosen, "chosen")
        kept = lookup_join(placed.drop("_skip"), "_g", chosen, "_k", keys_from=rest)
        kept = materialize(kept.where(F.col("_cell").between(F.col("_low"), F.col("_high"))), "kept")
        fields = ["_g", "_v", "_n", "_skip", "_total"]
        done.append(kept.where(F.col("_runs") <= most).select(*fields))
        rest = kept.where(F.col("_runs") > most).select(*fields)
        if rest.isEmpty():
            return done
    return [*done, rest]
