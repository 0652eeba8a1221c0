"""Profiling: distinct values, ranges, binary columns, one-to-one edges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.functions.rows import is_date

if TYPE_CHECKING:
    from relloom.entityset import EntitySet, Relationship

# Rows looked at for early proof that a column is not binary.
PROBE_ROWS = 1_000


def _quoted(column: str) -> Column:
    return F.col(f"`{column}`")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values, without NULL and empty text."""
    values = df.select(_quoted(column).alias("value")).where(F.col("value").isNotNull())
    if dict(df.dtypes)[column] == "string":
        values = values.where(F.col("value") != "")
    return values.distinct().orderBy("value")


def value_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, value, n`` of every key and value that meet, however many values there are.

    Without NULL and empty text, as :func:`distinct_values`.
    """
    rows = df.select(_quoted(key).alias(key), _quoted(column).alias("value")).where(F.col("value").isNotNull())
    if dict(df.dtypes)[column] == "string":
        rows = rows.where(F.col("value") != "")
    return rows.groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))


def column_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(_quoted(column)).alias("max_value"), F.min(_quoted(column)).alias("min_value"))


def wall_range(df: DataFrame, column: str) -> DataFrame:
    """:func:`column_range` with timestamps as the session's wall clock shows them.

    A collected ``timestamp`` would be in the time zone of the driver's process, which
    need not be the session's.
    """
    if dict(df.dtypes)[column] == "timestamp":
        df = df.select(_quoted(column).cast("timestamp_ntz").alias(column))
    return column_range(df, column)


def _one_row_to_long(row: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias(value)) for c in columns]
    return row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct counts: ``column, n_distinct``.

    Each column is deduplicated by itself, partially before its shuffle, and counted; no
    row is copied once per column, and a scan reads only the column it counts.
    """

    def one(column: str) -> DataFrame:
        values = df.select(_quoted(column).alias("v")).where(F.col("v").isNotNull()).distinct()
        return values.agg(F.lit(column).alias("column"), F.count(F.lit(1)).alias("n_distinct"))

    return reduce(DataFrame.unionByName, [one(c) for c in columns])


def distinct_sketches(df: DataFrame, columns: Sequence[str], log_size: int = 12) -> DataFrame:
    """One row with a mergeable sketch of the distinct values of each column, in one pass.

    Sketches of parts of a table (days, partitions) are merged by ``merge_sketches``.
    """
    return df.agg(*[F.hll_sketch_agg(_sketched(df, c), log_size).alias(c) for c in columns])


def _sketched(df: DataFrame, column: str) -> Column:
    """The value, or its hash if sketches do not take its type."""
    kind = dict(df.dtypes)[column]
    value = _quoted(column)
    return value if kind in ("int", "bigint", "string", "binary") else F.when(value.isNotNull(), F.xxhash64(value))


def merge_sketches(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    return sketches.agg(*[F.hll_union_agg(_quoted(c)).alias(c) for c in columns])


def estimated_counts(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n_distinct`` of one row of sketches, within a few per cent."""
    row = sketches.select(*[F.coalesce(F.hll_sketch_estimate(_quoted(c)), F.lit(0)).alias(c) for c in columns])
    return _one_row_to_long(row, columns, "n_distinct")


def few_valued(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """``column, n_distinct`` of the columns with at most ``most`` values, exactly.

    A sketch screens all columns in one pass; only those near or below the bound are counted.
    Twice the bound is far beyond the sketch's error.
    """
    estimates = estimated_counts(distinct_sketches(df, columns), columns).collect()
    near = [r["column"] for r in estimates if r["n_distinct"] <= 2 * most + 8]
    if not near:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long")
    return distinct_counts(df, near).where(F.col("n_distinct") <= most)


def varying_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which columns have at least two distinct values, without counting them."""
    row = df.agg(*[F.coalesce(F.min(_quoted(c)) < F.max(_quoted(c)), F.lit(False)).alias(c) for c in columns])
    return _one_row_to_long(row, columns, "varies")


def _distinct_up_to(df: DataFrame, columns: Sequence[str], most: int, count: Callable[[Column], Column]) -> list[str]:
    row = df.agg(*[count(_quoted(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] <= most]


def binary_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most two distinct non-null values.

    Three values among the first rows already prove a column is not binary, which
    spares most columns a full scan. For the others a sketch comes next, as it never
    reports more than two for two or fewer real values; what passes is counted.
    """
    left = list(columns)
    for rows, count in (
        (df.limit(PROBE_ROWS), F.count_distinct),
        (df, F.approx_count_distinct),
        (df, F.count_distinct),
    ):
        if left:
            left = _distinct_up_to(rows, left, 2, count)
    return left


def one_to_one(parent: DataFrame, parent_column: str, child: DataFrame, child_column: str) -> DataFrame:
    """One row ``one_to_one``: every referenced parent has exactly one child."""
    fan = (
        child.where(F.col(child_column).isNotNull())
        .groupBy(F.col(child_column).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(parent.select(F.col(parent_column).alias("k")), "k", "left_semi")
    )
    flag = (F.min("n") == 1) & (F.max("n") == 1)
    return fan.agg(F.coalesce(flag, F.lit(False)).alias("one_to_one"))


def repeats_early(parent: DataFrame, parent_column: str, child: DataFrame, child_column: str) -> bool:
    """Whether the first child rows already show a parent with two children."""
    keys = child.where(F.col(child_column).isNotNull()).select(F.col(child_column).alias("k")).limit(PROBE_ROWS)
    repeated = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    # At most half of the probed rows repeat, so the broadcast side is small.
    known = parent.select(F.col(parent_column).alias("k")).join(F.broadcast(repeated), "k", "left_semi")
    return bool(known.take(1))


def one_to_one_report(es: EntitySet) -> DataFrame:
    checks = []
    for r in es.relationships:
        flag = one_to_one(es[r.parent].df, r.parent_column, es[r.child].df, r.child_column)
        checks.append(flag.select(F.lit(r.label).alias("edge"), "one_to_one"))
    return reduce(DataFrame.unionByName, checks)


class Profile:
    """The facts about the data that synthesis asks for, each computed once."""

    def __init__(self, es: EntitySet) -> None:
        self._es = es
        self._cache: dict[Any, Any] = {}

    def _once(self, key: Any, compute: Any) -> Any:
        if key not in self._cache:
            self._cache[key] = compute()
        return self._cache[key]

    def binary(self, entity: str) -> frozenset[str]:
        def compute() -> frozenset[str]:
            df = self._es[entity].df
            keys = set(self._es.key_columns(entity))
            plain = [n for n, t in df.dtypes if n not in keys and not t.startswith(("array", "map", "struct"))]
            return frozenset(binary_columns(df, plain))

        return self._once(("binary", entity), compute)

    def values(self, entity: str, column: str) -> list[Any]:
        """Sorted filter values of a category column; dates have none."""

        def compute() -> list[Any]:
            df = self._es[entity].df
            if is_date(dict(df.dtypes)[column]):
                return []
            return [r.value for r in distinct_values(df, column).collect()]

        return self._once(("values", entity, column), compute)

    def extent(self, entity: str, column: str) -> tuple[Any, Any]:
        """Largest and smallest value of a column."""

        def compute() -> tuple[Any, Any]:
            row = wall_range(self._es[entity].df, column).first()
            return row.max_value, row.min_value

        return self._once(("extent", entity, column), compute)

    def prefetch(self) -> None:
        """Test all edges that synthesis may ask about, as concurrent jobs."""
        edges = [
            r for r in self._es.relationships if r.child not in self._es[r.parent].config.excluded_agg_entities
        ]
        with ThreadPoolExecutor(max_workers=8) as pool:
            list(pool.map(self.one_to_one, edges))

    def one_to_one(self, edge: Relationship) -> bool:
        """Preset of either entity by name, else computed."""
        for entity, other in ((edge.parent, edge.child), (edge.child, edge.parent)):
            preset = self._es[entity].config.one_to_one
            if other in preset:
                return bool(preset[other])

        def compute() -> bool:
            sides = self._es[edge.parent].df, edge.parent_column, self._es[edge.child].df, edge.child_column
            return not repeats_early(*sides) and one_to_one(*sides).first()[0]

        return self._once(("one_to_one", edge), compute)
