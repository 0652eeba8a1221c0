"""Exploration: clusters and what sets them apart, samples for plots, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.operators.matrix import null_fill


def standard_vectors(df: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """``id, x``: the columns with NULL as 0, centred and scaled, as a vector."""
    filled = null_fill(df.select(id_column, *columns), columns)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(filled)
    scaler = StandardScaler(inputCol="_raw", outputCol="x", withMean=True, withStd=True)
    return scaler.fit(vectors).transform(vectors).select(id_column, "x")


def cluster_assign(df: DataFrame, id_column: str, columns: Sequence[str], k: int = 5, seed: int = 0) -> DataFrame:
    """``id, x, cluster`` by k-means over all rows."""
    vectors = standard_vectors(df, id_column, columns)
    return KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster").fit(vectors).transform(vectors)


def cluster_explain(assigned: DataFrame, columns: Sequence[str], deviations: float = 3.0) -> DataFrame:
    """``cluster, feature, weight``: large weights of a linear model of each cluster.

    One regression per cluster tells it from the rest; a feature is kept when its
    absolute weight exceeds the mean by ``deviations`` population deviations.
    """
    spark = assigned.sparkSession
    rows = assigned.select("x", "cluster").persist()
    kept = []
    for number in sorted(r.cluster for r in rows.select("cluster").distinct().collect()):
        marked = rows.withColumn("_member", (F.col("cluster") == number).cast("double"))
        fitted = LinearRegression(featuresCol="x", labelCol="_member", regParam=1e-6).fit(marked)
        weights = [abs(float(w)) for w in fitted.coefficients]
        mean = sum(weights) / len(weights)
        spread = (sum((w - mean) ** 2 for w in weights) / len(weights)) ** 0.5
        bound = mean + deviations * spread
        found = [(int(number), c, w) for c, w in zip(columns, weights, strict=True) if w > bound]
        kept += sorted(found, key=lambda row: -row[2])
    rows.unpersist()
    return spark.createDataFrame(kept, "cluster int, feature string, weight double")


def cluster_coordinates(assigned: DataFrame, id_column: str) -> DataFrame:
    """``id, cluster, x, y``: the first two principal components."""
    fitted = PCA(k=2, inputCol="x", outputCol="_xy").fit(assigned)
    xy = vector_to_array("_xy")
    return fitted.transform(assigned).select(id_column, "cluster", xy[0].alias("x"), xy[1].alias("y"))


def scatter_sample(
    df: DataFrame, id_column: str, x: str, y: str, n: int = 999, strict: bool = True
) -> DataFrame:
    """``id, x, y`` of ``n`` rows drawn by the hash of their id, NULL as 0.

    Repeatable, and a top-k: every task keeps at most ``n`` rows. Fewer rows than
    asked for are an error unless ``strict`` is off.
    """
    if strict and df.limit(n).count() < n:
        raise ValueError(f"sample of {n} is larger than the population")
    picked = df.select(id_column, x, y).orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(n)
    return picked.select(
        id_column, F.coalesce(F.col(x), F.lit(0)).alias("x"), F.coalesce(F.col(y), F.lit(0)).alias("y")
    )


def monthly_rollup(orders: DataFrame, date: str, gross: str, profit: str) -> DataFrame:
    """Orders, profit and gross per month, with the overall totals as a NULL month."""
    months = orders.select(F.year(date).alias("year"), F.month(date).alias("month"), gross, profit)
    by_month = months.groupingSets(
        [[F.col("year"), F.col("month")], []], F.col("year"), F.col("month")
    )
    return by_month.agg(
        F.count(F.lit(1)).alias("orders"), F.sum(profit).alias("profit"), F.sum(gross).alias("gross")
    )


def daily_rollup(orders: DataFrame, date: str, gross: str, profit: str, first: str, after: str) -> DataFrame:
    """Orders, profit and gross per day from ``first`` up to, not including, ``after``."""
    inside = orders.where((F.col(date) >= first) & (F.col(date) < after))
    return inside.groupBy(F.dayofmonth(date).alias("day")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum(profit).alias("profit"), F.sum(gross).alias("gross")
    )
