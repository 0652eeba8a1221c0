"""Statistics of features: scaling, variance, ANOVA F, class weights, AUC.

All of them are sums, means and population variances with partial aggregation, or
work on the sorted distinct values of a feature, so no class or value is gathered
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from relloom.operators.ordered import with_running

def _of_feature(total: Column) -> Column:
    """Total over the rows of a feature: one row per class or cluster."""
    return total.over(Window.partitionBy("feature"))


def _moments(df: DataFrame, columns: Sequence[str]) -> Row:
    """Mean and population deviation of every column, as one row."""
    return df.agg(
        *[F.avg(c).alias(f"{c}_avg") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    ).first()


def _divisor(row: Row, column: str) -> Column:
    """The deviation, or 1 for a constant column."""
    return F.lit(float(row[f"{column}_std"] or 1.0))


def scale_unit_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide by the population deviation, without centring."""
    row = _moments(df, columns)
    return df.withColumns({c: F.col(c) / _divisor(row, c) for c in columns})


def scale_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and divide by the population deviation."""
    row = _moments(df, columns)
    return df.withColumns(
        {c: (F.col(c) - F.lit(float(row[f"{c}_avg"] or 0.0))) / _divisor(row, c) for c in columns}
    )


def melt(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per feature: ``keep, feature, value``."""
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("p")).select(*keep, "p.*")


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, variance, kept``: a feature without variance is not kept."""
    row = df.agg(*[F.var_pop(f).alias(f) for f in features])
    long = melt(row, [], features).withColumnRenamed("value", "variance")
    return long.withColumn("kept", F.coalesce(F.col("variance") > 0, F.lit(False)))


def anova_f(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """``feature, f_score`` of a one-way analysis of variance by class.

    Between and within sums come from means and variances, which merge without the
    cancellation of raw sums of squares. Features must be free of NULL.
    """
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"{f}_avg") for f in features],
        *[F.var_pop(f).alias(f"{f}_var") for f in features],
    )
    triples = [
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}_avg").alias("m"), F.col(f"{f}_var").alias("v"))
        for f in features
    ]
    long = per_class.select("n", F.explode(F.array(*triples)).alias("t")).select("n", "t.*")
    mean = _of_feature(F.sum(F.col("n") * F.col("m"))) / _of_feature(F.sum("n"))
    sums = long.withColumn("mean", mean).groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("classes"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("between"),
    )
    within = F.col("within") / (F.col("total") - F.col("classes"))
    score = F.try_divide(F.col("between") / (F.col("classes") - 1), within)
    return sums.select("feature", score.alias("f_score"))


def best_features(df: DataFrame, label: str, features: Sequence[str], percent: float) -> list[str]:
    """The best ``percent`` of the features by ANOVA F, at least one."""
    k = max(1, int(0.01 * percent * len(features)))
    ranked = anova_f(df, label, features).orderBy(F.col("f_score").desc_nulls_last(), "feature")
    return [r.feature for r in ranked.limit(k).collect()]


def class_weights(df: DataFrame, label: str, ratio: float, name: str = "weight") -> DataFrame:
    """Weight ``ratio`` for the rarer class of a binary label, else 1.

    Equal classes count the lower label as the rarer one.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(
        F.count(F.lit(1)).alias("classes"), F.min_by(label, F.struct("n", label)).alias("rarer")
    ).first()
    if facts.classes > 2 or facts.rarer is None:
        return df.withColumn(name, F.lit(1.0))
    is_rarer = F.col(label) == F.lit(facts.rarer)
    return df.withColumn(name, F.when(is_rarer, F.lit(float(ratio))).otherwise(1.0))


def feature_auc(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """``feature, auc``: chance that a positive has the larger value, ties count half.

    Rows are first added up per distinct value. One sort by feature and value gives
    the negatives before each value; those of earlier features cancel by
    subtracting what the feature's first value has before it.
    """
    rows = melt(df.where(F.col(label).isNotNull()), [label], features)
    found = ranked_areas(rows, "feature", F.col(label) == 1, "value")
    return found.select("feature", (F.col("area") / F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))).alias("auc"))


def ranked_areas(rows: DataFrame, by: str, positive: Column, value: str) -> DataFrame:
    """``by``, ``area``, ``p`` and ``n``: the pairs in which the positive has the larger value, and the rows of both kinds."""
    groups = rows.groupBy(by, value).agg(
        F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg")
    )
    ordered = with_running(groups, [F.col(by), F.col(value)], sums={"before": "neg"})
    half_above = F.col("pos") * (F.col("before").cast("double") + F.col("neg") / 2)
    sums = ordered.groupBy(by).agg(
        F.sum(half_above).alias("area"),
        F.min("before").alias("start"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    return sums.select(by, (F.col("area") - F.col("start").cast("double") * F.col("p")).alias("area"), "p", "n")


def auc_by_rank(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``auc`` of a score."""
    return feature_auc(df, label, [score]).select("auc")


def feature_quality(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """``feature, quality``: AUC of each feature alone, in the direction that helps.

    A feature that cannot be scored has quality 0.
    """
    auc = F.col("auc")
    quality = F.coalesce(F.greatest(auc, 1 - auc), F.lit(0.0))
    return feature_auc(df, label, features).select("feature", quality.alias("quality"))


def cluster_outliers(long: DataFrame, cluster: str) -> DataFrame:
    """Features that set a cluster apart: absolute standardised mean above the
    cluster's mean plus three population deviations.

    ``long`` has ``cluster, feature, value``. Moments per cluster and feature are
    enough, so rows are shuffled only as partial sums.
    """
    cells = long.groupBy(cluster, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    mean = _of_feature(F.sum(F.col("n") * F.col("m"))) / _of_feature(F.sum("n"))
    placed = cells.withColumn("off", F.col("m") - mean)
    spread = _of_feature(F.sum(F.col("n") * (F.col("v") + F.col("off") * F.col("off"))))
    std = F.sqrt(spread / _of_feature(F.sum("n")))
    scored = placed.select(cluster, "feature", F.abs(F.try_divide(F.col("off"), std)).alias("weight"))
    bounds = scored.groupBy(cluster).agg((F.avg("weight") + 3 * F.stddev_pop("weight")).alias("bound"))
    return scored.join(bounds, cluster).where(F.col("weight") > F.col("bound")).drop("bound")
