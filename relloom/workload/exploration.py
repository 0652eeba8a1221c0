"""Exploration queries: samples, roll-ups, running best, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators import explore
from relloom.operators.aggregate import AggSpec, aggregate_onto
from relloom.operators.statistics import cluster_outliers
from relloom.sources import writers
from relloom.workload.registry import cents, query, single, table

ORDERS_SQL = """(select o_orderkey, o_orderdate, o_totalprice, discount from orders left join
                  (select l_orderkey, sum(l_extendedprice * l_discount) as discount from lineitem group by 1)
                  on o_orderkey = l_orderkey)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the discount given on their lines."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.select("l_orderkey", (F.col("l_extendedprice") * F.col("l_discount")).alias("off"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return aggregate_onto(orders, "o_orderkey", lines, "l_orderkey", [AggSpec("discount", "sum", "off")])


@query(
    "scatter_sample",
    f"""select o_orderkey, coalesce(o_totalprice, 0) as x, cast(coalesce(discount, 0) * 1.000000001e0 as float) as y from
        {ORDERS_SQL} order by md5(cast(o_orderkey as varchar)), o_orderkey limit 999""",
)
def scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = explore.scatter_sample(_orders(spark, sf_dir), "o_orderkey", "o_totalprice", "discount")
    return sample.withColumn("y", single("y"))


ROLLUP_SQL = "count(*) as orders, cast(sum(o_totalprice - coalesce(discount, 0)) * 1.000000001e0 as float) as profit, " \
             "round(sum(o_totalprice), 2) as gross"


def _with_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    profit = F.col("o_totalprice") - F.coalesce("discount", F.lit(0.0))
    return _orders(spark, sf_dir).withColumn("profit", profit)


@query(
    "monthly_rollup",
    f"""select cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month, {ROLLUP_SQL}
        from {ORDERS_SQL} group by grouping sets ((1, 2), ())""",
)
def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = explore.monthly_rollup(_with_profit(spark, sf_dir), "o_orderdate", "o_totalprice", "profit")
    return months.select("year", "month", "orders", single("profit"), cents("gross"))


@query(
    "daily_rollup",
    f"""select cast(day(o_orderdate) as integer) as day, {ROLLUP_SQL} from {ORDERS_SQL}
        where o_orderdate >= timestamp '1996-03-01' and o_orderdate < timestamp '1996-04-01' group by 1""",
)
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of one month, which is what this report shows."""
    days = explore.daily_rollup(
        _with_profit(spark, sf_dir), "o_orderdate", "o_totalprice", "profit", "1996-03-01", "1996-04-01"
    )
    return days.select("day", "orders", single("profit"), cents("gross"))


@query(
    "best_so_far",
    """select step, max(score) over (order by step rows between unbounded preceding and 1 preceding) as best
       from (select o_orderdate as step, round(sum(o_totalprice), 2) as score from orders group by 1)""",
)
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest daily total of all days before."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("step"))
    daily = orders.agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return writers.best_so_far(daily, "step", "score").select("step", "best")


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("feature", "value"))


@query(
    "cluster_feature_outliers",
    """with long as (select label, i - 1 as feature, embedding[i]::double as value
                     from embeddings, unnest(range(1, len(embedding) + 1)) as u(i)),
       whole as (select feature, avg(value) as a, stddev_pop(value) as s from long group by 1),
       cell as (select label, feature, abs((avg(value) - any_value(a)) / any_value(s)) as weight
                from long join whole using (feature) group by 1, 2),
       bound as (select label, avg(weight) + 3 * stddev_pop(weight) as b from cell group by 1)
       select label, cast(feature as integer) as feature, cast(weight * 1.000000001e0 as float) as weight
       from cell join bound using (label) where weight > b""",
)
def cluster_feature_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_outliers(_dimensions(spark, sf_dir), "label")
    return found.select("label", "feature", single("weight"))


def _wide_embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    columns = [f"e{i}" for i in range(width)]
    return vectors.select("vec_id", *[F.col("embedding")[i].alias(c) for i, c in enumerate(columns)]), columns


@query("cluster_assign")
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, columns = _wide_embeddings(spark, sf_dir)
    return explore.cluster_assign(wide, "vec_id", columns, k=5).select("vec_id", "cluster")


@query("cluster_explain")
def cluster_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, columns = _wide_embeddings(spark, sf_dir)
    return explore.cluster_explain(explore.cluster_assign(wide, "vec_id", columns, k=5), columns)


@query("cluster_coordinates")
def cluster_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, columns = _wide_embeddings(spark, sf_dir)
    return explore.cluster_coordinates(explore.cluster_assign(wide, "vec_id", columns, k=5), "vec_id")
