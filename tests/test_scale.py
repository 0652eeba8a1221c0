"""What has to hold on large tables: skew, global order, pushdown, no Python, no cross joins."""

from __future__ import annotations

import random
import statistics
from types import SimpleNamespace

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from relloom.operators.aggregate import AggSpec, aggregate_onto
from relloom.operators.lookup import SPREAD, hot_keys, key_summary, lookup_join, with_spread
from relloom.operators.ordered import add_decile, group_median, with_position, with_running
from relloom.operators.statistics import feature_auc
from relloom.runtime import shared_dir
from relloom.sources.readers import catalog_tables
from relloom.workload import QUERIES


@pytest.fixture
def skewed(spark):
    """A third of the rows on one key, a third on NULL."""
    return spark.range(3000).selectExpr(
        "id", "case when id % 3 = 0 then 7 when id % 3 = 1 then null else id % 50 end as fk"
    )


def test_hot_keys(skewed):
    assert set(hot_keys(skewed, "fk")) == {7, None}


def test_hot_keys_come_from_one_pass_without_a_shuffle_of_rows(spark, skewed):
    plan = _plan(key_summary(skewed, "fk", 8))
    assert "hashpartitioning" not in plan and plan.count("Range") == 1
    hot = hot_keys(skewed, "fk")
    assert hot is hot_keys(skewed, "fk")  # summarised once
    # a third of the rows is between two and three of eight shares
    assert hot == {7: 3, None: 3}
    even = spark.range(10_000).selectExpr("id % 5000 as fk", "cast(id as string) as name")
    assert hot_keys(even, "fk") == {} and hot_keys(even, "name") == {}
    assert hot_keys(even.where("fk < 0"), "fk") == {}


def test_a_lookup_does_not_group_the_child(no_broadcast, skewed):
    """Nothing but the summary runs while planning, and the join shuffles each side once."""
    parent = no_broadcast.range(40).selectExpr("id as pk", "id * 10 as v")
    plan = _plan(lookup_join(skewed, "fk", parent, "pk"))
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("share, least", [(8, 1), (3, 2), (2, 4)])
def test_hot_keys_spread_in_proportion(no_broadcast, share, least):
    child = no_broadcast.range(8000).selectExpr("id", f"if(id % {share} = 0, 7, 1000 + id) as fk")
    parent = no_broadcast.range(40).selectExpr("id as pk", "id * 10 as v")
    joined = lookup_join(child, "fk", parent, "pk")
    no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = joined.where("fk = 7").groupBy(F.spark_partition_id()).count().count()
    finally:
        no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks >= least and joined.where("v = 70").count() == -(-8000 // share)


def test_salted_lookup_equals_plain(no_broadcast, skewed):
    parent = no_broadcast.range(40).selectExpr("id as pk", "id * 10 as v")
    want = rows(skewed.join(parent, skewed.fk == parent.pk, "left").drop("pk"), "id")
    salted = lookup_join(skewed, "fk", parent, "pk")
    assert rows(salted, "id") == want
    no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = salted.where("fk = 7").groupBy(F.spark_partition_id()).count().count()
        plain = skewed.join(parent, skewed.fk == parent.pk, "left").where("fk = 7")
        alone = plain.groupBy(F.spark_partition_id()).count().count()
    finally:
        no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert alone == 1 and tasks > 4


def test_equal_rows_of_a_hot_key_are_spread(no_broadcast, tmp_path):
    """All rows alike, as in a table without a key."""
    no_broadcast.range(5000).selectExpr("7 as fk", "1 as v").write.parquet(str(tmp_path / "t"))
    parent = no_broadcast.range(20).selectExpr("id as pk", "id * 10 as w")
    child = with_spread(no_broadcast.read.parquet(str(tmp_path / "t"))).select("fk", SPREAD)
    joined = lookup_join(child, "fk", parent, "pk").select("fk", "w")
    assert rows(joined.groupBy("fk", "w").count(), "fk") == [(7, 70, 5000)]
    no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert joined.groupBy(F.spark_partition_id()).count().count() > 4
    finally:
        no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert with_spread(no_broadcast.range(3).groupBy("id").count()).columns == ["id", "count", SPREAD]


def test_positions_over_many_partitions(spark):
    values = [random.Random(1).randint(0, 20) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(8)
    got = with_position(df, [F.col("v").desc(), F.col("id")])
    want = {i: n for n, (i, _) in enumerate(sorted(enumerate(values), key=lambda p: (-p[1], p[0])))}
    assert {r.id: r.position for r in got.collect()} == want


def test_running_totals_over_many_partitions(spark):
    rng = random.Random(2)
    data = [(i, rng.randint(0, 9), rng.randint(0, 1000)) for i in range(1500)]
    df = spark.createDataFrame(data, "id int, a int, b int").repartition(8)
    got = with_running(df, [F.col("id")], sums={"s": "a"}, maxima={"m": "b"})
    total, best = 0, None
    for r in sorted(got.collect()):
        assert (r.s, r.m) == (total, best)
        total, best = total + r.a, r.b if best is None else max(best, r.b)


def test_decile_breaks_ties_by_key(spark):
    df = spark.range(1500).selectExpr("id", "cast(1 as double) as v")
    got = add_decile(df, "v", "id")
    sizes = dict(rows(got.groupBy("`[v]_decile`").count(), "`[v]_decile`"))
    assert sizes == {0: 74, **dict.fromkeys(range(1, 10), 150), 10: 76}
    assert got.where("id = 0").first()[2] == 10


def test_median_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 1, 1, 2, 3]), float(rng.randint(0, 50))) for _ in range(900)] + [(4, 2.0), (None, 1.0), (3, None)]
    df = spark.createDataFrame(data, "g int, v double").repartition(8)
    want = {
        g: statistics.median(v for k, v in data if k == g and v is not None) for g in {k for k, _ in data if k is not None}
    }
    assert dict(rows(group_median(df, "g", "v"), "g")) == want


def test_auc_against_pairs(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 1), rng.randint(0, 6), rng.random()) for _ in range(300)]
    df = spark.createDataFrame(data, "y int, a int, b double").repartition(8)

    def pairs(column):
        pos = [r[column] for r in data if r[0] == 1]
        neg = [r[column] for r in data if r[0] == 0]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))

    got = dict(rows(feature_auc(df, "y", ["a", "b"]), "feature"))
    assert got == pytest.approx({"a": pairs(1), "b": pairs(2)})


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["customer_feature_matrix", "agg_all_numeric", "count_by_flat_category", "flat_multi_hop", "wide_read",
     "agg_median", "row_decile", "label_encode", "feature_quality_auc", "interval_feature_export", "best_so_far"],
)
def test_plans_stay_in_the_engine(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["wide_read"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThanOrEqual(l_quantity,10.0)" in plan
    scan = _plan(QUERIES["agg_count"](spark, SF_DIR))
    assert "ReadSchema: struct<l_orderkey:bigint>" in scan


def test_shared_folder_is_taken_from_the_session():
    def session(folder, master):
        conf = SimpleNamespace(get=lambda name, default: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("hdfs://all/ckpt", "yarn")) == "hdfs://all/ckpt"
    assert shared_dir(session("hdfs://all/ckpt", "local[4]")) == "hdfs://all/ckpt"
    assert shared_dir(session(None, "local[4]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(None, "yarn"))


def test_bucketed_tables_need_no_shuffle(no_broadcast, tmp_path):
    """Tables bucketed by their keys are aggregated and attached where they are."""
    spark = no_broadcast
    names = {"bucketed_parent": "id", "bucketed_child": "fk"}
    frames = {
        "bucketed_parent": spark.range(50),
        "bucketed_child": spark.range(500).selectExpr("id % 50 as fk", "cast(id as double) as v"),
    }
    for name, key in names.items():
        path = str(tmp_path / name)
        frames[name].write.bucketBy(4, key).sortBy(key).option("path", path).saveAsTable(name)
    try:
        tables = catalog_tables(spark, names)
        out = aggregate_onto(
            tables["bucketed_parent"], "id", tables["bucketed_child"], "fk", [AggSpec("s", "sum", "v")]
        )
        assert "Exchange" not in _plan(out)
        assert out.agg(F.sum("s")).first()[0] == sum(range(500))
    finally:
        for name in names:
            spark.sql(f"drop table {name}")
