"""what order_feature_matrix sends, and that the results do not depend on it."""

from __future__ import annotations

from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from relloom.operators.aggregate import AggSpec, aggregate
from relloom.plans import build
from relloom.workload import QUERIES

SPECS = [AggSpec(f"{f}_{c}", f, c) for c in ("a", "b", "c", "d") for f in ("sum", "avg", "max", "std", "min")]


def _child(spark, keys):
    made = spark.range(1000).select(F.pmod("id", F.lit(keys)).alias("k"), *[(F.col("id") * n % 17).alias(c) for n, c in enumerate("abcd", 1)])
    return made.union(spark.createDataFrame([(None, 1, 1, 1, 1), (5, None, None, None, None)], made.schema))


def _sends_rows(df):
    return "REPARTITION_BY_COL" in df._jdf.queryExecution().toString()


def test_few_rows_to_a_key_are_sent_as_rows(spark):
    few, many = _child(spark, 250), _child(spark, 2)
    sent = aggregate(few, "k", SPECS, few)
    assert _sends_rows(sent) and not _sends_rows(aggregate(few, "k", SPECS)) and not _sends_rows(aggregate(few, "k", SPECS[:5], few))
    assert not _sends_rows(aggregate(many, "k", SPECS, many))
    exact = ["k", *[s.name for s in SPECS if s.function != "std"]]
    assert rows(sent.select(*exact), "k") == rows(aggregate(few, "k", SPECS).select(*exact), "k")


def test_hot_keys_keep_their_states(spark):
    hot = _child(spark, 500).union(spark.range(300).selectExpr("7L", "id", "id", "id", "id"))
    assert not _sends_rows(aggregate(hot, "k", SPECS, hot))


def test_orders_are_looked_up_once_along_an_edge(spark, monkeypatch):
    calls, join = [], build.lookup_join
    monkeypatch.setattr(build, "lookup_join", lambda *a, **k: (calls.append(a[1]), join(*a, **k))[1])
    made = QUERIES["order_feature_matrix"](spark, SF_DIR)
    assert calls == ["o_custkey"] and "c_custkey_c_name" in made.columns


def test_repeated_customers_are_looked_up_before_they_are_counted(spark, tmp_path, monkeypatch):
    for name in ("customer", "orders", "lineitem"):
        df = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        (df.union(df.limit(1)) if name == "customer" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    calls, join = [], build.lookup_join
    monkeypatch.setattr(build, "lookup_join", lambda *a, **k: (calls.append(a[1]), join(*a, **k))[1])
    QUERIES["order_feature_matrix"](spark, str(tmp_path))
    assert calls == ["o_custkey"] * 2
