"""Sparse blocks of counts against wide columns, and with a million values."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from relloom.functions.predicates import Predicate
from relloom.operators import categories as cat
from relloom.operators.aggregate import category_counts
from relloom.operators.intervals import interval_number, window_bounds

START = datetime(2024, 3, 1)


@pytest.fixture
def child(spark):
    rows = [(k % 5 if k % 11 else None, ["a", "b", None, "", "c"][k * k % 5], START + timedelta(hours=k * 7), k) for k in range(400)]
    return spark.createDataFrame(rows, "fk long, v string, ts timestamp_ntz, place int")


def test_places_are_those_of_sorted_values(child):
    codes = cat.dictionary(child, "v")
    assert [tuple(r) for r in codes.orderBy("place").collect()] == [("a", 0), ("b", 1)] + ([("c", 2)] if child.where("v='c'").count() else [])


def test_sparse_equals_wide_for_chosen_values(child):
    codes = cat.dictionary(child, "v")
    for predicate in (None, Predicate.of(("place", ">", 100))):
        sparse = cat.sparse_counts(child, "fk", "v", codes, predicate)
        names = {"a": "n_a", "b": "n_b", "missing": "n_missing"}
        got = cat.chosen_values(sparse, "fk", codes, names)
        want = category_counts(child, "fk", "v", names, predicate)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cells_equal_windows_and_values(child):
    codes = cat.dictionary(child, "v")
    n, days = 6, 10
    width = codes.count()
    bounds = window_bounds(child.agg(F.max("ts")).first()[0], child.agg(F.min("ts")).first()[0], n, days)
    rows = child.where("fk is not null").select("fk", "v", interval_number("ts", bounds).alias("w"))
    place = {r.value: r.place for r in codes.collect()}
    want: dict = {}
    for r in rows.collect():
        if r.w is not None and r.v in place:
            cells = want.setdefault(r.fk, {})
            cells[r.w * width + place[r.v]] = cells.get(r.w * width + place[r.v], 0) + 1
    got = {r.fk: dict(zip(r.places, r.counts, strict=True)) for r in cat.sparse_cells(child, "fk", "ts", "v", codes, n, days).collect()}
    assert got == want and all(list(c) == sorted(c) for c in got.values())


def test_window_edges_belong_to_the_older_window(spark):
    latest = datetime(2024, 5, 20)
    times = [latest, latest - timedelta(days=7), latest - timedelta(days=7) + timedelta(microseconds=1),
             latest - timedelta(days=21), latest + timedelta(seconds=1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    got = [r[0] for r in df.select(cat.window_number("ts", latest, 7, 3)).collect()]
    assert got == [2, 1, 2, None, None]


def test_vectors_and_one_hot(child):
    codes = cat.dictionary(child, "v")
    sparse = cat.sparse_counts(child, "fk", "v", codes)
    width = codes.count()
    vectors = {r.fk: r.features for r in cat.as_vectors(sparse, "fk", width).collect()}
    assert vectors == {r.fk: SparseVector(width, dict(zip(r.places, map(float, r.counts), strict=True))) for r in sparse.collect()}
    place = {r.value: r.place for r in codes.collect()}
    hot = cat.one_hot_places(child.select("fk", "v"), "v", codes).collect()
    assert len(hot) == 400 and all(list(r.places) == ([place[r.v]] if r.v in place else []) for r in hot)
    assert all(list(r.counts) == [1] * len(r.places) for r in hot)


def test_a_million_values_are_not_collected(spark, monkeypatch):
    child = spark.range(1_200_000).selectExpr("id % 7 as fk", "id % 1000000 as v")
    collected = []
    real = type(child).collect
    monkeypatch.setattr(type(child), "collect", lambda df: collected.append(len(rows := real(df))) or rows)
    codes = cat.dictionary(child, "v")
    sparse = cat.sparse_counts(child, "fk", "v", codes)
    total = sparse.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)).alias("n"),
                       F.sum(F.size("places")).alias("cells"))
    got = total.collect()[0]
    assert got.n == 1_200_000 and got.cells == child.distinct().count() and max(collected) < 100


def test_a_thousand_values_by_ten_windows_scan_the_child_once(spark, tmp_path):
    path = str(tmp_path / "child")
    spark.range(60_000).selectExpr(
        "id % 40 as fk", "id % 1000 as v", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id % 1680) as ts"
    ).write.parquet(path)
    child = spark.read.parquet(path)
    codes = cat.dictionary(child, "v")
    sparse = cat.sparse_cells(child, "fk", "ts", "v", codes, 10, 7)
    plan = sparse._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # the child and the dictionary
    assert "Expand" not in plan and "Python" not in plan
    assert sparse.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n))).first()[0] == 60_000


def test_empty_tables(child):
    codes = cat.dictionary(child.where("fk < 0"), "v")
    assert codes.count() == 0
    assert cat.sparse_counts(child, "fk", "v", codes).count() == 0
    assert cat.sparse_cells(child.where("fk < 0"), "fk", "ts", "v", cat.dictionary(child, "v")).count() == 0
