"""Small fixtures for what the given tables do not show."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import rows

from relloom.entityset import EntityConfig, EntitySet
from relloom.functions.predicates import Comparison, Predicate
from relloom.functions.rows import add_row_features, chosen_row_functions
from relloom.operators import profile
from relloom.operators.aggregate import AggSpec, aggregate, aggregate_onto, category_counts, mean_gap_days
from relloom.operators.explore import scatter_sample
from relloom.operators.intervals import interval_predicates, interval_rows, window_bounds
from relloom.operators.matrix import label_encode, one_hot, training_matrix
from relloom.operators.statistics import best_features, class_weights, feature_quality, scale_unit_variance


@pytest.fixture
def parent(spark):
    return spark.createDataFrame([(1,), (2,), (3,)], "id long")


def test_count_of_childless_parent_and_null_key(spark, parent):
    child = spark.createDataFrame([(1, 5.0), (1, 7.0), (None, 9.0)], "fk long, v double")
    out = aggregate_onto(parent, "id", child, "fk", [AggSpec("n", "COUNT"), AggSpec("s", "sum", "v")])
    assert rows(out, "id") == [(1, 2, 12.0), (2, None, None), (3, None, None)]


def test_deviation_of_one_child_is_zero(spark, parent):
    child = spark.createDataFrame([(1, 5.0)], "fk long, v double")
    out = aggregate_onto(parent, "id", child, "fk", [AggSpec("d", "std", "v")])
    assert rows(out, "id")[0] == (1, 0.0)


def test_category_without_match_is_null(spark):
    child = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "fk long, c string")
    out = category_counts(child, "fk", "c", {"a": "n_a", "b": "n_b"})
    assert rows(out, "fk") == [(1, 2, None), (2, None, 1)]


def test_many_values_are_pivoted_with_the_same_result(spark):
    child = spark.range(400).selectExpr("id % 7 as fk", "cast(id % 40 as int) as c")
    names = {v: f"n_{v}" for v in range(41)}
    wide = category_counts(child, "fk", "c", names)
    assert "pivot" in wide._jdf.queryExecution().optimizedPlan().toString().lower()
    narrow = {}
    for v in (0, 39, 40):
        for fk, n in rows(category_counts(child, "fk", "c", {v: "n"}), "fk"):
            narrow[(fk, v)] = n
    for r in wide.collect():
        for v in (0, 39, 40):
            assert r[f"n_{v}"] == narrow.get((r.fk, v))


def test_many_windows_are_pivoted_with_the_same_result(spark):
    child = spark.range(500).selectExpr(
        "if(id % 9 = 0, null, id % 5) as fk", "timestamp_ntz'2024-03-01' - make_interval(0, 0, 0, int(id % 70)) as ts",
        "cast(id % 13 as double) as v", "cast(id % 7 as double) as w",
    )
    windows = interval_predicates("ts", datetime(2024, 3, 1), datetime(2023, 1, 1), 6, 7)
    measures = [("COUNT", None), ("sum", "v"), ("avg", "v"), ("max", "w"), ("std", "w"), ("min", "v")]
    specs = [AggSpec(f"{f}_{c}_{p.interval}", f, c, p) for p in windows for f, c in measures]
    specs.append(AggSpec("everything", "COUNT"))
    got = {r.fk: r for r in aggregate(child, "fk", specs).collect()}
    plan = aggregate(child, "fk", specs)._jdf.queryExecution().optimizedPlan().toString()
    assert "pivotfirst" in plan and len(got) == 5
    for spec in specs:
        for r in aggregate(child, "fk", [spec, AggSpec("all", "COUNT")]).collect():
            assert got[r.fk][spec.name] == pytest.approx(r[spec.name]), spec


def test_shared_condition_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id % 2 as fk", "cast(id as double) as v").write.parquet(str(tmp_path / "t"))
    child = spark.read.parquet(str(tmp_path / "t"))
    late = Predicate.of(("v", ">", 3.0))
    out = aggregate(child, "fk", [AggSpec("n", "COUNT", None, late), AggSpec("s", "sum", "v", late)])
    assert "GreaterThan(v,3.0)" in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out, "fk") == [(0, 3, 18.0), (1, 3, 21.0)]


def test_distinct_values_skip_null_and_empty(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "c string")
    assert rows(profile.distinct_values(df, "c"), "value") == [("x",)]


def test_binary_columns(spark):
    df = spark.range(5000).selectExpr(
        "id % 2 as two", "id % 3 as three", "if(id < 4000, 1, id) as late", "if(id % 2 = 0, null, 'x') as one"
    )
    assert profile.binary_columns(df, df.columns) == ["two", "one"]


def test_one_to_one_ignores_childless_parents(spark, parent):
    child = spark.createDataFrame([(1,), (3,)], "fk long")
    assert profile.one_to_one(parent, "id", child, "fk").first()[0] is True
    twice = child.union(spark.createDataFrame([(1,)], "fk long"))
    assert profile.one_to_one(parent, "id", twice, "fk").first()[0] is False
    nothing = child.where("fk > 9")
    assert profile.one_to_one(parent, "id", nothing, "fk").first()[0] is False


def test_text_length_counts_bytes_and_weekdays_start_on_monday(spark):
    df = spark.createDataFrame(
        [(1, "é", date(2024, 1, 1)), (2, "ab", date(2024, 1, 7))], "id int, t string, d date"
    )
    out = add_row_features(df, ["id"], ["t"])
    assert rows(out.select("id", "`length(t)`", "`weekday(d)`", "`month(d)`"), "id") == [(1, 2, 0, 1), (2, 2, 6, 1)]


def test_row_function_choice():
    names = lambda *a: [f.name for f in chosen_row_functions(*a)]
    assert names() == ["text_length", "weekday", "month"]
    assert names([]) == []
    assert names(None, ["length"]) == ["weekday", "month"]
    assert names(None, ["text_length", "month"]) == ["weekday"]
    assert names(["month", "weekday"], ["weekday"]) == ["month"]


def test_predicates():
    a = Predicate.of(("x", "=", 1, "t.x"))
    b = Predicate.of(Comparison("y", " is  not null", None, "t.y", hidden=True))
    assert (a & b).label == "t.x=1"
    assert (a & Predicate.of(("z", "<", 2))).label == "t.x=1_AND_z<2"
    window = Predicate((Comparison("d", ">", "2020"),), "int=3", 3)
    assert (window & a).label == "int=3_AND_t.x=1" and (window & a).interval == 3
    with pytest.raises(ValueError, match="unknown operator"):
        Comparison("x", "~~", 1)


def test_interval_edges_belong_to_the_older_window(spark):
    latest = datetime(2024, 1, 29)
    child = spark.createDataFrame(
        [(1, latest, 1.0), (1, datetime(2024, 1, 22), 2.0), (1, datetime(2024, 1, 22, 0, 0, 1), 4.0),
         (1, datetime(2023, 1, 1), 8.0)],
        "fk int, ts timestamp_ntz, v double",
    )
    assert rows(interval_rows(child, "fk", "ts", "v", 4, 7), "interval") == [(1, 2, 1, 2.0), (1, 3, 2, 5.0)]


def test_intervals_stop_after_the_earliest_value():
    bounds = window_bounds(datetime(2024, 1, 29), datetime(2024, 1, 20), 10, 7)
    assert [n for n, _, _ in bounds] == [9, 8]
    assert [p.interval for p in interval_predicates("d", date(2024, 1, 29), date(2024, 1, 1), 3, 7)] == [2, 1, 0]
    assert window_bounds(None, None) == []


def test_mean_gap(spark):
    child = spark.createDataFrame(
        [(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 3)), (1, datetime(2024, 1, 5)), (2, datetime(2024, 1, 1))],
        "fk int, ts timestamp_ntz",
    )
    assert rows(mean_gap_days(child, "fk", "ts"), "fk") == [(1, 2.0), (2, None)]


def test_training_matrix_labels(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1.0, 3.0)], "id int, y double, f double")
    assert rows(training_matrix(df, "id", "y", ["f"]), "id") == [(1, 0, 2.0), (2, 1, 3.0)]
    assert rows(training_matrix(df, "id", "y", ["f"], include_unlabeled=False), "id") == [(2, 1, 3.0)]


def test_label_encode_puts_null_first(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, c string")
    assert rows(label_encode(df, "c", "code").select("id", "code"), "id") == [(1, 2), (2, 0), (3, 1), (4, 2)]


def test_one_hot_of_unknown_is_zero(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, c string")
    assert rows(one_hot(df, "c", ["a", "b"]).drop("c"), "id") == [(1, 1, 0), (2, 0, 0), (3, 0, 0)]


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    assert rows(scale_unit_variance(df, ["a", "b"]), "a") == [(1.0, 4.0), (3.0, 4.0)]


def test_class_weights(spark):
    tie = spark.createDataFrame([(0,), (0,), (1,), (1,)], "y int")
    assert rows(class_weights(tie, "y", 3), "y", "weight") == [(0, 3.0), (0, 3.0), (1, 1.0), (1, 1.0)]
    many = spark.createDataFrame([(0,), (1,), (2,)], "y int")
    assert {w for _, w in rows(class_weights(many, "y", 3), "y")} == {1.0}


def test_feature_quality_and_choice(spark):
    data = [(i % 2, float(i % 2), float(-(i % 2)), 1.0) for i in range(10)]
    df = spark.createDataFrame(data, "y int, same double, opposite double, flat double")
    quality = dict(rows(feature_quality(df, "y", ["same", "opposite", "flat"]), "feature"))
    assert quality == {"same": 1.0, "opposite": 1.0, "flat": 0.5}
    one_class = df.where("y = 1")
    assert dict(rows(feature_quality(one_class, "y", ["same"]), "feature")) == {"same": 0.0}
    noisy = spark.createDataFrame([(i % 2, (i % 2) + (i % 3) * 0.1, i % 5 * 1.0) for i in range(30)], "y int, a double, b double")
    assert best_features(noisy, "y", ["a", "b"], 1) == ["a"]


def test_scatter_sample_needs_enough_rows(spark):
    df = spark.range(5).selectExpr("id", "cast(null as double) as x", "id * 1.0D as y")
    assert scatter_sample(df, "id", "x", "y", 5).count() == 5
    assert {r.x for r in scatter_sample(df, "id", "x", "y", 3).collect()} == {0.0}
    with pytest.raises(ValueError, match="larger than the population"):
        scatter_sample(df, "id", "x", "y", 6)


def test_config_spellings():
    assert EntityConfig.parse({"one-to-one": ["A"]}).one_to_one == {"A": True}
    assert EntityConfig.parse({"one_to_one": {"A": False}}).one_to_one == {"A": False}
    assert EntityConfig.parse({}).included_row_functions is None
    assert EntityConfig.parse({"included_row_functions": []}).included_row_functions == ()


def test_entities_keep_their_own_config(spark):
    es = EntitySet({"entities": {"a": {"excluded_agg_entities": ["b"]}}})
    df = spark.range(1)
    es.add_entity("a", df, "id").add_entity("b", df, "id")
    assert es["b"].config.excluded_agg_entities == ()
    with pytest.raises(ValueError, match="no column"):
        es.add_relationship("b", "nope", "a")


@pytest.mark.parametrize("n", [31, 32, 200])
def test_many_categories_count_as_few_do(spark, n):
    from pyspark.sql import functions as F

    from relloom.functions import aggregates
    from relloom.functions.predicates import Predicate
    from relloom.operators.aggregate import AggSpec, aggregate

    aggregates.register_aggregate("TENFOLD", lambda c: F.count(c) * 10, counts_rows=True)
    try:
        rows = spark.createDataFrame([(k % 3, k % n) for k in range(3 * n)] + [(9, None)], "fk int, v int")
        specs = [
            AggSpec(f"{f}_{v}", f, None, Predicate.of(("v", "=", v))) for v in range(n) for f in ("COUNT", "TENFOLD")
        ]
        got = {r.fk: r for r in aggregate(rows, "fk", specs).collect()}
    finally:
        del aggregates.AGGREGATES["TENFOLD"]
    for fk in (0, 1, 2, 9):
        for v in range(n):
            count = sum(k % 3 == fk and k % n == v for k in range(3 * n))
            assert got[fk][f"COUNT_{v}"] == (count or None) and got[fk][f"TENFOLD_{v}"] == (10 * count or None)


def test_windows_follow_the_session_not_the_process(spark, monkeypatch):
    import time as clock

    from relloom.operators.intervals import interval_rows

    rows = spark.sql("select 1 as fk, v, timestamp_seconds(1700000000 + v * 86400) as ts from values (0), (3), (8), (15) as t(v)")
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        monkeypatch.setenv("TZ", zone)
        clock.tzset()
        got = {r.interval: r.total for r in interval_rows(rows, "fk", "ts", "v").collect()}
        assert got == {9: 15, 8: 11, 7: 0} or got == {9: 15, 8: 8 + 3, 7: 0}
    monkeypatch.undo()
    clock.tzset()


def test_a_category_of_any_width_is_a_filter(spark):
    from relloom.plans.build import feature_matrix
    from relloom.plans.synthesis import synthesize

    es = EntitySet({"entities": {"child": {"feature_metadata": {
        "c": {"categorical": True, "numeric": False, "categorical_filter": True}}}}})
    es.add_entity("parent", spark.range(2).withColumnRenamed("id", "p"), key="p")
    child = spark.range(10_003).selectExpr("id", "id % 2 as k", "if(id < 2, null, concat('v', (id - 2) % 10001)) as c")
    es.add_entity("child", child, key="id")
    es.add_relationship("child", "k", "parent")
    assert len(es.profile.values("child", "c")) == 10_001
    counts = profile.value_counts(child, "k", "c")
    assert counts.count() == 10_001 and counts.agg({"n": "sum"}).first()[0] == 10_001
    made = synthesize(es, "parent")
    asked = [made.features["parent"][f"COUNT(child[child.c={v}])"] for v in ("v0", "v9999", "v10000")]
    assert rows(feature_matrix(made, "parent", asked), "p") == [(0, 1, None, 1), (1, None, 1, None)]
