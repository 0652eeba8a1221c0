"""Models, reduction, clusters: shape, range, repeatability, and use on separable data."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array

from relloom.operators import explore, model
from relloom.operators.model import ForestParams

SMALL = ForestParams(n_estimators=5, max_depth=4, max_features=100)


@pytest.fixture(scope="module")
def separable(spark):
    return spark.range(200).selectExpr(
        "id", "cast(id % 2 as int) as y", "if(id % 2 = 0, -1.0D, 1.0D) * (1 + id % 7) as a",
        "cast(if(id % 11 = 0, null, id % 5) as double) as b", "if(id % 2 = 0, 'even', if(id % 3 = 0, null, 'odd')) as c",
        "5.0D as constant",
    ).cache()


def test_separable_data_is_learned(separable):
    fitted = model.fit_forests(separable, "y", ["a", "b", "constant"], ["c"], SMALL)
    scored = fitted.predict(separable)
    assert model.roc_auc(scored, "y") == 1.0
    assert "constant" not in fitted.names and {"c=even", "c=odd", "c="} <= set(fitted.names)
    assert scored.count() == 200 and set(scored.columns) == {*separable.columns, "cluster", "probability"}
    weights = [w for _, _, w in fitted.importances()]
    assert weights == sorted(weights, reverse=True)


def test_unknown_category_is_scored(spark, separable):
    fitted = model.fit_forests(separable, "y", ["a"], ["c"], SMALL)
    new = spark.createDataFrame([(1, 0, 3.0, "never seen")], "id long, y int, a double, c string")
    assert 0 <= fitted.predict(new).first().probability <= 1


def test_fits_repeat(separable):
    params = ForestParams(k=2, n_components=2, k_best_percent=50, reweight_ratio=3, n_estimators=5, max_depth=3)
    runs = [
        [tuple(r) for r in model.fit_forests(separable, "y", ["a", "b"], ["c"], params)
         .predict(separable).select("id", "cluster", "probability").orderBy("id").collect()]
        for _ in range(2)
    ]
    assert runs[0] == runs[1] and {c for _, c, _ in runs[0]} <= {0, 1}


def test_cluster_with_one_class_scores_a_half(spark):
    near = [(i, 1, float(i % 5)) for i in range(40)]
    far = [(100 + i, i % 2, 1000.0 + i % 2) for i in range(40)]
    df = spark.createDataFrame(near + far, "id int, y int, a double")
    fitted = model.fit_forests(df, "y", ["a"], [], ForestParams(k=2, n_estimators=3, max_depth=2))
    scored = fitted.predict(df)
    assert {r.probability for r in scored.where("id < 100").collect()} == {0.5}
    assert model.roc_auc(scored.where("id >= 100"), "y") == 1.0


def test_cross_validation_and_search(separable):
    scores = model.cv_scores(separable, "id", "y", ["a"], [], SMALL)
    assert scores == [1.0, 1.0, 1.0]
    weak = ForestParams(n_estimators=1, max_depth=1, max_features=100)
    found = model.param_search(separable, "id", "y", ["b"], [], [weak, SMALL], folds=2)
    assert found[0][1] >= found[1][1] or found[0][2] > found[1][2]
    # one of two points is fitted whole; the other stays at a ninth of its trees, rounded up
    assert [trees for point, _, trees in found] == [found[0][0].n_estimators, -(-found[1][0].n_estimators // 9)]
    points = model.random_points(5, seed=1)
    assert points == model.random_points(5, seed=1)
    assert all(model.PARAM_RANGES["max_depth"][0] <= p.max_depth <= model.PARAM_RANGES["max_depth"][1] for p in points)


def test_search_clusters_rows_once_for_points_that_share_them(separable, monkeypatch):
    asked = []

    class Counted(model.KMeans):
        def fit(self, rows):
            asked.append(self.getK())
            return super().fit(rows)

    monkeypatch.setattr(model, "KMeans", Counted)
    points = [ForestParams(k=2, k_best_percent=p, n_estimators=3, max_depth=2, max_features=100) for p in (40, 100)]
    found = model.param_search(separable, "id", "y", ["a", "b"], ["c"], points, folds=2, rounds=2)
    assert len(found) == 2 and asked == [2, 2]


def test_shared_order_of_features_chooses_as_the_selector(separable):
    rows = separable.selectExpr("double(y) as _label", "array(a, double(id % 5), double(id % 3), a * (id % 4)) as v")
    ready = rows.select("_label", array_to_vector("v").alias("_features"))
    shared = model._Clusters(ready, 1, 0)
    members = shared.members(0, 1)
    for n in range(1, 5):
        assert sorted(shared.ranked(0, members, 4)[:n]) == sorted(model._selector(n).fit(members).selectedFeatures)


def test_quality_by_model(separable):
    quality = model.feature_quality_by_model(separable, "id", "y", ["a", "constant"], ["c"], SMALL)
    assert quality["a"] == 1.0 and quality["c"] == 1.0 and quality["constant"] == 0.0


def test_truncated_svd_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3.0, 1.0, (60, 6))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *"abcdef"])
    vectors = VectorAssembler(inputCols=list("abcdef"), outputCol="x").transform(df)
    got = model.truncated_svd(vectors, "x", "z", 3).transform(vectors)
    z = np.array([r.z for r in got.select("id", vector_to_array("z").alias("z")).orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(z), np.abs(x @ vt[:3].T), atol=1e-6)


def test_clusters(spark):
    df = spark.range(120).selectExpr(
        "id", "if(id % 2 = 0, 0D, 50D) + (id % 7) * 0.1D as a",
        *[f"cast(if(id % 13 = 0, null, (id * {p}) % 17) as double) as x{p}" for p in (2, 3, 5, 7, 11, 19, 23, 29, 31, 37, 41)],
    )
    columns = df.columns[1:]
    assigned = explore.cluster_assign(df, "id", ["a"], k=2)
    by_cluster = {r.cluster: r.n for r in assigned.groupBy("cluster").count().withColumnRenamed("count", "n").collect()}
    assert sorted(by_cluster.values()) == [60, 60]
    full = explore.standard_vectors(df, "id", columns).join(assigned.select("id", "cluster"), "id")
    found = explore.cluster_explain(full, columns)
    assert {r.feature for r in found.collect()} == {"a"}
    points = explore.cluster_coordinates(full, "id")
    assert points.columns == ["id", "cluster", "x", "y"] and points.count() == 120


def test_registered_searches_have_the_whole_width(spark, monkeypatch):
    from conftest import SF_DIR

    from relloom.workload import QUERIES

    asked = {}

    def search(rows, id_column, label, numeric, categorical, points, folds=3):
        asked.update(points=points, folds=folds)
        return [(p, 0.5, p.n_estimators) for p in points]

    def quality(rows, id_column, label, numeric, categorical=(), params=None, folds=2):
        asked.update(features=[*numeric, *categorical], params=params)
        return dict.fromkeys(asked["features"], 0.5)

    monkeypatch.setattr(model, "param_search", search)
    monkeypatch.setattr(model, "feature_quality_by_model", quality)
    found = QUERIES["param_search"](spark, SF_DIR)
    assert found.columns == [*model.PARAM_RANGES, "auc", "trees"] and found.count() == len(asked["points"]) == 30
    assert asked["folds"] == 3
    for name in model.PARAM_RANGES:
        assert len({getattr(p, name) for p in asked["points"]}) > 2
    assert QUERIES["feature_quality_model"](spark, SF_DIR).count() == 5
    assert set(asked["features"]) == {"length_text", "n_chars", "label_quality", "lang", "source"}
    assert asked["params"] == ForestParams()
