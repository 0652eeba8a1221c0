"""the forests of a parameter search grow together."""

from __future__ import annotations

import numpy as np
import pytest

from relloom.operators import forest, model
from relloom.operators.forest import Forest
from relloom.operators.model import ForestParams


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=(3, 1500))
    y = (rng.random(1500) < 1 / (1 + np.exp(2 - a - np.abs(b)))).astype(int)
    rows = [(k, int(y[k]), float(a[k]), float(b[k]), round(float(c[k])), f"v{k % 5}") for k in range(1500)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c int, d string").cache()


@pytest.mark.parametrize("params", [
    ForestParams(n_estimators=60, max_depth=6, max_features=50, reweight_ratio=3),
    ForestParams(n_estimators=60, max_depth=12, max_features=100, k=2, k_best_percent=60),
    ForestParams(n_estimators=60, max_depth=5, max_features=100, n_components=3),
])
def test_search_scores_as_the_forests_of_spark(noisy, params):
    given = noisy, "id", "y", ["a", "b", "c"], ["d"]
    want = np.mean(model.cv_scores(*given, params, folds=2))
    [(point, auc, trees)] = model.param_search(*given, [params], folds=2, rounds=1)
    assert point == params and trees == 60
    assert auc == pytest.approx(want, abs=0.02) and auc > 0.6


def test_trees_do_not_depend_on_blocks(noisy, monkeypatch):
    """Data sets of several blocks grow level by level; their trees are those of one block."""
    points = [ForestParams(n_estimators=9, max_depth=4, max_features=50, k=k, k_best_percent=70, reweight_ratio=2) for k in (1, 2)]
    given = noisy.limit(400), "id", "y", ["a", "b", "c"], ["d"], points
    whole = model.param_search(*given, folds=2, rounds=2)
    asked, apart = [], forest.grow_apart

    def watched(blocks, *rest):
        asked.append(blocks.count())
        return apart(blocks, *rest)

    monkeypatch.setattr(forest, "grow_apart", watched)
    monkeypatch.setattr(forest, "BLOCK_BYTES", 500)
    assert model.param_search(*given, folds=2, rounds=2) == whole
    assert asked and max(asked) > 1


def test_jobs_of_a_search_do_not_grow_with_its_points(spark, noisy):
    """A fit took a row of jobs per cluster and level of its trees."""
    counts = []
    for n in (1, 4):
        spark.sparkContext.setJobGroup(f"search{n}", "")
        points = [ForestParams(n_estimators=6, max_depth=8, max_features=40 + k) for k in range(n)]
        model.param_search(noisy, "id", "y", ["a", "b"], [], points, folds=2, rounds=1)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search{n}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert 0 < counts[1] <= counts[0] + 2


def test_tree_against_brute_force():
    """The first cut of a tree has the least Gini impurity, and the last leaves are of one class."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 6, (3, 80)).astype(np.uint8)
    classes = ((bins[1] > 2) ^ (rng.random(80) < 0.2)).astype(np.int64)
    made = Forest(0, 0, 0, 1, 20, 3, [0, 1, 2], [1.0, 2.0], 3)
    ids = np.arange(80, dtype=np.uint64)
    tree = forest.grow(bins, [6, 6, 6], ids, classes, made, 0, 1)
    weight = forest.copies(ids, forest.tree_keys(made, 0, 1))[0] * np.array(made.weights)[classes]

    def impurity(on):
        both = np.array([weight[on & (classes == c)].sum() for c in (0, 1)])
        return both.sum() - (both * both).sum() / both.sum() if both.sum() else 0.0

    tried = {(f, c): impurity(bins[f] <= c) + impurity(bins[f] > c) for f in range(3) for c in range(5)}
    assert tried[tree.feature[0], tree.cut[0]] == pytest.approx(min(tried.values()))
    leaves = tree.places(bins, np.zeros(80, np.int64), np.arange(80))
    for leaf in np.unique(leaves):
        for c in (0, 1):
            assert weight[(leaves == leaf) & (classes == c)].sum() == tree.stats[leaf, c]
    assert np.abs(forest.copies(np.arange(20_000, dtype=np.uint64), np.array([7], np.uint64)).mean() - 1) < 0.05
    picked = forest.chosen(np.arange(5000, dtype=np.uint64), 10, 3)
    assert (picked.sum(1) == 3).all() and np.abs(picked.mean(0) - 0.3).max() < 0.03


@pytest.mark.parametrize("values", [[1, 0, 1, 0], [1, 1, 1], [0, 0]])
def test_aucs_of_one_class_are_those_of_the_evaluator(spark, values):
    rows = [(0, k, float(v), float(k % 2) * 0.5, 1) for k, v in enumerate(values)]
    votes = spark.createDataFrame(rows, forest.VOTES)
    scored = votes.selectExpr("label", "votes as probability")
    assert model._aucs([votes], [0, 1]) == {0: pytest.approx(model.roc_auc(scored, "label")), 1: 0.5}
