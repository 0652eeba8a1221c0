"""The randomised decomposition against a dense one, over dense and sparse vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from relloom.operators import svd


def frame(spark, rows):
    return spark.createDataFrame([(k, v) for k, v in enumerate(rows)], ["id", "x"])


def matrix(n, width, seed, decay=0.9):
    draw = np.random.default_rng(seed)
    return draw.standard_normal((n, width)) * decay ** np.arange(width) + 0.3


@pytest.mark.parametrize("k", [1, 4, 12])
def test_singular_values_equal_a_dense_decomposition(spark, k):
    x = matrix(200, 12, 1)
    model = svd.truncated_svd(frame(spark, [Vectors.dense(r) for r in x]).repartition(3), "x", "z", k)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.singular_values, want[:k], rtol=1e-9)
    assert np.allclose(np.abs((model.components * vt[:k].T).sum(0)), 1, atol=1e-6)


def test_flat_spectra_wider_than_the_block(spark):
    x = np.random.default_rng(5).standard_normal((400, 90))
    model = svd.truncated_svd(frame(spark, [Vectors.dense(r) for r in x]), "x", "z", 5)
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(model.singular_values, want[:5], rtol=1e-6)
    assert np.allclose(model.components.T @ model.components, np.eye(5), atol=1e-9)


def test_dense_and_sparse_rows_mix(spark):
    x = matrix(60, 30, 2) * (np.random.default_rng(3).random((60, 30)) < 0.2)
    x[7] = 0
    rows = [Vectors.dense(r) if k % 3 == 0 else Vectors.sparse(30, np.flatnonzero(r).tolist(), r[r != 0].tolist())
            for k, r in enumerate(x)]
    df = frame(spark, rows).repartition(4)
    model = svd.truncated_svd(df, "x", "z", 6)
    want = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(model.singular_values, want[:6], rtol=1e-6)
    got = {r.id: np.array(r.z) for r in model.transform(df).select("id", vector_to_array("z").alias("z")).collect()}
    assert all(np.allclose(got[k], x[k] @ model.components) for k in range(60))


def test_steps_of_a_few_rows(spark, monkeypatch):
    x = matrix(50, 9, 4)
    rows = svd.entries(frame(spark, [Vectors.dense(r) for r in x]).toArrow()["x"])
    monkeypatch.setattr(svd, "STEP_NUMBERS", 40)
    batch = frame(spark, [Vectors.dense(r) for r in x]).toArrow().combine_chunks().to_batches()[0]
    parts = list(svd._steps(iter([batch]), 2))
    assert len(parts) == 25 and np.array_equal(np.concatenate([p.values for p in parts]), rows.values)


def test_a_hundred_thousand_sparse_columns(spark):
    """Three strong directions among 100,000 columns; nothing of width x width fits here."""
    width, n = 100_000, 300
    draw = np.random.default_rng(6)
    rows = []
    for k in range(n):
        columns = np.unique(draw.integers(0, width, 20))
        values = dict.fromkeys(columns.tolist(), 0.01) | {[5, 70_000, 99_999][k % 3]: 3.0 - k % 3}
        rows.append(Vectors.sparse(width, values))
    model = svd.truncated_svd(frame(spark, rows), "x", "z", 3, oversample=5)
    assert np.allclose(model.singular_values, [30.0, 20.0, 10.0], rtol=1e-3)
    assert list(np.abs(model.components).argmax(0)) == [5, 70_000, 99_999]


def test_empty_and_zero_rows(spark):
    empty = frame(spark, [Vectors.dense([1.0, 2.0])]).where("id < 0")
    assert len(svd.truncated_svd(empty, "x", "z", 2).singular_values) == 0
    zero = svd.truncated_svd(frame(spark, [Vectors.dense([0.0, 0.0])]), "x", "z", 2)
    assert np.allclose(zero.singular_values, 0)
