"""Readers and sinks."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import SF_DIR, rows

from relloom.entityset import EntitySet
from relloom.plans.build import feature_matrix
from relloom.plans.synthesis import synthesize
from relloom.sources import readers, writers


def _lines(path) -> list[str]:
    return sorted(line for part in Path(path).rglob("part-*") for line in part.read_text().splitlines())


def test_readers(spark, tmp_path):
    tables = readers.parquet_tables(spark, SF_DIR, ["region", "nation"])
    assert tables["nation"].count() == 25
    tables["region"].createOrReplaceTempView("region_view")
    assert readers.catalog_tables(spark, ["region_view"])["region_view"].count() == 5
    ids = tmp_path / "ids.txt"
    ids.write_text("3\n1\n\n3\n")
    assert rows(readers.id_list(spark, str(ids)), "id") == [(1,), (3,)]


def test_predictions(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.25), (2, 0.5)], "id int, probability double")
    writers.write_predictions(scored, str(tmp_path / "plain"), "id")
    assert _lines(tmp_path / "plain") == ["1,0.25", "2,0.5"]
    ids = spark.createDataFrame([(1, "u1", "m9"), (2, "u2", "m8")], "known int, user string, merchant string")
    writers.write_predictions(scored, str(tmp_path / "mapped"), "id", ["user_id", "merchant_id", "prob"], ids)
    text = _lines(tmp_path / "mapped")
    assert {"u1,m9,0.25", "u2,m8,0.5", "user_id,merchant_id,prob"} == set(text)


def test_best_so_far(spark, tmp_path):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.6), (3, 0.9)], "step int, score double")
    writers.write_best_so_far(scores, str(tmp_path / "best"), "step", "score")
    assert _lines(tmp_path / "best") == ["0,", "1,0.5", "2,0.7", "3,0.7"]


@pytest.fixture
def shops(spark):
    start = datetime(2024, 1, 1)
    events = [(i, 1 + i % 2, start + timedelta(days=i), float(i)) for i in range(20)]
    es = EntitySet({"entities": {"shop": {"make_intervals": {"sale": {"n_intervals": 3, "delta_days": 7}}}}})
    es.add_entity("shop", spark.createDataFrame([(1,), (2,), (3,)], "shop_id int"), "shop_id")
    es.add_entity("sale", spark.createDataFrame(events, "sale_id int, shop int, day timestamp_ntz, v double"), "sale_id")
    return synthesize(es.add_relationship("sale", "shop", "shop"), "shop")


def test_interval_features_and_export(shops, tmp_path):
    windows = [f for f in shops.of("shop") if f.interval is not None]
    assert len(windows) == 18 and {f.interval for f in windows} == {0, 1, 2}
    assert "sum(sale.v[int=2])" in {f.name for f in windows}
    long = writers.interval_long(feature_matrix(shops, "shop", windows), "shop_id", windows)
    assert long.count() == 9
    newest = long.where("shop_id = 2 and interval = 2").first().asDict()
    assert newest["sum(sale.v[int])"] == 13.0 + 15.0 + 17.0 + 19.0
    assert long.where("shop_id = 3 and interval = 0").first()["COUNT(sale[int])"] is None
    writers.write_intervals(long, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("interval=*")) == ["interval=0", "interval=1", "interval=2"]


def test_save_and_load(spark, shops, tmp_path):
    features = [f for f in shops.of("shop") if f.path]
    matrix = feature_matrix(shops, "shop", features)
    writers.save_features(matrix, features, str(tmp_path))
    loaded, catalog = writers.load_features(spark, str(tmp_path))
    assert rows(loaded, "shop_id") == rows(matrix, "shop_id")
    assert catalog.where("interval is not null").count() == 18
    assert catalog.where("name = 'COUNT(sale)'").first().path[0].function == "COUNT"
