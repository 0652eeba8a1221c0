"""Entity sets over the given tables. Parquet carries no keys, so they are declared."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import SparkSession

from relloom.entityset import EntitySet
from relloom.workload.registry import table

KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": None,
    "events": "event_id",
    "documents": "doc_id",
    "labels": "doc_id",
}
EDGES = [
    ("nation", "n_regionkey", "region"),
    ("customer", "c_nationkey", "nation"),
    ("supplier", "s_nationkey", "nation"),
    ("orders", "o_custkey", "customer"),
    ("lineitem", "l_orderkey", "orders"),
    ("lineitem", "l_partkey", "part"),
    ("lineitem", "l_suppkey", "supplier"),
    ("events", "user_id", "customer"),
    ("labels", "doc_id", "documents"),
]
TEXT = {"documents": ["text"]}


def entity_set(
    spark: SparkSession, sf_dir: str, names: Iterable[str], config: Mapping[str, Any] | None = None
) -> EntitySet:
    """The named tables with every declared edge between them."""
    es = EntitySet(config)
    names = list(names)
    for name in names:
        es.add_entity(name, table(spark, sf_dir, name), KEYS[name], TEXT.get(name, ()))
    for child, column, parent in EDGES:
        if child in names and parent in names:
            es.add_relationship(child, column, parent)
    return es


def metadata(**columns: dict[str, bool]) -> dict[str, Any]:
    return {"feature_metadata": columns}


CATEGORY = {"numeric": False, "categorical": True}
FILTER = {**CATEGORY, "categorical_filter": True}
