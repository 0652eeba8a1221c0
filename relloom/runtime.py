"""Session-level helpers: the shared folder, written intermediates, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="relloom-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one machine, may fall
    back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and unlike a cached or
    checkpointed frame still allows column pruning and filter pushdown.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this library where the driver found it."""
    places = df.sparkSession.sparkContext.environment
    known = [p for p in places.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        places["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return df.mapInArrow(function, schema)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame (file sizes, never below for filters)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes (negative means never)."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
    number = text.rstrip("bkmg")
    return int(number) << units[text[len(number):] or "b"]


def fits_broadcast(df: DataFrame) -> bool:
    """True when Catalyst itself will broadcast ``df`` in an equi-join."""
    return plan_bytes(df) <= broadcast_limit(df.sparkSession)


def local_session(app: str = "relloom", cpus: str | int = "*") -> SparkSession:
    """Session used by the bench and the tests.

    The JVM does not compile methods above 8000 bytes; beyond that size, as with
    hundreds of aggregates, Spark's plain code is faster than one generated method.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
