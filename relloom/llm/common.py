"""What the operators share: the given tables, the shared folder, Arrow batches of texts.

An operator takes the names of the columns it reads, selects only those, and ignores any
further columns, so extra columns with clashing names cannot disturb it.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Text that one step inside a task handles at a time; a single longer text is one step.
STEP_BYTES = 4 << 20
#: Spark's setting of what an Arrow batch may hold; unset, 10,000 rows of whole texts are one batch.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _returning(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``function``, after which the reused worker gives unused memory back to the system."""

    def run(batches: Batches) -> Batches:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def map_batches(df: DataFrame, function: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this library where the driver found it and keep no unused memory.

    Unless the session says otherwise, a batch holds about as much text as a step: executor
    and worker each hold whole batches.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(STEP_BYTES))
    places = df.sparkSession.sparkContext.environment
    known = [p for p in places.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        places["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return df.mapInArrow(_returning(function), schema)


def settle(df: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """Write ``df`` once in the shared folder of ``spark.checkpoint.dir`` and read it back.

    The lineage ends there; lost executors cost only the tasks they ran. Without the
    setting (tests) the session's own warehouse folder is used. Steps stay on disk for the
    session, so they are packed more densely than Spark does by itself. With a ``key`` the
    step is a table bucketed by it, which a join by that column need not shuffle.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/steps"
    number = uuid.uuid4().hex
    path = f"{folder.rstrip('/')}/{label}-{number}"
    writer = df.write.option("compression", "zstd")
    if key:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer.format("parquet").option("path", path).bucketBy(parts, key).saveAsTable(f"{label}_{number}")
        return spark.table(f"{label}_{number}")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, or a single row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one array, and where each text's begin."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = parts.flatten()
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return words.filter(real), np.concatenate([[0], kept[ends]])


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's index in the list of distinct words, and that list."""
    if not len(words):
        return np.zeros(0, np.int64), []
    made = words.dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary.to_pylist()


def taken(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def text_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that are read, under fixed names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
