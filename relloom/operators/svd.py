"""Truncated singular value decomposition of vector columns, uncentred.

A randomised range finder: a block of ``k + oversample`` random directions is multiplied by
X'X, one pass over the rows for each product, until the leading directions of everything
multiplied so far no longer move. Tasks multiply their rows, dense or sparse, and give back
only the columns their rows touch; these are added up by column on the executors. The driver
holds a few blocks of ``width x (k + oversample)`` numbers and never one of width x width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Products a task holds at a time: entries of rows times width of the block.
STEP_NUMBERS = 4_000_000
# Blocks kept before the leading directions replace them.
BLOCKS = 4


@dataclass(frozen=True)
class Rows:
    """Entries of a batch of vectors: where rows begin, the column and value of each."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def times(self, block: np.ndarray) -> np.ndarray:
        """The batch times a block; a row without entries gives zeros."""
        sums = np.zeros((len(self.starts) - 1, block.shape[1]))
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            products = self.values[:, None] * block[self.columns]
            sums[filled] = np.add.reduceat(products, self.starts[filled], axis=0)
        return sums

    def transposed_times(self, images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns with entries, and their part of the transposed batch times ``images``."""
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[order]
        touched, first = np.unique(self.columns[order], return_index=True)
        return touched, np.add.reduceat(self.values[order, None] * images[row], first, axis=0)


def entries(vectors: pa.Array) -> Rows:
    """Entries of ML vectors as Arrow gives them; a null vector has none."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    kind, columns, values = pc.struct_field(vectors, [0]), pc.struct_field(vectors, [2]), pc.struct_field(vectors, [3])
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = values.flatten().to_numpy(zero_copy_only=False)
    # the entries of a dense vector (kind 1) stand in the order of the columns
    places = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
    sparse = np.repeat(pc.fill_null(pc.equal(kind, 0), False).to_numpy(zero_copy_only=False), sizes)
    if sparse.any():
        places[sparse] = columns.flatten().to_numpy(zero_copy_only=False)
    return Rows(starts, places, flat)


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Rows]:
    """Entries of as many rows as fit a step."""
    for batch in batches:
        rows = entries(batch["x"])
        start = 0
        while start < batch.num_rows:
            most = rows.starts[start] + max(STEP_NUMBERS // width, 1)
            stop = max(start + 1, int(np.searchsorted(rows.starts, most, side="right")) - 1)
            a, b = rows.starts[start], rows.starts[stop]
            yield Rows(rows.starts[start : stop + 1] - a, rows.columns[a:b], rows.values[a:b])
            start = stop


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """``X'X`` times a block in one pass over ``x``, the rows' vectors."""
    width, l = block.shape
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(block)
    names = [f"c{j}" for j in range(l)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((width, l)), np.zeros(width, bool)
        for part in _steps(batches, l):
            if len(part.values):
                columns, sums = part.transposed_times(part.times(shared.value))
                total[columns] += sums
                touched[columns] = True
        places = np.flatnonzero(touched)
        for start in range(0, len(places), 4096):
            some = places[start : start + 4096]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), *[pa.array(total[some, j]) for j in range(l)]], names=["place", *names]
            )

    made = rows.mapInArrow(products, ", ".join(["place int", *[f"{n} double" for n in names]]))
    sums = made.groupBy("place").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((width, l))
    for r in sums.toLocalIterator():
        out[r[0]] = r[1:]
    shared.destroy()
    return out


def _orthonormal(block: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of what a block adds to a known one."""
    scale = np.linalg.norm(block, axis=0).max(initial=0.0)
    if known is not None:
        for _ in range(2):  # twice is enough
            block = block - known @ (known.T @ block)
    q, r = np.linalg.qr(block)
    return q[:, np.abs(np.diag(r)) > 1e-12 * scale] if scale else q[:, :0]


def leading_directions(rows: DataFrame, width: int, k: int, oversample: int = 10, tolerance: float = 1e-8,
                       passes: int = 60, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest singular values and their right singular vectors, a column each.

    Directions are settled when the residual of ``X'X v = s² v`` is below ``tolerance`` of
    the largest s², or when the blocks span all columns.
    """
    l = min(width, k + oversample)
    if width <= BLOCKS * l:
        l = width  # the blocks would span all columns: one pass does
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((width, l)))
    images = gram_times(rows, basis)
    for _ in range(passes - 1):
        small = basis.T @ images
        values, mix = np.linalg.eigh((small + small.T) / 2)
        mix = mix[:, ::-1][:, :l]
        values, leading, image = values[::-1][:l], basis @ mix, images @ mix
        residual = image - leading * values
        off = np.linalg.norm(residual[:, :k], axis=0)
        if basis.shape[1] >= width or (off <= tolerance * max(values[0], 0.0)).all():
            break
        if basis.shape[1] + l > BLOCKS * l:
            basis, images = leading, image
        following = _orthonormal(residual, basis)
        following = following[:, : width - basis.shape[1]]
        if not following.shape[1]:
            break
        basis = np.column_stack([basis, following])
        images = np.column_stack([images, gram_times(rows, following)])
    signs = np.sign(leading[np.abs(leading).argmax(0), np.arange(leading.shape[1])])
    return np.sqrt(np.maximum(values[:k], 0.0)), (leading * np.where(signs == 0, 1, signs))[:, :k]


@dataclass
class TruncatedSVD:
    """Projects vectors on right singular vectors; ``transform`` adds the output column."""

    column: str
    output: str
    singular_values: np.ndarray
    components: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        components = self.components
        step = max(STEP_NUMBERS // max(components.shape[1], 1), 1)

        def project(vectors: pa.Array) -> pa.Array:
            rows = entries(vectors)
            out, start = [], 0
            while start < len(vectors):
                stop = max(start + 1, int(np.searchsorted(rows.starts, rows.starts[start] + step, side="right")) - 1)
                a, b = rows.starts[start], rows.starts[stop]
                out.append(Rows(rows.starts[start : stop + 1] - a, rows.columns[a:b], rows.values[a:b]).times(components))
                start = stop
            made = np.concatenate(out) if out else np.zeros((0, components.shape[1]))
            ends = np.arange(len(made) + 1, dtype=np.int32) * components.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()))

        # plain annotations are needed at run time, so the function is typed here
        project.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
        udf = F.arrow_udf(project, "array<double>")
        return df.withColumn(self.output, array_to_vector(udf(F.unwrap_udt(F.col(self.column)))))


def truncated_svd(df: DataFrame, column: str, output: str, k: int, oversample: int = 10, seed: int = 0) -> TruncatedSVD:
    """Model projecting vectors on their first ``k`` right singular vectors, uncentred.

    Fewer come back if the rows have fewer columns. Null vectors count as zeros.
    """
    rows = df.select(F.col(column).alias("x"))
    shape = rows.select(F.unwrap_udt("x").alias("u")).select(
        F.max(F.coalesce(F.col("u.size"), F.size("u.values"))).alias("width")
    )
    width = shape.first()["width"] or 0
    if not width:
        return TruncatedSVD(column, output, np.zeros(0), np.zeros((0, 0)))
    values, components = leading_directions(rows, width, min(k, width), oversample, seed=seed)
    return TruncatedSVD(column, output, values, components)
