"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, whose counts and sums are exact, so rows are centred without
loss. Centred rows X are never gathered: a step of the bidiagonalisation is one pass over
the table in which every task multiplies its rows by the current direction (X v), takes
inner products with the left vectors found before, and multiplies back (X' u); only sums of
``width`` numbers reach the driver. A left vector is a combination of columns, u = X p, so it
is kept as the short vector p and made again from the rows where it is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.llm.common import Batches, map_batches, settle

#: x = floor(SCALE * c) + SHIFT (fixed values).
SCALE, SHIFT = 1024.0, 100_000
#: Entries up to this size, on either side, become whole numbers.
LARGEST = float(1 << 40)
#: Singular values below this share of the largest are zero.
ZERO = 1e-10
#: A component is found when its residual is below this share of the largest singular value.
FOUND = 1e-13
#: Steps that must confirm the components after a start in a new direction.
CONFIRM = 4
#: Bytes of rows a written file holds; a task reads several.
FILE_BYTES = 4 << 20
#: Rows a task multiplies at a time.
ROWS = 4096


class Components(NamedTuple):
    """Eigenvectors of the covariance (a column each), eigenvalues, its trace, passes taken."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


class Centre(NamedTuple):
    """How many rows there are, and their mean per dimension as a whole part and n-ths."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """Centred rows: the difference of whole numbers is exact, only the n-ths round."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact ``sum((n * x - S) ** 2)`` per row; null where it exceeds a long."""
        y = x - self.whole
        most = int(np.abs(y).max(initial=0))
        if most * max(most, self.n) * max(y.shape[1], 1) >= 1 << 62:
            y = y.astype(object)
        squares, crossed, rest = (y * y).sum(1), (y * self.rest).sum(1), sum(int(r) ** 2 for r in self.rest)
        out = [self.n**2 * int(a) - 2 * self.n * int(b) + rest for a, b in zip(squares, crossed, strict=True)]
        return [v if v < 1 << 63 else None for v in out]


def _usable(vector: Column) -> Column:
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(SCALE)) <= F.lit(LARGEST))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, good)


def whole_rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the rows that remain, as whole numbers, written once.

    Dropped are rows whose vector is null, empty, or holds a null, a non-finite entry or one
    beyond ±2^30, and rows whose width is not the most frequent one (the larger of two).
    """
    vector = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    read = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector")).where(_usable(F.col("vector")))
    whole = F.transform("vector", lambda c: F.floor(c * F.lit(SCALE)).cast("long") + F.lit(SHIFT))
    rows = settle(read.select("vec_id", whole.alias("x")), "whole")
    # one row per width
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).take(2)
    if not widths:
        return rows
    parts = -(-sum(r["count"] for r in widths) * widths[0]["width"] * 8 // FILE_BYTES)
    if len(widths) > 1:
        rows = rows.where(F.size("x") == widths[0]["width"])
    if parts >= rows.rdd.getNumPartitions():
        return rows
    # many small files would cost a task each in every pass
    return settle(rows.repartition(int(parts)), "rows")


def _blocks(batches: Batches):
    """Identifiers and rows, at most ``ROWS`` at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            lists = part["x"]
            yield part["vec_id"], lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _summed(rows: DataFrame, function: Callable[[Batches], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all tasks of a short vector that each makes from its rows."""

    def sums(batches: Batches) -> Batches:
        made = function(batches)
        if made is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(made), dtype=np.int32)), pa.array(made.astype(np.float64))], names=["place", "part"]
            )

    got = map_batches(rows, sums, "place int, part double").groupBy("place").agg(F.sum("part").alias("total")).collect()
    if not got:
        return None
    out = np.zeros(len(got))
    for r in got:
        out[r["place"]] = r["total"]
    return out


def centre(rows: DataFrame) -> Centre | None:
    """Count and exact sums, in halves of 32 bits that cannot overflow; none without rows."""

    def sums(batches: Batches) -> Batches:
        n, total = 0, None
        for _, x in _blocks(batches):
            n += len(x)
            total = x.sum(0).astype(object) if total is None else total + x.sum(0)
        if n:
            total = [n, *map(int, total)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(total), dtype=np.int32)), pa.array([t >> 32 for t in total], pa.int64()),
                    pa.array([t & 0xFFFFFFFF for t in total], pa.int64()),
                ],
                names=["place", "high", "low"],
            )

    made = map_batches(rows, sums, "place int, high long, low long")
    got = made.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    if not got:
        return None
    n, *totals = [(r["high"] << 32) + r["low"] for r in sorted(got, key=lambda r: r["place"])]
    parted = [divmod(t, n) for t in totals]
    return Centre(n, np.array([q for q, _ in parted], np.int64), np.array([r for _, r in parted], np.int64))


def _squares(rows: DataFrame, mean: Centre) -> float:
    """Sum of the squares of all centred entries."""

    def made(batches: Batches) -> np.ndarray | None:
        sums = [np.square(mean.of(x)).sum() for _, x in _blocks(batches)]
        return np.array([sum(sums)]) if sums else None

    return float(_summed(rows, made)[0])


def _product(rows: DataFrame, mean: Centre, left: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """One pass with ``y = X p``: ``U' y`` for ``U = X left``, ``y' y`` and ``X' y``."""
    both = np.column_stack([left, p])

    def made(batches: Batches) -> np.ndarray | None:
        total = None
        for _, x in _blocks(batches):
            centred = mean.of(x)
            images = centred @ both
            y = images[:, -1]
            part = np.concatenate([images.T @ y, centred.T @ y])
            total = part if total is None else total + part
        return total

    got = _summed(rows, made)
    k = left.shape[1]
    return got[:k], float(got[k]), got[k + 1 :]


class Bidiagonal:
    """Lanczos vectors on both sides, fully reorthogonalised, and the bidiagonal between them."""

    def __init__(self, width: int, seed: int = 0):
        self.draw = np.random.default_rng(seed)
        self.width = width
        self.right: list[np.ndarray] = []  # v
        self.left: list[np.ndarray] = []  # p, where u = X p
        self.back: list[np.ndarray] = []  # X' u
        self.alphas: list[float] = []
        self.betas: list[float] = []
        self.next = self._fresh()

    def _orthogonal(self, w: np.ndarray) -> np.ndarray:
        for _ in range(2):  # twice is enough
            for v in self.right:
                w = w - (v @ w) * v
        return w

    def _fresh(self) -> np.ndarray | None:
        """A new direction orthogonal to all before; none if they span everything."""
        if len(self.right) >= self.width:
            return None
        w = self._orthogonal(self.draw.standard_normal(self.width))
        return w / np.linalg.norm(w)

    def restart(self) -> None:
        """Go on from a new direction, uncoupled from those before."""
        if self.betas:
            self.betas[-1] = 0.0
        self.next = self._fresh()

    def step(self, product, scale: float) -> None:
        """``scale`` is the Frobenius norm of X, by which zero is told."""
        v = self.next
        coupled = bool(self.betas) and self.betas[-1] > 0
        p = v - self.betas[-1] * self.left[-1] if coupled else v
        known = np.array(self.left).T.reshape(self.width, -1)
        inner, square, image = product(known, p)
        for k, h in enumerate(inner):
            p, image, square = p - h * self.left[k], image - h * self.back[k], square - h * h
        alpha = float(np.sqrt(max(square, 0.0)))
        self.right.append(v)
        if alpha <= ZERO * scale:
            alpha, p, image = 0.0, np.zeros(self.width), np.zeros(self.width)
        else:
            p, image = p / alpha, image / alpha
        self.left.append(p)
        self.back.append(image)
        self.alphas.append(alpha)
        w = self._orthogonal(image - alpha * v) if alpha else np.zeros(self.width)
        beta = float(np.linalg.norm(w))
        if beta <= 1e-13 * scale:
            self.betas.append(0.0)
            self.next = self._fresh()
        else:
            self.betas.append(beta)
            self.next = w / beta if len(self.right) < self.width else None

    def components(self, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right singular vectors, and how far each is from exact."""
        small = np.diag(self.alphas) + np.diag(self.betas[:-1], 1)
        q, s, r = np.linalg.svd(small)
        k = min(wanted, len(s))
        off = self.betas[-1] * np.abs(q[-1, :k])
        return s[:k], np.array(self.right).T @ r[:k].T, off


def principal(rows: DataFrame, mean: Centre, wanted: int = 8, seed: int = 0) -> Components:
    """The first ``wanted`` eigenvectors of the covariance of the rows.

    Steps go on until the residuals of all are at rounding level, and then from a new random
    direction until ``CONFIRM`` more steps change none, as a Krylov space alone holds one
    vector of a repeated eigenvalue. At most ``width`` steps; components whose deviation is
    zero are left out.
    """
    width = len(mean.whole)
    total = _squares(rows, mean)
    scale = total**0.5
    if not scale:
        return Components(np.zeros((width, 0)), np.zeros(0), 0.0, 0)
    made = Bidiagonal(width, seed)
    confirmed, before = None, None
    while made.next is not None:
        made.step(lambda left, p: _product(rows, mean, left, p), scale)
        s, _, off = made.components(wanted)
        if len(s) < wanted or (off > FOUND * s[0]).any():
            confirmed = None
            continue
        same = before is not None and np.allclose(s, before, rtol=1e-12, atol=0)
        if confirmed is not None and not same:
            confirmed = None
        if confirmed is None:
            confirmed, before = 0, s
            made.restart()
        else:
            confirmed += 1
            if confirmed >= CONFIRM:
                break
    s, vectors, _ = made.components(wanted)
    kept = s > ZERO * scale
    vectors = np.linalg.qr(vectors[:, kept])[0] if kept.any() else vectors[:, kept]
    return Components(vectors, s[kept] ** 2 / mean.n, total / mean.n, len(made.alphas))


def _whitened(mean: Centre, found: Components, x: np.ndarray) -> np.ndarray:
    return mean.of(x) @ found.vectors / np.sqrt(found.values)


def _identity_error(rows: DataFrame, mean: Centre, found: Components) -> float:
    """Largest absolute entry of the covariance of whitened rows minus the identity."""
    k = len(found.values)

    def made(batches: Batches) -> np.ndarray | None:
        total = None
        for _, x in _blocks(batches):
            w = _whitened(mean, found, x)
            part = np.concatenate([w.sum(0), (w.T @ w).ravel()])
            total = part if total is None else total + part
        return total

    got = _summed(rows, made) / mean.n
    covariance = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
    return float(np.abs(covariance - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8,
           seed: int = 0) -> DataFrame:
    """A row per remaining vector and component, numbered from 1 by falling eigenvalue.

    ``whitened`` is the centred row's coordinate over the component's deviation. Which rows
    remain says :func:`whole_rows`; each remaining row counts on its own, whether repeated or
    without identifier. Fewer components come back if the rows vary in fewer dimensions, and
    no rows at all if none remains or all are equal. ``deviation`` is exact, null beyond a
    long. Further columns are not read.
    """
    rows = whole_rows(df, id_col, vector_col)
    mean = centre(rows)
    found = principal(rows, mean, components, seed) if mean else None
    if found is None or not len(found.values):
        return df.sparkSession.createDataFrame([], SCHEMA)
    error = _identity_error(rows, mean, found)
    k = len(found.values)
    explained = found.values / found.trace

    def made(batches: Batches) -> Batches:
        for ids, x in _blocks(batches):
            w = _whitened(mean, found, x)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(ids, each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, mean.n, np.int64)), pc.take(pa.array(mean.deviation(x), pa.int64()), each),
                    pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(rows, made, SCHEMA)
