"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

Every paragraph is hashed to a wide vector, and the fingerprint is the sum of the vectors
modulo powers of two, lane by lane. Sums do not depend on order, and a paragraph is added
or taken away by adding or subtracting its vector. The vector has

* one counter and four dense lanes of 32 bits: equality of multisets;
* ``LEVELS`` rows of ``LANES`` lanes of 16 bits. A paragraph falls into level ``k`` with
  chance 1 / 2 ** (k + 1) (the last level takes the rest) and adds to one lane there. The
  lanes in which two sums differ tell how many paragraphs only one of them has, from the
  least populated levels that are not yet full, whatever the size of the texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relloom.llm.common import Batches, map_batches, settle, steps, text_columns

DENSE = 5
LEVELS, LANES = 8, 32
#: A level says how many paragraphs differ while at most this share of its lanes is hit.
FULL = 0.7
#: A paragraph ends at a line end or after a sentence end.
PARAGRAPH = re.compile(r"[^\n.!?…]+[.!?…]*|[.!?…]+")


def paragraphs(text: str) -> list[str]:
    """Trimmed paragraphs with something in them; a blank text has none."""
    return [p for x in PARAGRAPH.findall(text) if (p := x.strip())]


class Fingerprint:
    """Sums of paragraph vectors; ``+`` and ``-`` combine the multisets behind them."""

    __slots__ = ("dense", "wide")

    def __init__(self, dense: np.ndarray | None = None, wide: np.ndarray | None = None):
        self.dense = np.zeros(DENSE, np.uint32) if dense is None else dense
        self.wide = np.zeros(LEVELS * LANES, np.uint16) if wide is None else wide

    @classmethod
    def of(cls, parts: list[str]) -> Fingerprint:
        made = cls()
        if parts:
            raw = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=24).digest() for p in parts)
            h = np.frombuffer(raw, "<u4").reshape(-1, 6)
            made.dense[0] = len(parts)
            made.dense[1:] = h[:, :4].sum(0, dtype=np.uint64).astype(np.uint32)
            # the lowest set bit of a hash gives the level
            low = h[:, 4] & (~h[:, 4] + np.uint32(1))
            level = np.minimum(np.log2(np.maximum(low, 1)).astype(np.int64), LEVELS - 1)
            level[low == 0] = LEVELS - 1
            lane = level * LANES + (h[:, 5] & np.uint32(LANES - 1)).astype(np.int64)
            value = (h[:, 5] >> np.uint32(16)) | np.uint32(1)
            sums = np.bincount(lane, value.astype(np.float64), LEVELS * LANES)
            made.wide[:] = (sums % 65536).astype(np.uint16)
        return made

    @classmethod
    def of_text(cls, text: str | None) -> Fingerprint:
        return cls.of(paragraphs(text or ""))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense + other.dense, self.wide + other.wide)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense - other.dense, self.wide - other.wide)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.hex() == other.hex()

    def __hash__(self) -> int:
        return hash(self.hex())

    def hex(self) -> str:
        return (self.dense.astype("<u4").tobytes() + self.wide.astype("<u2").tobytes()).hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[: 4 * DENSE], "<u4").copy(), np.frombuffer(raw[4 * DENSE :], "<u2").copy())


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Estimated Jaccard similarity of two multisets of paragraphs, from 0 to 1.

    Levels are added while they are not full; the paragraphs they show are scaled by the
    share of paragraphs that fall into them. Equal fingerprints have likeness 1, two empty
    ones included; an empty and another have 0.
    """
    if np.array_equal(a.dense, b.dense) and np.array_equal(a.wide, b.wide):
        return 1.0
    total = float(a.dense[0]) + float(b.dense[0])
    if not a.dense[0] or not b.dense[0]:
        return 0.0
    hit = ((a.wide - b.wide) != 0).reshape(LEVELS, LANES).sum(1)
    first = LEVELS - 1
    while first and hit[first - 1] <= FULL * LANES:
        first -= 1
    share = 2.0**-first  # of all paragraphs: levels first, first + 1, ... and the rest
    free = np.maximum(LANES - hit[first:], 0.5) / LANES
    differ = float((-LANES * np.log(free)).sum()) / share
    return max(0.0, min(1.0, (total - differ) / (total + differ)))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Batches) -> Batches:
    """Rows sorted by group, then with ``ahead`` last; each is compared with its successor."""
    last = None
    for batch in batches:
        for part in steps(batch):
            rows = []
            for group, ahead, doc_id, text in zip(*(part[k].to_pylist() for k in range(4)), strict=True):
                text = text or ""
                mark = Fingerprint.of_text(text)
                if last and last[0] == group:
                    rows.append(_row(*last[1:], text, mark))
                last = None if ahead else (group, doc_id, text, mark)
            if rows:
                yield _made(rows)
    if last:
        raise ValueError("a last document has no successor")


def _row(doc_id, text, mark, following, next_mark):
    changed = edited(text, following)
    other = Fingerprint.of_text(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark.hex(),
        other.hex(), likeness(mark, other), likeness(mark, next_mark),
    )


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES
    )


def _fingerprints(batches: Batches) -> Batches:
    for batch in batches:
        for part in steps(batch):
            marks = [Fingerprint.of_text(t).hex() for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(marks, pa.string())], names=NAMES[:1] + NAMES[3:4])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row, without a shuffle; null texts are empty."""
    return map_batches(text_columns(docs, id_col, text_col), _fingerprints, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and likenesses.

    The next document follows in ascending doc_id (nulls first), texts breaking ties; the
    last one is followed by the first, so a single document follows itself. A null text is
    empty. Documents are dealt by ranges of identifiers, and the first rows of each range
    also go to the range before it, so texts move once and no row waits for the whole.
    """
    read = text_columns(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    spark = read.sparkSession
    wanted = max(read.rdd.getNumPartitions() * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / wanted for k in range(1, wanted)]
    bounds = sorted(set(read.select("doc_id").approxQuantile("doc_id", shares, 1 / (4 * wanted)))) if shares else []
    # bounds split the range of identifiers: as many as there are partitions
    group = F.coalesce(
        F.array_size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("doc_id"))), F.lit(0)
    ) if bounds else F.lit(0)
    read = read.withColumn("group", group)
    present = settle(
        read.groupBy("group").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("has_null")), "ranges"
    )
    order = Window.orderBy("group")
    # a row per range
    ends = present.select(
        F.when(F.col("has_null"), F.lit(None)).otherwise(F.col("first")).alias("first"),
        F.coalesce(F.lag("group").over(order), F.max("group").over(Window.partitionBy())).alias("before"),
    )
    ahead = read.join(F.broadcast(ends), read["doc_id"].eqNullSafe(ends["first"])).select(
        F.col("before").alias("group"), F.lit(True).alias("ahead"), "doc_id", "text"
    )
    rows = read.select("group", F.lit(False).alias("ahead"), "doc_id", "text").unionByName(ahead)
    dealt = rows.repartition(wanted, "group").sortWithinPartitions("group", "ahead", "doc_id", "text")
    return map_batches(dealt.select("group", "ahead", "doc_id", "text"), _compare, SCHEMA)
