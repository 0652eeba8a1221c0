"""Similarity self-join on word shingles with adaptive prefixes that must match repeatedly.

Every set of shingles is put in one global order, rare ones first. Two sets whose Jaccard
similarity reaches the threshold share at least ``k`` of the first ``n - need + k``
shingles of each, for every ``k``; ``need`` is the overlap that a set of ``n`` asks of any
partner. A document picks the ``k`` at which reading the postings of its prefix and
verifying what they yield is estimated to cost least, and a pair is verified only if it
shares the smaller of its two ``k`` in both prefixes and, in groups of few, if signatures of
fixed size do not show that too much differs.

Steps: (1) hash the sets, give equal sets one class, count shingles in a sketch of fixed
size; (2) post each class under the shingles of its prefix and keep postings that meet;
(3) count shared prefix shingles in pairs of blocks of bounded size, which only the
prefixes reach, and keep the members that some other one asks for; (4) bring whole sets to
those, verify, and return a spanning forest of links; (5) contract links into components. A class is posted once per
task however many copies it has, and no pair leaves a block unless it joins two trees.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.llm.common import Batches, coded, map_batches, settle, steps, taken, text_columns, words_of

#: Counters of the sketch of document frequencies, and how many of them form a row.
CELLS, BLOCK = 1 << 22, 1 << 16
#: Prefix shingles that one side of a pair of blocks holds, unless a single set has more.
BLOCK_SHINGLES = 100_000
#: What bringing a shingle of a set to its verification costs (6 bytes), in postings (16 bytes).
VERIFY_COST = 0.4
#: Groups of at most so many classes are looked at pair by pair, larger ones in blocks.
FEW = 8
#: The bits of a posting's size that hold the matches asked.
ASKED = (1 << 30) - 1
#: Bits of the filter of texts whose sets are needed; wrong hits are dropped by a join.
FILTER_BITS = 1 << 25
#: Bits of a set's signature, and how many sets are signed at a time.
SIGN_BITS, SIGNED = 1 << 10, 512

#: What a text with at least one word matches.
A_WORD = r"[^\x20\x09-\x0D]"

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(27))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes.

    A-Z count as a-z. Fewer words than ``width`` are one shingle; no words are none.
    """
    words, begins = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    index, distinct = coded(words)
    if not len(index):
        return [np.zeros(0, np.uint64)] * len(texts)
    hashed = pd.util.hash_array(np.array(distinct, object), categorize=False)[index]
    n = np.diff(begins)
    made = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = taken(begins[:-1], made)
    size = np.repeat(np.minimum(n, width), made)
    out = _mix(size.astype(np.uint64) * M1)
    for k in range(width):
        inside = size > k
        out = np.where(inside, _mix((out + hashed[np.where(inside, at + k, 0)]) * M1), out)
    ends = np.cumsum(made)
    return [np.unique(out[e - m : e]) for e, m in zip(ends, made, strict=True)]


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set; equal sets have equal ones."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[np.ndarray]) -> pa.Array:
    """Whether an odd number of a set's shingles falls on each of ``SIGN_BITS`` bits.

    A shingle that only one of two sets has changes one bit, so two signatures differ in at
    most as many bits as there are such shingles.
    """
    rows = []
    for k in range(0, len(sets), SIGNED):
        part = sets[k : k + SIGNED]
        at = np.repeat(np.arange(len(part)) * SIGN_BITS, [len(s) for s in part])
        at += (np.concatenate(part) >> np.uint64(64 - SIGN_BITS.bit_length() + 1)).astype(np.int64)
        rows.append(np.packbits(np.bincount(at, minlength=len(part) * SIGN_BITS) & 1))
    words = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (SIGN_BITS // 64)), pa.array(words))


def _sets(batches: Batches, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in steps(batch):
            yield part, shingle_sets(part["text"], width)


def _classes(batches: Batches, width: int) -> Batches:
    """A row per document, and this task's sketch in rows of ``BLOCK`` counters.

    ``one`` and ``two`` are digests of the text; the caller may leave out the second.
    """
    names = ["doc_id", "one", "two", "n", "node", "signature", "block", "part", "counts"]
    sketch = np.zeros(CELLS, np.int32)
    for part, sets in _sets(batches, width):
        if any(len(s) for s in sets):
            cells = np.concatenate(sets) & np.uint64(CELLS - 1)
            sketch += np.bincount(cells.astype(np.int64), minlength=CELLS).astype(np.int32)
        k = len(sets)
        yield pa.RecordBatch.from_arrays([
            part["doc_id"], part["one"], part["two"], pa.array([len(s) for s in sets], pa.int64()),
            pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), signatures(sets),
            pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
        ], names=names)
    if sketch.any():
        rows = sketch.reshape(-1, BLOCK)
        k, task = len(rows), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            *[pa.nulls(k, pa.int64()) for _ in names[:5]], pa.nulls(k, pa.list_(pa.int64())),
            pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, task, np.int32)),
            pa.array([_packed(r) for r in rows], pa.binary()),
        ], names=names)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def _sum_rows(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([_unpacked(c) for c in rows["counts"]], axis=0)
    return pd.DataFrame({"block": rows["block"][:1], "part": rows["part"][:1], "counts": [_packed(total)]})


def _gather_sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches: ``CELLS`` counters, whatever the corpus.

    Summed in rounds of 64 tasks, so that no group holds more than 64 rows.
    """
    parts = rows.agg(F.max("part")).first()[0]
    if parts is None:
        return np.zeros(CELLS, np.int64)
    while parts > 0:
        parts //= 64
        rows = rows.withColumn("part", F.floor(F.col("part") / 64).cast("int")).groupBy("block", "part").applyInPandas(
            _sum_rows, "block int, part int, counts binary"
        )
    out = np.zeros(CELLS, np.int64)
    for r in rows.collect():
        out.reshape(-1, BLOCK)[r["block"]] += _unpacked(r["counts"])
    return out


def ordered(tokens: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in global order, rare first, and the counts that order it."""
    counts = sketch[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((tokens, counts))
    return tokens[order], counts[order]


def matches_asked(counts: np.ndarray, need: int, noise: float) -> int:
    """The number of shared prefix shingles at which a set costs least to join.

    ``counts`` are in global order; what other shingles add to each counter is ``noise``.
    With ``k`` matches asked, the postings read are those of ``n - need + k`` shingles, and
    at most a ``k``-th of the other sets in them can match ``k`` times.
    """
    df = np.maximum(counts - noise, 1.0)
    read = np.cumsum(df)[len(counts) - need :]
    others = np.cumsum(df - 1)[len(counts) - need :]
    return 1 + int(np.argmin(read + VERIFY_COST * len(counts) * others / np.arange(1, need + 1)))


def _need(n: int, threshold: Fraction) -> int:
    return -(-n * threshold.numerator // threshold.denominator)


def _prefix(tokens: np.ndarray, sketch: np.ndarray, noise: float, threshold: Fraction):
    """The whole set in order, the matches it asks, and the length of its prefix."""
    tokens, counts = ordered(tokens, sketch)
    need = _need(len(tokens), threshold)
    asked = matches_asked(counts, need, noise)
    return tokens, asked, len(tokens) - need + asked


def _post(batches: Batches, width: int, threshold: Fraction, shared, noise: float) -> Batches:
    """A row per prefix shingle of each class; ``size`` holds n and the matches asked."""
    sketch, seen = shared.value, set()
    for _, sets in _sets(batches, width):
        tokens, nodes, packed, lengths = [], [], [], []
        for s in sets:
            if len(s) and (node := class_of(s)) not in seen:
                seen.add(node)
                inside, asked, length = _prefix(s, sketch, noise, threshold)
                tokens.append(inside[:length])
                nodes.append(node)
                packed.append(len(s) << 30 | asked)
                lengths.append(length)
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths)),
                    pa.array(np.repeat(np.array(packed, np.int64), lengths)),
                ],
                names=["token", "node", "size"],
            )


def _meeting(batches: Batches) -> Batches:
    """Of rows sorted by token and node, those whose token has several nodes, each once."""
    held: tuple[np.ndarray, bool] | None = None  # the last row, and whether it met another
    for batch in batches:
        rows = np.stack([batch[k].to_numpy() for k in range(3)], 1)
        if not len(rows):
            continue
        if held:
            rows = np.concatenate([held[0], rows])
        met = bool(held and held[1])
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
        same = rows[1:, 0] == rows[:-1, 0]
        several = np.concatenate([[met], same]) | np.concatenate([same, [False]])
        held = (rows[-1:].copy(), bool(several[-1]))
        several[-1] = False
        yield _posted(rows[several])
    if held and held[1]:
        yield _posted(held[0])


def _posted(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], names=["token", "node", "size"])


def _short(tokens: np.ndarray) -> bytes:
    """48 bits of each hash: among the shingles of two sets equal ones are the same ones."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _dense(tokens: np.ndarray) -> bytes:
    """The 48 bits of each hash, in ascending order: the high ones in unary, the low ones as they are."""
    values = np.sort(tokens & np.uint64((1 << 48) - 1))
    count, high = len(values), len(values).bit_length() - 1
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:], axis=1)[:, high:]
    unary = np.zeros(count + (1 << high), np.uint8)
    unary[(values >> np.uint64(48 - high)).astype(np.int64) + np.arange(count)] = 1
    return np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def _undense(data: bytes, count: int) -> np.ndarray:
    high = count.bit_length() - 1
    low, size = 48 - high, (count * (48 - high) + 7) // 8
    bits = np.zeros((count, 64), np.uint8)
    bits[:, 16 + high :] = np.unpackbits(np.frombuffer(data, np.uint8, size), count=count * low).reshape(count, low)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=size)))
    above = (ones - np.arange(count)).astype(np.uint64) << np.uint64(low)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64) | above


def _sent(tokens: np.ndarray, length: int) -> bytes:
    """A whole set: its prefix in global order, the rest in as few bits as its ascending order needs."""
    return _short(tokens[:length]) + (_dense(tokens[length:]) if length < len(tokens) else b"")


def _received(data: bytes, n: int, length: int) -> np.ndarray:
    """The prefix, and the rest if it was sent."""
    prefix = _long(data[: 6 * length])
    return np.concatenate([prefix, _undense(data[6 * length :], n - length)]) if len(data) > 6 * length else prefix


def _wanted(batches: Batches, wanted: np.ndarray) -> Batches:
    """Rows whose digest ``one`` is (or may be) among the wanted ones."""
    for batch in batches:
        place = batch["one"].to_numpy() & (FILTER_BITS - 1)
        yield batch.filter(pa.array(wanted[place >> 3] >> (place & 7) & 1 == 1))


def _needed(batches: Batches, width: int, threshold: Fraction, shared, noise: float, wanted, whole: bool) -> Batches:
    """Sets of classes with a wanted row (and maybe others): prefixes in global order, or ``whole``."""
    sketch, seen = shared.value, set()
    for _, sets in _sets(_wanted(batches, np.frombuffer(wanted.value, np.uint8)), width):
        rows = []
        for s in sets:
            if len(s) and (node := class_of(s)) not in seen:
                seen.add(node)
                inside, asked, length = _prefix(s, sketch, noise, threshold)
                rows.append((node, len(s), asked, length, _sent(inside, length) if whole else _short(inside[:length])))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["node", "n", "asked", "length", "tokens"],
            )


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``a`` shares with each of ``b``; values are distinct."""
    if len(a) * len(b) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    values, of = np.unique(np.concatenate(a + b), return_inverse=True)
    na = np.array([len(x) for x in a])
    rows = np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), [len(x) for x in b])])
    left = np.zeros(len(of), bool)
    left[: na.sum()] = True
    shared = np.zeros(len(values), bool)
    shared[of[left]] = True
    both = np.zeros(len(values), bool)
    both[of[~left]] = True
    column = np.cumsum(shared & both) - 1
    kept = (shared & both)[of]
    rows, of, left = rows[kept], column[of[kept]], left[kept]
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(of, kind="stable")
    rows, of, left = rows[order], of[order], left[order]
    total = int(of[-1]) + 1 if len(of) else 0
    wide = max(256, (1 << 22) // (len(a) + len(b)))
    for c in range(0, total, wide):
        lo, hi = np.searchsorted(of, [c, c + wide])
        r, o, l = rows[lo:hi], of[lo:hi] - c, left[lo:hi]
        x, y = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
        x[r[l], o[l]] = 1
        y[r[~l], o[~l]] = 1
        out += x @ y.T
    return out.astype(np.int64)


#: class, n, matches asked, prefix length, prefix in global order (and the rest of the set), groups it is in
Member = tuple[int, int, int, int, np.ndarray, np.ndarray]


def matching(a: list[Member], b: list[Member] | None, threshold: Fraction) -> np.ndarray:
    """Which members of ``a`` and ``b`` (or of ``a`` itself) must be verified against each other."""
    other = a if b is None else b
    n, m = np.array([x[1] for x in a])[:, None], np.array([x[1] for x in other])[None]
    fits = np.minimum(n, m) * threshold.denominator >= threshold.numerator * np.maximum(n, m)
    if b is None:
        fits &= np.tri(len(a), k=-1, dtype=bool)
    if fits.any():
        asked = np.minimum(np.array([x[2] for x in a])[:, None], np.array([x[2] for x in other])[None])
        fits &= _overlaps([x[4][: x[3]] for x in a], [x[4][: x[3]] for x in other]) >= asked
    return fits


def links_of(a: list[Member], b: list[Member] | None, threshold: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``a``, or between ``a`` and ``b``."""
    other = a if b is None else b
    fits = matching(a, b, threshold)
    rows, columns = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
    if not len(rows):
        return []
    n, m = np.array([a[k][1] for k in rows])[:, None], np.array([other[k][1] for k in columns])[None]
    inter = _overlaps([a[k][4] for k in rows], [other[k][4] for k in columns])
    linked = fits[np.ix_(rows, columns)] & (
        inter * threshold.denominator >= threshold.numerator * (n + m - inter)
    )
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = a[rows[i]][0], other[columns[j]][0]
        p, q = root(x), root(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _groups(batches: Batches) -> Iterator[tuple[tuple[int, int, int], list[Member], list[Member]]]:
    """Pairs of blocks from rows that come sorted by token, pair of blocks and block."""
    group, members = None, ([], [])
    for batch in batches:
        for token, low, high, block, *member, tokens, lists in zip(*(batch[k].to_pylist() for k in range(10)), strict=True):
            if (token, low, high) != group:
                if group:
                    yield group, *members
                group, members = (token, low, high), ([], [])
            members[block != low].append((*member, _received(tokens, member[1], member[3]), np.array(lists or [], np.int64)))
    if group:
        yield group, *members


def _pairs(batches: Batches) -> Iterator[tuple[tuple[int, int, int], list[Member], list[Member] | None]]:
    """Those groups that hold a pair; ``None`` for the second block if it is the first."""
    for group, first, second in _groups(batches):
        if group[1] == group[2]:
            if len(first) > 1:
                yield group, first, None
        elif first and second:
            yield group, first, second


def _candidates(batches: Batches, threshold: Fraction) -> Batches:
    """Members that must be verified against another one of their pair of blocks."""
    for (token, low, high), first, second in _pairs(batches):
        fits = matching(first, second, threshold)
        if fits.any():
            # a pair belongs to the first of the groups that both are in
            before = _overlaps(*([x[5][x[5] < token] for x in side] for side in (first, second or first)))
            fits &= before == 0
        if not fits.any():
            continue
        if second is None:
            nodes = [(x[0], low) for x, k in zip(first, fits.any(1) | fits.any(0), strict=True) if k]
        else:
            nodes = [(x[0], low) for x, k in zip(first, fits.any(1), strict=True) if k]
            nodes += [(x[0], high) for x, k in zip(second, fits.any(0), strict=True) if k]
        k = len(nodes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([token] * k, pa.int64()), pa.array([low] * k, pa.int32()), pa.array([high] * k, pa.int32()),
                pa.array([b for _, b in nodes], pa.int32()), pa.array([x for x, _ in nodes], pa.int64()),
            ],
            names=["token", "low", "high", "block", "node"],
        )


def _verify(batches: Batches, threshold: Fraction) -> Batches:
    for _, first, second in _pairs(batches):
        if found := links_of(first, second, threshold):
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found]), pa.array([y for _, y in found])], names=["a", "b"]
            )


def _covering(visits: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the groups by ``key`` that are needed for every pair of nodes to meet.

    Of groups with the same nodes one stays, and a group goes if one other group is the
    largest of each of its nodes, for it holds all of them.
    """
    sizes = settle(visits.groupBy(*key).agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).groupBy("m", "x", "y").agg(F.min(F.struct(*key)).alias("k")).select("k.*", "m"), "groups")
    kept = settle(visits.join(sizes, key), "visits")
    largest = kept.groupBy("node").agg(F.max(F.struct("m", *key)).alias("largest"))
    needed = kept.join(largest, "node").groupBy(*key).agg(
        F.min("largest").alias("low_l"), F.max("largest").alias("high_l"), F.max(F.struct("m", *key)).alias("own")
    ).where((F.col("low_l") != F.col("high_l")) | (F.col("low_l") == F.col("own"))).select(*key)
    return kept.drop("m").join(needed, key, "left_semi")


def _bring(blocks: DataFrame, sets: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Members with their sets (and the groups they are in), one pair of blocks after the other."""
    one = sets.dropDuplicates(["node"])  # a class comes from every task that met it
    if lists is None:
        one = one.withColumn("lists", F.lit(None).cast("array<bigint>"))
    else:
        one = one.join(lists, "node")
    return blocks.join(one, "node").repartition("token", "low", "high").sortWithinPartitions(
        "token", "low", "high", "block"
    ).select("token", "low", "high", "block", "node", "n", "asked", "length", "tokens", "lists")


def _bits(nodes: DataFrame) -> bytes:
    """A filter of ``FILTER_BITS`` bits over the low bits of 64-bit values."""
    place = F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = nodes.groupBy((F.shiftright(place, 15)).alias("row")).agg(
        F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")
    ).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in rows:
        out[r["row"] * 4096 : (r["row"] + 1) * 4096] = r["bits"]
    return bytes(out)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node of its component.

    Each round hooks every node to its least neighbour, shortens the chains of hooks, and
    contracts the links, so rounds grow with the logarithm of the links.
    """
    edges = settle(links.select("a", "b").where("a <> b").distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).select("a", "to"), "hooks")
        while True:
            up = hook.select(F.col("a").alias("to"), F.col("to").alias("top"))
            longer = settle(hook.join(up, "to").select("a", F.col("top").alias("to"), (F.col("to") != F.col("top")).alias("moved")), "hooks")
            hook = longer.select("a", "to")
            if longer.where("moved").isEmpty():
                break
        hooks.append(hook)
        left = hook.select("a", F.col("to").alias("x"))
        right = hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = settle(
            edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            .where("a <> b").distinct(), "edges",
        )
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for hook in hooks[1:]:
        out = out.join(hook.select(F.col("a").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return settle(out, "roots") if len(hooks) > 1 else out


def _near(pairs: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """Of pairs (a, b, size: shingles of both) those whose signatures let them be linked.

    Linked sets share at least ``t / (1 + t)`` of both sizes, so at most the rest of it
    differs, and signatures differ in no more bits. No pair that is linked goes.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    signed = settle(classes.where("node is not null").select("node", "signature").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "signed")
    both = pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("one")), "a").join(
        signed.select(F.col("node").alias("b"), F.col("signature").alias("two")), "b"
    )
    apart = F.aggregate(F.zip_with("one", "two", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    num, den = threshold.numerator, threshold.denominator
    return both.where(apart * (den + num) <= F.col("size") * (den - num)).select("a", "b")


def _few_matching(entries: DataFrame, classes: DataFrame, threshold: Fraction) -> DataFrame:
    """Members of groups of at most ``FEW`` classes that may share what one of a pair asks.

    Pairs of such a group are counted over all groups; what larger groups may add is at
    most the weight of those that both are in. Of what is left, signatures drop the pairs
    that differ too much, before any whole set is brought.
    """
    few = entries.where(F.col("m") <= FEW)
    more = entries.where(F.col("m") > FEW).groupBy("node").agg(F.sum("w").alias("more"))
    one = few.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("asked").alias("ka"), "w")
    two = few.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("asked").alias("kb"))
    pairs = settle(one.join(two, "token").where(
        (F.col("a") < F.col("b"))
        & (F.least("na", "nb") * threshold.denominator >= F.greatest("na", "nb") * threshold.numerator)
    ).select("token", "a", "b", "w", F.least("ka", "kb").alias("asked"), (F.col("na") + F.col("nb")).alias("size")), "pairs")
    counted = pairs.groupBy("a", "b").agg(
        F.sum("w").alias("shared"), F.min("asked").alias("asked"), F.min("size").alias("size")
    )
    passing = counted.join(more.select(F.col("node").alias("a"), F.col("more").alias("more_a")), "a", "left").join(
        more.select(F.col("node").alias("b"), F.col("more").alias("more_b")), "b", "left"
    ).where(
        F.col("shared") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) >= F.col("asked")
    ).select("a", "b", "size")
    near = _near(settle(passing, "passing"), classes, threshold)
    met = pairs.join(near, ["a", "b"]).select("token", F.explode(F.array("a", "b")).alias("node")).distinct()
    zero = F.lit(0)
    return met.select("token", zero.alias("low"), zero.alias("high"), zero.alias("block"), "node")


def _many_matching(entries: DataFrame) -> DataFrame:
    """Members of larger groups whose prefixes meet others often enough to match one there."""
    often = entries.groupBy("node").agg(F.sum("w").alias("met"))
    return entries.where(F.col("m") > FEW).join(often, "node").where(
        F.col("met") >= F.least("asked", "least")
    ).select("token", "node")


def class_links(docs: DataFrame, classes: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """Links (a, b) between classes that join exactly those that any links join."""
    spark = docs.sparkSession
    sketch = _gather_sketch(classes.where("block is not null").select("block", "part", "counts"))
    noise = float(np.median(sketch))
    shared = spark.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))
    posted = map_batches(docs, lambda b: _post(b, width, threshold, shared, noise), "token long, node long, size long")
    dealt = posted.repartition(F.col("token")).sortWithinPartitions("token", "node")
    meeting = settle(map_batches(dealt, _meeting, "token long, node long, size long"), "meeting")
    # postings of one token are a group; groups of the same classes count as one of weight w
    groups = settle(meeting.groupBy("token").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min(F.col("size").bitwiseAND(F.lit(ASKED))).alias("least"),
    ).groupBy("m", "x", "y").agg(
        F.min("token").alias("token"), F.count("*").alias("w"), F.min("least").alias("least")
    ).select("token", "m", "w", "least"), "groups")
    entries = settle(meeting.join(groups, "token").select(
        "token", "node", F.shiftright("size", 30).alias("n"), F.col("size").bitwiseAND(F.lit(ASKED)).alias("asked"),
        "m", "w", "least",
    ), "entries")
    small, large = _few_matching(entries, classes, threshold), _many_matching(entries)
    visits = settle(_covering(large, ["token"]), "visits")

    def needed(nodes: DataFrame, whole: bool) -> tuple[DataFrame, Broadcast]:
        # one document of each class is enough; its copies would bring the set again from every task
        named = classes.select("node", F.xxhash64("doc_id", "one").alias("one"))
        texts = named.join(nodes.select("node").distinct(), "node").groupBy("node").agg(F.min("one").alias("one"))
        wanted = spark.sparkContext.broadcast(_bits(texts.select(F.col("one").alias("node"))))
        return map_batches(
            docs.withColumn("one", F.xxhash64("doc_id", F.xxhash64("text"))), lambda b: _needed(b, width, threshold, shared, noise, wanted, whole),
            "node long, n long, asked int, length int, tokens binary",
        ), wanted

    # broadcasts are destroyed after their last use, or they stay with executors and workers
    found, wanted = needed(visits, whole=False)
    prefixes = settle(found, "prefixes")
    wanted.destroy()
    sizes = prefixes.groupBy("node").agg(F.first("length").alias("size"))
    blocks = visits.join(sizes, "node").groupBy("token").agg(
        F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks")
    )
    paired = visits.join(blocks, "token").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    ).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node"
    )
    # a class has no more groups than shingles in its prefix
    lists = visits.groupBy("node").agg(F.collect_set("token").alias("lists"))
    candidates = settle(map_batches(
        _bring(paired, prefixes, lists), lambda b: _candidates(b, threshold),
        "token long, low int, high int, block int, node long",
    ), "candidates")
    # what is left of a pair of blocks is small enough to be one block: all pairs in it are
    # verified, so groups may cover each other
    zero = F.lit(0)
    candidates = candidates.select(
        F.xxhash64("token", "low", "high").alias("token"), zero.alias("low"), zero.alias("high"), zero.alias("block"), "node"
    ).distinct()
    candidates = settle(_covering(candidates.unionByName(small), ["token"]), "candidates")
    found, wanted = needed(candidates, whole=True)
    links = settle(map_batches(_bring(candidates, found), lambda b: _verify(b, threshold), "a long, b long"), "links")
    wanted.destroy()
    shared.destroy()
    return links


def _rooted(
    docs: DataFrame, width: int, threshold: Fraction, id_col: str, text_col: str, second: Column
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, one, two, n, node) of all documents, and the root (node, root) of linked classes.

    ``one`` is a digest of the text, ``two`` the second one that the caller asks for.
    """
    read = text_columns(docs, id_col, text_col)
    classes = settle(map_batches(
        read.select("*", F.xxhash64("text").alias("one"), second.alias("two")),
        lambda b: _classes(b, width), "doc_id long, one long, two long, n long, node long, signature array<long>, block int, part int, counts binary",
    ), "classes")
    roots = components(class_links(read, classes, width, threshold))
    return classes.where("block is null").select("doc_id", "one", "two", "n", "node"), roots


def ngram_join(
    docs: DataFrame, width: int = 3, threshold: Fraction = Fraction(9, 10), id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``.

    ``component_id`` is the least doc_id that links reach. A null or blank text has no
    shingles and reaches only itself. Repeated rows and equal texts are in one component
    and each keeps its row; a null identifier counts for no component's least doc_id, so
    it is the component of a row only if no other identifier is reached.
    """
    rows, roots = _rooted(docs, width, threshold, id_col, text_col, F.lit(None).cast("long"))
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("node", "component_id")
    linked = rows.join(named, "node", "left")
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_one(
    docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each component of linked texts, and all rows without words.

    The row with the least identifier stays (nulls last; ties: by a digest of the text,
    then by the row as JSON). Texts decide, not identifiers: rows that share an identifier
    or have none are judged each by its own text, and only linked ones go. A filter of fixed
    size lets rows that surely stay pass without a shuffle; the others are looked up by
    identifier and 128 bits of their text. The caller's columns travel as one value, so
    they may have any names.
    """
    text, identifier = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    digests = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    rows, roots = _rooted(docs, width, threshold, id_col, text_col, F.xxhash64(F.lit(1), "text"))
    key = ["doc_id", "one", "two"]
    texts = rows.where("node is not null").groupBy(*key, "node").agg(F.count("*").alias("copies"))
    texts = settle(texts, "texts")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), *key)
    least = texts.groupBy("node").agg(F.min(place).alias("least"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    judged = settle(texts.join(rooted.join(first, "root").select("node", "first"), "node").select(
        *key, "copies", place.eqNullSafe(F.col("first")).alias("stays")
    ).where("not stays or copies > 1"), "judged")
    bits = _bits(judged.select(F.xxhash64(*key).alias("node")).distinct())
    filled = docs.sparkSession.createDataFrame(
        [(k, row) for k, row in enumerate(_rows_of(bits)) if any(row)], "part int, bits binary"
    )
    at = F.xxhash64(*key).bitwiseAND(F.lit(FILTER_BITS - 1))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), identifier.alias("doc_id"),
        digests[0].alias("one"), digests[1].alias("two"), F.coalesce(text.rlike(A_WORD), F.lit(False)).alias("worded"),
    ).withColumn("at", at)
    byte = F.substring("bits", F.shiftright(F.col("at").bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))
    met = packed.withColumn("part", F.shiftright("at", 15).cast("int")).join(F.broadcast(filled), "part", "left").withColumn(
        "byte", F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int"), F.lit(0))
    ).withColumn("hit", F.col("worded") & F.expr("(shiftright(byte, cast(at & 7 as int)) & 1) = 1"))
    sure = met.where("not hit").select("row.*")
    gone = judged.where("not stays").select(*[F.col(c).alias(f"gone_{c}") for c in key])
    asked = met.where("hit").select("row", *key).join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_doc_id")) & (F.col("one") == F.col("gone_one")) & (F.col("two") == F.col("gone_two")),
        "left_anti",
    )
    one = asked.groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return sure.unionByName(one)


def _rows_of(bits: bytes) -> list[bytes]:
    return [bits[a : a + 4096] for a in range(0, len(bits), 4096)]
