"""Best-fit packing of token pieces into sequences, under several capacities at once.

Only the lengths of pieces matter to packing, and there are at most ``capacity`` of them:
the vector best fit runs over how many pieces have each length, bins in equal states
standing together as one range. Its plan names, for every length, which ranks go to which
bins; it does not grow with the corpus. Pieces find their rank within their length from
counts per written chunk, so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Sequence
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relloom.llm.common import Batches, coded, map_batches, settle, steps, taken, text_columns, words_of

#: Distinct words whose ids a task remembers before it starts anew.
REMEMBERED = 200_000
#: Text that a step tokenizes at a time.
TOKEN_STEP = 2 << 20
#: Letters that a lower-casing, composing tokenizer takes as one word, and what may end it.
PLAIN = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,]*)$"
#: The splitting rule under which a run of letters is a word by itself (a fixed value).
LETTER_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Capacity(NamedTuple):
    """What a sequence may hold; attention costs the square of a piece's length."""

    tokens: int = 2048
    pieces: int | None = None
    attention: int | None = None


#: What the query and the pipeline pack by: 2048 tokens, and the pieces and the attention that
#: 2048 tokens can come to, the least bounds that never open a sequence which tokens would not.
SEQUENCE = Capacity(2048, 2048, 2048**2)
#: How much tokens, pieces and attention count in their rating (fixed values).
SEQUENCE_WEIGHTS = (1.0, 0.5, 0.5)


@cache
def _loaded(path: str):
    """A process's tokenizer, whether it follows the letter rule, and the ids that end a word."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    tokenizer = Tokenizer.from_file(path)
    mark = made["model"].get("end_of_word_suffix")
    rules, normal = json.dumps(made["pre_tokenizer"] or {}), json.dumps(made["normalizer"] or {})
    letters = bool(mark) and json.dumps(LETTER_RULE)[1:-1] in rules and "Lowercase" in normal
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    if letters:
        ends[[i for token, i in made["model"]["vocab"].items() if token.endswith(mark)]] = True
    return tokenizer, letters, ends


class WordIds:
    """Ids of words parted by ASCII white space, which the tokenizer drops.

    Every distinct word is encoded once and remembered. If the tokenizer takes runs of
    letters as words, ``Word,`` is remembered as ``word`` and ``,``, and new words are
    encoded many at a time: each ends with the only id that has the end-of-word mark.
    """

    def __init__(self, path: str):
        self.tokenizer, self.letters, self.ends = _loaded(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes])

    def _encode(self, words: list[str], plain: bool) -> None:
        if not words:
            return
        if plain:
            joined = [" ".join(words[a : a + 1000]) for a in range(0, len(words), 1000)]
        else:
            joined = words
        made = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(made), np.uint32)
        if plain:
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(words):
                raise ValueError("a run of letters is not one word of this tokenizer")
            sizes = np.diff(np.concatenate([[0], stops]))
        else:
            sizes = np.fromiter(map(len, made), np.int64, len(made))
        self._learn(words, ids, sizes)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and how many each text has."""
        words, begins = words_of(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        made = words.dictionary_encode()
        index, distinct = made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary
        if len(self.known) > REMEMBERED:
            self.clear()
        parts = pc.extract_regex(distinct, PLAIN if self.letters else "(?P<head>$^)(?P<tail>)")
        plain = parts.is_valid()
        head, heads = coded(pc.if_else(plain, pc.utf8_lower(parts.field("head")), distinct))
        tail, tails = coded(pc.if_else(plain, parts.field("tail"), ""))
        is_plain = np.zeros(len(heads), bool)
        is_plain[head] = plain.to_numpy(zero_copy_only=False)
        self._encode([w for w, p in zip(heads, is_plain, strict=True) if p and w not in self.known], True)
        other = [w for w, p in zip(heads, is_plain, strict=True) if not p] + tails
        self._encode([w for w in dict.fromkeys(other) if w not in self.known], False)
        both = np.stack([
            np.fromiter(map(self.known.__getitem__, x), np.int64, len(x))[k] for k, x in ((head, heads), (tail, tails))
        ], 1)
        ids = self.ids[taken(self.starts[both].ravel(), self.sizes[both].ravel())]
        size = self.sizes[both].sum(1)
        start = np.cumsum(size) - size
        sizes = size[index]
        ends = np.concatenate([[0], np.cumsum(sizes)])[begins]
        return ids[taken(start[index], sizes)], np.diff(ends)


def _pieces(batches: Batches, tokenizer: str, most: int, end_id: int) -> Batches:
    ids_of = WordIds(tokenizer)
    context = TaskContext.get()
    chunk = context.partitionId() if context else 0
    ranks = np.zeros(most + 1, np.int64)
    for batch in batches:
        for part in steps(batch, most=TOKEN_STEP):
            ids, counts = ids_of(part["text"])
            # every document ends with ``end_id``
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
            counts = counts + 1
            begins = np.cumsum(counts) - counts
            n = -(-counts // most)
            rows = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * most
            length = np.minimum(counts[rows] - start, most)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[a : a + s]) for a, s in zip(4 * (begins[rows] + start), 4 * length, strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(sorted_)) + 1])
            size = np.diff(np.concatenate([first, [len(sorted_)]]))
            rank = np.empty(len(length), np.int64)
            rank[order] = ranks[sorted_] + np.arange(len(sorted_)) - np.repeat(first, size)
            ranks[sorted_[first]] += size
            yield pa.RecordBatch.from_arrays(
                [
                    part["doc_id"].take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array(np.array(crc, np.int64)), pa.array(rank),
                    pa.array(np.full(len(rows), chunk, np.int64)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "chunk"],
            )


def token_pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Pieces of at most ``most`` tokens, with their rank among equal lengths of their chunk.

    A null text is empty: one piece that holds only ``end_id``. A chunk is the partition
    that made the rows; settle the frame before using ranks, so that they are made once.
    """
    return map_batches(
        text_columns(docs, id_col, text_col), lambda b: _pieces(b, tokenizer, most, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, chunk long",
    )


class Run(NamedTuple):
    """Ranks ``first .. first + count`` of a length, ``copies`` to a bin from bin ``bin_id`` on."""

    length: int
    first: int
    count: int
    copies: int
    bin_id: int
    offset: int


def best_fit(counts: dict[int, int], capacity: Capacity, weights: Sequence[float] = (1.0, 0.0, 0.0),
             score: str = "norm") -> list[Run]:
    """Best fit of all lengths, longest first, bins in one state handled as one range.

    Among the bins that a piece fits under every capacity, the residual after placing it
    decides: the least weighted norm (``norm``), or the greatest weighted dot product of
    the piece with what the bin has left (``dot``); ties go to the oldest bin. Capacities
    are shares of the whole, so that tokens, pieces and attention compare.
    """
    # a capacity that is not set is one that whole-numbered pieces never exhaust
    whole = np.array([capacity.tokens, capacity.pieces or capacity.tokens, capacity.attention or capacity.tokens**2], float)
    if counts and max(counts) ** 2 > whole[2]:
        raise ValueError("a piece alone costs more attention than a sequence may")
    share = np.asarray(weights) / whole
    left = np.zeros((0, 3))
    first_bin, bins = np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs: list[Run] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length**2], float)
        remaining, rank = counts[length], 0
        fits = np.flatnonzero((left >= need).all(1))
        after = (left[fits] - need) * share
        rating = (after**2).sum(1) if score == "norm" else -(left[fits] * share * need * share).sum(1)
        queue = list(fits[np.lexsort((first_bin[fits], rating))])
        changed: list[tuple[int, int, np.ndarray]] = []
        gone: list[int] = []
        while remaining:
            if queue:
                k = int(queue.pop(0))
                state, begin, size = left[k], int(first_bin[k]), int(bins[k])
            else:
                k, state, begin = -1, whole, opened
                size = -(-remaining // int(np.min(whole // need)))
                opened += size
            copies = int(np.min(state // need))
            used = min(size, -(-remaining // copies))
            placed = min(remaining, used * copies)
            runs.append(Run(length, rank, placed, copies, begin, capacity.tokens - int(state[0])))
            whole_bins, rest = divmod(placed, copies)
            if whole_bins:
                changed.append((begin, whole_bins, state - copies * need))
            if rest:
                changed.append((begin + whole_bins, 1, state - rest * need))
            if k >= 0:
                if used < size:
                    first_bin[k] += used
                    bins[k] -= used
                else:
                    gone.append(k)
            rank += placed
            remaining -= placed
        if gone:
            stay = np.ones(len(bins), bool)
            stay[gone] = False
            left, first_bin, bins = left[stay], first_bin[stay], bins[stay]
        changed = [c for c in changed if c[2][0] >= 1]
        if changed:
            left = np.concatenate([left, np.array([c[2] for c in changed])])
            first_bin = np.concatenate([first_bin, np.array([c[0] for c in changed])])
            bins = np.concatenate([bins, np.array([c[1] for c in changed])])
    return runs


def least_sequences(counts: dict[int, int], capacity: Capacity, weights: Sequence[float], score: str) -> list[Run]:
    """The rated plan, or the one rated by tokens alone where that takes fewer sequences."""
    plans = [best_fit(counts, capacity, w, score) for w in (weights, (1.0, 0.0, 0.0))]
    return min(plans, key=lambda runs: max((r.bin_id - (-r.count // r.copies) for r in runs), default=0))


def assign(pieces: DataFrame, capacity: Capacity, weights: Sequence[float], score: str) -> DataFrame:
    """Sequence and offset of every settled piece."""
    spark: SparkSession = pieces.sparkSession
    per_chunk = settle(pieces.groupBy("chunk", "length").count(), "lengths")
    totals = per_chunk.groupBy("length").agg(F.sum("count").alias("n")).collect()
    runs = least_sequences({r["length"]: r["n"] for r in totals}, capacity, weights, score)
    # at most ``tokens`` lengths, and for each the ranges of bins it is dealt to
    plan = spark.createDataFrame(
        pa.table({f: pa.array([r[k] for r in runs], pa.int64()) for k, f in enumerate(Run._fields)})
    ) if runs else spark.createDataFrame([], "length long, first long, count long, copies long, bin_id long, offset long")
    plans = plan.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "count", "copies", "bin_id", "offset"))).alias("plan")
    )
    before = per_chunk.select(
        "chunk", "length",
        (F.sum("count").over(Window.partitionBy("length").orderBy("chunk")) - F.col("count")).alias("before"),
    )
    placed = pieces.join(before.join(F.broadcast(plans), "length"), ["chunk", "length"]).withColumn(
        "at", F.col("before") + F.col("rank")
    ).withColumn("run", F.filter("plan", lambda r: (F.col("at") >= r["first"]) & (F.col("at") < r["first"] + r["count"]))[0])
    inside = F.col("at") - F.col("run.first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.bin_id") + F.floor(inside / F.col("run.copies"))).cast("long").alias("sequence_id"),
        (F.col("run.offset") + F.col("length") * (inside % F.col("run.copies"))).cast("long").alias("offset"),
    )


def pack(
    docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 0, id_col: str = "doc_id",
    text_col: str = "text", weights: Sequence[float] = (1.0, 0.0, 0.0), score: str = "norm",
) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence.

    Documents longer than a sequence, in tokens or by their attention, are cut into pieces
    as long as a sequence may hold and a rest. Offsets are
    gapless from 0. Equal lengths are dealt in the order of chunk and rank, so repeated
    rows and ties are placed each on its own; an empty table gives no rows; a null
    identifier stays null.
    """
    most = capacity.tokens if capacity.attention is None else min(capacity.tokens, math.isqrt(capacity.attention))
    pieces = settle(token_pieces(docs, tokenizer, most, end_id, id_col, text_col), "pieces")
    return assign(pieces, capacity, weights, score)
