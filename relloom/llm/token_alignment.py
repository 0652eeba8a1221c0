"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut every text before a space between another character and a letter, so
such a stretch of text, a word or a few, has the same tokens wherever it stands: a task
tokenises, verifies and aligns distinct ones and remembers them. Within a stretch, where both
have a token that begins with a space at the same byte, the tokens before it end together:
such anchors cut it into windows, known by their ids on both sides. Groups are the least runs
of tokens that end together, and a link is the pair of tokens that ends a group.

How often a pair is linked in the corpus needs all documents. Tasks number the pairs of a
chunk of documents, so one row per chunk and pair is counted and joined, however often the
pair occurs; documents carry numbers and are valued chunk by chunk in a sorted stream.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.llm.common import Batches, map_batches, settle, steps, taken, text_columns

#: Text that a step tokenizes at a time.
TOKEN_STEP = 1 << 20
#: Windows or stretches of text, aligned, that a task remembers before it starts anew.
REMEMBERED = 300_000
#: Distinct stretches of text whose ids a task remembers before it starts anew.
REMEMBERED_STRETCHES = 200_000
#: Stretches that are encoded in one row.
JOINED = 1000
#: The same for pieces, whose merges wait in one queue for a row.
JOINED_PIECES = 100
#: Distinct pairs after which a task begins a new chunk.
CHUNK_PAIRS = 1 << 18
SPACE = "▁"


class Vocabulary(NamedTuple):
    """The bytes of every id, their number, whether they begin with a space, and all in a row."""

    tokens: list[bytes]
    sizes: np.ndarray
    spaced: np.ndarray
    joined: np.ndarray
    starts: np.ndarray

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.joined[taken(self.starts[ids], self.sizes[ids])]


def vocabulary(tokens: list[bytes]) -> Vocabulary:
    sizes = np.array([len(t) for t in tokens], np.int64)
    spaced = np.array([t[:1] == b" " for t in tokens], bool)
    return Vocabulary(tokens, sizes, spaced, np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte.

    Printable Latin letters stand for themselves, the other bytes for letters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@cache
def byte_tokenizer(path: str):
    """A byte-level BPE of ``tokenizers`` that reads special tokens as text, and its vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    letters = byte_letters()
    names = [made.id_to_token(i) or "" for i in range(made.get_vocab_size())]
    return made, vocabulary([bytes(letters.get(c, 63) for c in name) for name in names])


@cache
def parts_before_words(path: str) -> bool:
    """Whether the tokenizer cuts every text before a space and a letter, whatever is around them."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    rule = made.get("pre_tokenizer") or {}
    plain = rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
    special = all(t["special"] for t in made.get("added_tokens") or [])
    return bool(plain and special and not made.get("normalizer") and not made["model"].get("dropout"))


class ByteIds:
    """Ids of texts by a byte-level tokenizer, of which distinct stretches are encoded once.

    A stretch runs from a space that a letter follows to the next one; the tokenizer's rule
    ends a word before each, so no token or merge crosses it. Stretches that begin with a
    letter are encoded many at a time; sums of sizes say whose ids are whose.
    """

    def __init__(self, path: str):
        self.tokenizer, self.vocabulary = byte_tokenizer(path)
        self.parted = parts_before_words(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, rows: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [r.decode("utf-8", "surrogatepass") for r in rows]
        return _flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _learn(self, stretches: list[bytes]) -> None:
        plain = [x for x in stretches if x[1:2].isalpha()]
        other = [x for x in stretches if not x[1:2].isalpha()]
        ids, _ = self._encoded([b"".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)])
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        done = np.cumsum(self.vocabulary.sizes[ids])
        last = np.searchsorted(done, ends)
        if len(plain) and (done[-1] != ends[-1] or not np.array_equal(done[last], ends)):
            ids, sizes = self._encoded(plain)  # tokens do not restore the bytes
        else:
            sizes = np.diff(last + 1, prepend=0)
        for words, made, n in ((plain, ids, sizes), (other, *self._encoded(other))):
            self.known.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(n) - n])
            self.ids, self.sizes = np.concatenate([self.ids, made]), np.concatenate([self.sizes, n])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that each begin with a space, and how many each has."""
        if not self.parted or not texts:
            return self._encoded(texts)
        if len(self.known) > REMEMBERED_STRETCHES:
            self.clear()
        joined = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        small = joined | 32
        starts = np.zeros(len(joined), bool)
        starts[:-1] = (joined[:-1] == 32) & (small[1:] >= 97) & (small[1:] <= 122)
        starts[begins] = True
        at = np.flatnonzero(starts)
        ends = np.append(at, len(joined)).astype(np.int64)
        made = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(joined)]
        ).dictionary_encode()
        distinct = made.dictionary.to_pylist()
        if unknown := [x for x in distinct if x not in self.known]:
            self._learn(unknown)
        index = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        index = index[made.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[index]
        total = np.concatenate([[0], np.cumsum(n)])[np.append(np.searchsorted(at, begins), len(at))]
        return self.ids[taken(self.starts[index], n)], np.diff(total)


@cache
def piece_tokenizer(path: str):
    """A SentencePiece model with byte fallback, and its vocabulary."""
    from sentencepiece import SentencePieceProcessor

    made = SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(made.get_piece_size()):
        name = made.id_to_piece(i)
        if made.is_byte(i):
            tokens.append(bytes([int(name[3:5], 16)]))
        elif made.is_control(i) or made.is_unknown(i):
            tokens.append(b"")
        else:
            tokens.append(name.replace(SPACE, " ").encode("utf-8"))
    return made, vocabulary(tokens)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def _restored(ids: np.ndarray, counts: np.ndarray, known: Vocabulary, want: list[bytes]) -> np.ndarray:
    """Which documents' tokens give exactly the wanted bytes."""
    sizes = np.fromiter(map(len, want), np.int64, len(want))
    doc = np.repeat(np.arange(len(want)), counts)
    same = np.bincount(doc, known.sizes[ids], len(want)).astype(np.int64) == sizes
    got = known.bytes_of(ids[same[doc]])
    wanted = np.frombuffer(b"".join([w for w, ok in zip(want, same.tolist(), strict=True) if ok]), np.uint8)
    if not np.array_equal(got, wanted):
        places = np.flatnonzero(same)
        ends = np.cumsum(sizes[places])
        same[places[np.searchsorted(ends, np.flatnonzero(got != wanted), side="right")]] = False
    return same


@cache
def pieces_part(path: str) -> bool:
    """Whether the model cuts every text before a space that follows another character, whatever is around."""
    from sentencepiece import sentencepiece_model_pb2

    made = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        made.ParseFromString(file.read())
    rule, trainer = made.normalizer_spec, made.trainer_spec
    plain = rule.add_dummy_prefix and rule.escape_whitespaces and not (
        rule.precompiled_charsmap or rule.normalization_rule_tsv or rule.remove_extra_whitespaces
    )
    bpe = trainer.model_type == trainer.BPE and not trainer.treat_whitespace_as_suffix
    defined = any(p.type == p.USER_DEFINED or SPACE in p.piece.lstrip(SPACE) for p in made.pieces)
    return bool(plain and bpe and not defined)


def piece_ids(stretches: Sequence[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of stretches that each begin with a space, and how many each has, as if alone.

    Many are encoded in a row: those that begin with a letter and follow no space, before
    which the model cuts. Sums of sizes say whose ids are whose; a row whose tokens do not
    end where its stretches do is encoded one by one.
    """
    made, known = piece_tokenizer(path)
    n = len(stretches)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encoded(rows: Sequence[bytes]) -> list[list[int]]:
        # the model adds the first space
        return made.encode([r[1:].decode("utf-8", "surrogatepass") for r in rows], num_threads=1)

    first = np.arange(n)
    if pieces_part(path):
        begun = np.fromiter((x[1:2].isalpha() for x in stretches), bool, n)
        spaced = np.fromiter((x.endswith(b" ") for x in stretches), bool, n)
        begun[0], begun[1:] = False, begun[1:] & ~spaced[:-1]
        first = np.flatnonzero(~begun | (np.arange(n) % JOINED_PIECES == 0))
    bounds = [*first.tolist(), n]
    rows = encoded([b"".join(stretches[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)])
    sizes = np.fromiter(map(len, stretches), np.int64, n)
    ids, counts = [], np.empty(n, np.int64)
    for x, y, row in zip(bounds, bounds[1:], rows, strict=False):
        found = np.array(row, np.int64)
        if y - x > 1:
            done, wanted = np.cumsum(known.sizes[found]), np.cumsum(sizes[x:y])
            last = np.searchsorted(done, wanted)
            if done[-1] == wanted[-1] and np.array_equal(done[last], wanted):
                counts[x:y] = np.diff(last + 1, prepend=0)
            else:
                found, counts[x:y] = _flat(encoded(stretches[x:y]))
        else:
            counts[x] = len(found)
        ids.append(found)
    return np.concatenate(ids), counts


def encode_both(
    want: Sequence[bytes], path_a: str, path_b: str, ids_a: ByteIds
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids and how many each stretch has, by both; none if a side's bytes are not the stretch."""
    a, n_a = ids_a(list(want))
    b, n_b = piece_ids(want, path_b)
    good = _restored(a, n_a, byte_tokenizer(path_a)[1], want) & _restored(b, n_b, piece_tokenizer(path_b)[1], want)
    if not good.all():
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
    return a, n_a, b, n_b


class Windows:
    """Aligned windows by their ids: the groups as text and the pairs that end them."""

    def __init__(self, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.sizes_a, self.sizes_b = sizes_a, sizes_b
        # an id and what follows it: a comma, or the mark at the end of a group's side
        names = [f"{i}{end}" for i in range(len(sizes_a)) for end in ",|"]
        self.names = np.array(names + [f"{i}{end}" for i in range(len(sizes_b)) for end in ",;"], object)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.pairs, self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: list[bytes]) -> None:
        """Align windows not seen before: groups end where sums of sizes agree."""
        self.known.update(zip(keys, range(len(self.texts), len(self.texts) + len(keys)), strict=True))
        ids = np.frombuffer(b"".join(keys), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, keys), np.int64, len(keys)) // 4
        begin = np.cumsum(size) - size
        n_a = ids[begin]
        n_b = size - 1 - n_a
        a, b = ids[taken(begin + 1, n_a)], ids[taken(begin + 1 + n_a, n_b)]
        end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, shared), np.searchsorted(end_b, shared)
        until = np.searchsorted(shared, end_a[np.cumsum(n_a) - 1]) + 1
        counts = np.diff(until, prepend=0)
        # every token's place in the text: a group's tokens of one side, then of the other
        done_a, done_b = (np.concatenate([[0], x + 1]) for x in (last_a, last_b))
        place = np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + np.repeat(done_b[:-1], np.diff(done_a))
        at_b = np.arange(len(b)) + np.repeat(done_a[1:], np.diff(done_b))
        place[at_a], place[at_b] = 2 * a, 2 * (len(self.sizes_a) + b)
        place[at_a[last_a]] += 1
        place[at_b[last_b]] += 1
        names = self.names[place].tolist()
        ends = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.texts += ["".join(names[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
        self.starts = np.concatenate([self.starts, len(self.pairs) + until - counts])
        self.pairs = np.concatenate([self.pairs, a[last_a] << 32 | b[last_b]])
        self.counts = np.concatenate([self.counts, counts])

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """The numbers of windows, those not remembered aligned first."""
        if len(self.known) > REMEMBERED:
            self.clear()
        unknown = [key for key in dict.fromkeys(keys) if key not in self.known]
        if unknown:
            self._learn(unknown)
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))


def cut(a: np.ndarray, b: np.ndarray, known_a: Vocabulary, known_b: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte places of the anchors, and the tokens of both sides at which windows begin.

    Both sides hold the same bytes. An anchor is where tokens of both sides that begin with
    a space begin; the tokens before it end there, which equal sums of sizes verify.
    """
    at_a, at_b = (np.cumsum(v.sizes[x]) - v.sizes[x] for x, v in ((a, known_a), (b, known_b)))
    anchors = np.intersect1d(at_a[known_a.spaced[a]], at_b[known_b.spaced[b]], assume_unique=True)
    return anchors, np.searchsorted(at_a, anchors), np.searchsorted(at_b, anchors)


def window_keys(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which distinct window each window is, and the ids of the distinct ones as bytes."""
    n_a, n_b = np.diff(np.append(from_a, len(a))), np.diff(np.append(from_b, len(b)))
    size = 1 + n_a + n_b
    begin = np.cumsum(size) - size
    ids = np.empty(int(size.sum()), np.uint32)
    ids[begin] = n_a
    ids[taken(begin + 1, n_a)] = a
    ids[taken(begin + 1 + n_a, n_b)] = b
    ends = np.concatenate([[0], np.cumsum(size)]) * 4
    packed = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)]
    ).dictionary_encode()
    return packed.indices.to_numpy(zero_copy_only=False), packed.dictionary.to_pylist()


class Stretches:
    """Aligned stretches of text by their bytes: numbers of tokens, groups as text, pairs that end them.

    A stretch runs from a space between another character and a letter to the next one.
    Both tokenizers cut there, so its tokens and groups do not depend on the text around it.
    A text whose tokenizers do not part words is one stretch and is not remembered.
    """

    def __init__(self, path_a: str, path_b: str):
        self.paths, self.ids_a = (path_a, path_b), ByteIds(path_a)
        self.known_a, self.known_b = byte_tokenizer(path_a)[1], piece_tokenizer(path_b)[1]
        self.windows = Windows(self.known_a.sizes, self.known_b.sizes)
        self.parted = parts_before_words(path_a) and pieces_part(path_b)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        none = np.zeros(0, np.int64)
        #: of each stretch: tokens of both sides, and where its pairs are
        self.n_a, self.n_b, self.starts, self.counts, self.pairs = none, none, none, none, none

    def _learn(self, stretches: list[bytes]) -> None:
        a, n_a, b, n_b = encode_both(stretches, *self.paths, self.ids_a)
        # what was met once is remembered here
        self.ids_a.clear()
        self.windows.clear()
        texts, counts, pairs = [""] * len(stretches), np.zeros(len(stretches), np.int64), np.zeros(0, np.int64)
        if len(a):
            _, from_a, from_b = cut(a, b, self.known_a, self.known_b)
            which, keys = window_keys(a, b, from_a, from_b)
            index = self.windows(keys)[which]
            made = self.windows.counts[index]
            pairs = self.windows.pairs[taken(self.windows.starts[index], made)]
            # the stretch of a window is that of its first token
            of = np.repeat(np.arange(len(stretches)), n_a)[from_a]
            counts = np.bincount(of, made, len(stretches)).astype(np.int64)
            for k, window in zip(of.tolist(), index.tolist(), strict=True):
                texts[k] += self.windows.texts[window]
        self.known.update(zip(stretches, range(len(self.texts), len(self.texts) + len(stretches)), strict=True))
        self.texts += texts
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(counts) - counts])
        self.pairs, self.counts = np.concatenate([self.pairs, pairs]), np.concatenate([self.counts, counts])
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every stretch of texts that each begin with a space, and where each text's begin."""
        if not self.parted or len(self.known) > REMEMBERED:
            self.clear()
        joined = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        starts = np.zeros(len(joined), bool)
        if self.parted:
            small = joined[2:] | 32
            starts[1:-1] = (joined[1:-1] == 32) & (joined[:-2] != 32) & (small >= 97) & (small <= 122)
        starts[begins] = True
        at = np.flatnonzero(starts)
        ends = np.append(at, len(joined)).astype(np.int64)
        made = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(joined)]
        ).dictionary_encode()
        distinct = made.dictionary.to_pylist()
        if unknown := [x for x in distinct if x not in self.known]:
            self._learn(unknown)
        index = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return index[made.indices.to_numpy(zero_copy_only=False)], np.append(np.searchsorted(at, begins), len(at))


NAMES = ["chunk", "place", "a_id", "b_id", "n", "doc_id", "n_a", "n_b", "n_groups", "groups", "links", "times"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
         pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
SCHEMA = (
    "chunk long, place int, a_id int, b_id int, n long, doc_id long, n_a long, n_b long, n_groups long, groups string, "
    "links array<int>, times array<int>"
)


class Chunk:
    """The pairs of a task's documents, numbered, with how often each is linked."""

    def __init__(self, number: int):
        self.number = number
        self.places: dict[int, int] = {}
        self.times = np.zeros(1024, np.int64)

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        places = self.places
        distinct, which = np.unique(pairs, return_inverse=True)
        made = [places.setdefault(p, len(places)) for p in distinct.tolist()]
        return np.array(made, np.int64)[which]

    def count(self, numbers: np.ndarray, times: np.ndarray) -> None:
        if len(self.places) > len(self.times):
            self.times = np.concatenate([self.times, np.zeros(len(self.places), np.int64)])
        np.add.at(self.times, numbers, times)

    def batch(self) -> pa.RecordBatch | None:
        m = len(self.places)
        if not m:
            return None
        pairs = np.fromiter(self.places, np.int64, m)
        first = [
            np.full(m, self.number), np.arange(m, dtype=np.int32), (pairs >> 32).astype(np.int32),
            (pairs & 0xFFFFFFFF).astype(np.int32), self.times[:m],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(first, TYPES, strict=False)] + [pa.nulls(m, t) for t in TYPES[5:]], names=NAMES
        )


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def _aligned_step(part: pa.RecordBatch, stretches: Stretches, chunk: Chunk, whole: bool) -> pa.RecordBatch:
    texts = [b" " + (t or "").encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()]
    rows = len(texts)
    index, begins = stretches(texts)
    # a text has tokens if both sides restore all of its stretches
    good = np.logical_and.reduceat(stretches.n_a[index] > 0, begins[:-1])
    doc = np.repeat(np.arange(rows), np.diff(begins))
    kept = good[doc]
    index, doc = index[kept], doc[kept]
    n_a, n_b, n_groups = (
        np.bincount(doc, x[index], rows).astype(np.int64) for x in (stretches.n_a, stretches.n_b, stretches.counts)
    )
    groups, links, times, linked = [""] * rows, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    if len(index):
        distinct, which = np.unique(index, return_inverse=True)
        counts = stretches.counts[distinct]
        numbers = chunk.numbers(stretches.pairs[taken(stretches.starts[distinct], counts)])
        # links of all stretches, then the distinct ones of every document
        each = numbers[taken((np.cumsum(counts) - counts)[which], counts[which])]
        of_doc = np.repeat(doc, counts[which])
        met, often = np.unique(of_doc * (len(chunk.places) + 1) + each, return_counts=True)
        of, links, times = *np.divmod(met, len(chunk.places) + 1), often
        linked = np.bincount(of, minlength=rows)
        chunk.count(links, times)
        ends, known, numbered = np.searchsorted(doc, np.arange(rows + 1)).tolist(), stretches.texts, index.tolist()
        for k in np.flatnonzero(good).tolist():
            joined = "".join([known[x] for x in numbered[ends[k] : ends[k + 1]]])[:-1]
            groups[k] = joined if whole else hashlib.sha256(joined.encode("ascii")).hexdigest()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, chunk.number)), *[pa.nulls(rows, t) for t in TYPES[1:5]], part["doc_id"], pa.array(n_a),
            pa.array(n_b), pa.array(n_groups), pa.array(groups, pa.string()), _lists(links, linked), _lists(times, linked),
        ],
        names=NAMES,
    )


def _aligned(batches: Batches, path_a: str, path_b: str, whole: bool) -> Batches:
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    chunk, stretches = Chunk(task << 20), Stretches(path_a, path_b)
    for batch in batches:
        for part in steps(batch, most=TOKEN_STEP):
            yield _aligned_step(part, stretches, chunk, whole)
            if len(chunk.places) > CHUNK_PAIRS:
                yield chunk.batch()
                chunk = Chunk(chunk.number + 1)
    if (last := chunk.batch()) is not None:
        yield last


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """Groups and links of every row, by chunks, written once.

    Rows with ``place`` hold a pair that ends groups of their chunk, and how often; the
    others are documents: numbers of tokens and groups, ``groups`` as text (its sha256
    unless ``whole``), and ``links``, the places of their pairs, with ``times``. Texts that
    are null, empty, or not restored by either side have no tokens and ``''`` as groups.
    """
    read = text_columns(docs, id_col, text_col)
    return settle(map_batches(read, lambda b: _aligned(b, path_a, path_b, whole), SCHEMA), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a_id, b_id, total, best``: corpus-wide links of a pair; best of its ``b_id``, with ties."""
    totals = aligned.where("place is not null").groupBy("a_id", "b_id").agg(F.sum("n").alias("total"))
    totals = settle(totals, "pairs")
    most = totals.groupBy("b_id").agg(F.max("total").alias("most"))
    return totals.join(most, "b_id").select("a_id", "b_id", "total", (F.col("total") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _valued(batches: Batches) -> Batches:
    """Rows sorted by chunk, its pairs first: documents summed over the values of their pairs."""
    chunk, total, best = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        chunks = batch["chunk"].to_numpy()
        paired = batch["place"].is_valid().to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero((np.diff(chunks) != 0) | (np.diff(paired.astype(int)) != 0)) + 1, [len(chunks)]])
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            part = batch.slice(start, stop - start)
            if chunks[start] != chunk:
                chunk, total, best = chunks[start], np.zeros(0, np.int64), np.zeros(0, np.int64)
            if paired[start]:  # places of a chunk come in order, from 0
                total = np.concatenate([total, part["total"].to_numpy()])
                best = np.concatenate([best, part["best"].cast(pa.int64()).to_numpy()])
                continue
            size = part["links"].value_lengths().to_numpy(zero_copy_only=False)
            links, times = (part[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("links", "times"))
            ends = np.concatenate([[0], np.cumsum(size)])
            sums = []
            for value in (times, times * best[links], times * total[links]):
                before = np.concatenate([[0], np.cumsum(value)])
                sums.append(pa.array(before[ends[1:]] - before[ends[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [part[c] for c in ("doc_id", "n_a", "n_b", "n_groups")] + sums + [part["groups"]],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
            )


def linked_documents(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every document with its links valued by corpus-wide counts.

    A chunk's pairs meet their counts in a join of one row per chunk and pair, and stream
    ahead of the chunk's documents, sorted by place.
    """
    spark = aligned.sparkSession
    valued = aligned.where("place is not null").select("chunk", "place", "a_id", "b_id").join(pairs, ["a_id", "b_id"])
    columns = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links", "times"]
    docs = aligned.where("place is null").select("chunk", *columns)
    rows = valued.select("chunk", "place", "total", "best").unionByName(docs, allowMissingColumns=True)
    wanted = max(aligned.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # chunks are numbered by the task that made them, so they spread evenly
    owner = (F.shiftright("chunk", 20) + F.col("chunk").bitwiseAND(F.lit((1 << 20) - 1))).cast("int")
    dealt = rows.repartitionById(wanted, owner).sortWithinPartitions("chunk", F.col("place").asc_nulls_last())
    return map_batches(dealt, _valued, RESULT)


def token_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    whole: bool = True) -> DataFrame:
    """One row per row of ``docs``: tokens, groups, links and how common the links are.

    ``n_best`` counts links whose pair is the most common one of its B id, ties included;
    ``count_sum`` adds up the corpus-wide counts of all links. Texts that are null, empty or
    not restored by either side have zeros and ``''``. Repeated rows and rows without
    identifier each have their own row, and all count. An empty table gives no rows.
    """
    aligned = align(docs, path_a, path_b, id_col, text_col, whole)
    return linked_documents(aligned, settle(pair_counts(aligned), "counts"))
