from __future__ import annotations

import os

import pytest

from relloom.llm import packing, piece_lattice, token_alignment
from relloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def pieces(spark):
    return piece_lattice.read_pieces(spark, tokenizer_path("piece_bpe_32k.model"))


def test_digests_take_ids_from_the_lattice(spark, pieces, monkeypatch):
    """words were folded by a Python map only; now it gets long ones alone."""
    texts = ["the hello naïve ☃ 梦 \U0001F600", "a  b", None, "", "ab" * 100 + " the", "has ▁ mark"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()
    mapped, made = piece_lattice.fold_words, []

    def watched(words, *rest):
        made.extend(r.word for r in words.collect())
        return mapped(words, *rest)

    def by_map(words, table, folds, carry=()):
        return mapped(words, table, folds).drop(*[f"{f}_back" for f in folds])

    monkeypatch.setattr(piece_lattice, "fold_words", watched)
    got = {tuple(r) for r in piece_lattice.digests(docs, pieces).collect()}
    assert made == ["▁" + "ab" * 100]
    monkeypatch.setattr(piece_lattice, "encode_words", by_map)
    assert got == {tuple(r) for r in piece_lattice.digests(docs, pieces).collect()}


def test_distinct_stretches_are_encoded_once_and_as_in_their_text():
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = token_alignment.byte_tokenizer(path)[0]
    words = ["a", "the", "Zoë", " ", "  ", "\n", "\t ", "'s", "don't", "1st", "12 x", "<|endoftext|>", "梦", "\u00a0x", "\u3000", "...", "-", "é b"]
    texts = ["", " ", "x", "the the the", *["".join(words[(k * j + j * j) % len(words)] + " " * (j % 3) for j in range(40)) for k in range(200)]]
    ids_of, seen = token_alignment.ByteIds(path), []
    learn = ids_of._learn
    ids_of._learn = lambda found: (seen.extend(found), learn(found))
    for part in (texts, texts[::-1]):
        ids, counts = ids_of([b" " + t.encode() for t in part])
        at = [0, *counts.cumsum().tolist()]
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [
            e.ids for e in tokenizer.encode_batch_fast([" " + t for t in part], add_special_tokens=False)
        ]
    assert len(seen) == len(set(seen)) and seen.count(b" the") == 1


def test_packing_leaves_the_cores_to_tasks(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    packing._loaded.__wrapped__(tokenizer_path())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
