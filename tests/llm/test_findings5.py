from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relloom.llm import ngram_join, piece_lattice
from relloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def pieces(spark):
    return piece_lattice.read_pieces(spark, tokenizer_path("piece_bpe_32k.model"))


def test_edges_of_many_words_fold_as_the_interpreted_ones(spark, pieces):
    """digests folded the lattice by interpreted expressions, word by word."""
    words = ["▁hello", "▁the", "▁", "▁▁x", "▁naïve", "▁☃x", "▁梦\U0001F600", "▁" + "ab" * 31, "abcab", "▁�x", "▁aaaaaaa"]
    words += [f"▁w{k}o{k * k}rd" for k in range(300)]
    counted = spark.createDataFrame([(w, len(w)) for w in words], "word string, count long").repartition(3, "word").cache()
    got = piece_lattice.fold_lattice(counted, pieces, ["merges", "viterbi"]).collect()
    want = piece_lattice.encode_words(counted, pieces, ["merges", "viterbi"], ["count"]).collect()
    assert {(r.word, r["count"]): (r.merges, r.viterbi) for r in got} == {(r.word, r["count"]): (r.merges, r.viterbi) for r in want}
    assert len(got) == len(words) and all(r.merges_back and r.viterbi_back for r in got)


def test_edges_that_come_apart_are_an_error(pieces):
    rows = {"number": [1, 2, 1], "start": [0, 0, 1], "end": [1, 1, 2], "id": [5, 5, 5], "word": ["ab", "c", None], "count": [1, 1, None]}
    with pytest.raises(RuntimeError):
        list(piece_lattice.Paths(pieces).fold(iter(pa.table(rows).to_batches()), ["merges"]))


@pytest.mark.parametrize("text", ["", " ", "a", "a b", " a", "a ", "a  b", "a   ", "▁a b", "a\n b", "a \n", "é ☃ x", None])
def test_words_are_those_of_the_pattern(spark, text):
    marked = F.concat(F.lit("▁"), F.replace(F.col("t"), F.lit(" "), F.lit("▁")))
    row = spark.createDataFrame([(text,)], "t string").select(
        piece_lattice.words_of(F.col("t")).alias("got"), F.split(marked, "(?<!▁)(?=▁)").alias("want")
    ).first()
    assert row.got == (row.want if text else [])


@pytest.mark.parametrize("n, length", [(1, 1), (2, 1), (9, 3), (300, 40), (2000, 1), (2000, 1999), (2000, 2000)])
def test_sets_travel_in_fewer_bytes(n, length):
    """six bytes of every shingle of a set travelled, twice."""
    tokens = np.random.default_rng(n + length).integers(0, 1 << 64, n, np.uint64)
    tokens[-1] |= np.uint64((1 << 48) - 1)
    sent = ngram_join._sent(tokens, length)
    assert len(sent) <= 6 * n + 8 and (n - length < 200 or len(sent) < 6 * length + 5.5 * (n - length))
    got, low = ngram_join._received(sent, n, length), tokens & np.uint64((1 << 48) - 1)
    assert (got[:length] == low[:length]).all() and (got[length:] == np.sort(low[length:])).all()
    prefix = ngram_join._received(ngram_join._short(tokens[:length]), n, length)
    assert (prefix == low[:length]).all()


def test_one_copy_of_a_text_brings_its_set(spark, monkeypatch):
    """every task with a copy of a wanted text brought its set."""
    words = [f"w{k}" for k in range(120)]
    near = words[:-1] + ["other"]
    rows = [(k, " ".join(near if k % 2 else words)) for k in range(60)] + [(None, " ".join(words)), (200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()
    docs.count()
    settled, brought = ngram_join._bring, []

    def watched(blocks, sets, lists=None):
        if lists is None:
            brought.append(sets.count())
        return settled(blocks, sets, lists)

    monkeypatch.setattr(ngram_join, "_bring", watched)
    got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {(k, 0) for k in [*range(60), None]} | {(200, 200), (201, 201)}
    assert brought == [2]
