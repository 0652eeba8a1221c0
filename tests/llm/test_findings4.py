"""What the findings of round 3 asked for, second part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from relloom.llm import ngram_join, token_alignment
from relloom.llm.queries import tokenizer_path


def test_both_sides_read_distinct_stretches_once(monkeypatch):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    words = ["a", "the", "Zoë", " ", "  ", "\n", "\t ", "'s", "don't", "1st", "12 x", "<s>", "x▁", "▁", "梦", " x", "...", "-", "é b", "\x00", "😀"]
    texts = ["", " ", "x", "the the the", "the  ", *["".join(words[(k * j + j * j) % len(words)] + " " * (j % 3) for j in range(30)) for k in range(150)]]
    texts += [t.replace("▁", "") for t in texts]
    met, read = token_alignment.Stretches(*paths), []
    learn = met._learn
    monkeypatch.setattr(met, "_learn", lambda found: (read.extend(found), learn(found)))
    made, known = token_alignment.piece_tokenizer(paths[1])
    byte, known_a = token_alignment.byte_tokenizer(paths[0])
    for part in (texts, texts[::-1]):
        index, begins = met([b" " + t.encode() for t in part])
        for k, text in enumerate(part):
            own = index[begins[k] : begins[k + 1]]
            b = made.encode(text)
            if text and b"".join(known.tokens[i] for i in b) == b" " + text.encode():
                a = byte.encode(" " + text, add_special_tokens=False).ids
                groups = [g.split("|") for x in own for g in met.texts[x].split(";")[:-1]]
                for side, ids in enumerate((a, b)):
                    assert [int(i) for g in groups for i in g[side].split(",")] == list(ids)
                assert met.n_a[own].sum() == len(a) and met.n_b[own].sum() == len(b)
            else:
                assert not met.n_a[own].all()
    assert len(read) == len(set(read)) and read.count(b" the") == 1


def test_pieces_of_joined_stretches_are_those_of_each_alone():
    path = tokenizer_path("piece_bpe_32k.model")
    made = token_alignment.piece_tokenizer(path)[0]
    stretches = [b" " + t.encode() for t in ["a", "b ", "c", "x▁", "d", "1", "e  ", "", "f", "  ", "g", "Zoë\n", "h"] * 40]
    ids, counts = token_alignment.piece_ids(stretches, path)
    ends = [0, *counts.cumsum().tolist()]
    assert [ids[x:y].tolist() for x, y in zip(ends, ends[1:], strict=False)] == [made.encode(s[1:].decode()) for s in stretches]


def test_signatures_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (0, 1, 5, 300, 5000)]
    sets += [np.unique(np.concatenate([sets[3][k:], rng.integers(0, 2**64, k, np.uint64)])) for k in (1, 9, 40, 200)]
    signed = [np.array(s, np.int64).view(np.uint8) for s in ngram_join.signatures(sets).to_pylist()]
    assert {len(s) for s in signed} == {ngram_join.SIGN_BITS // 8}
    for a, x in zip(sets, signed, strict=True):
        for b, y in zip(sets, signed, strict=True):
            assert np.unpackbits(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert np.unpackbits(signed[3] ^ signed[-1]).sum() > 200


def test_sets_that_differ_too_much_are_not_brought(spark, monkeypatch):
    # a and b share their rarest shingles but only half of all; c is b but for a word
    same, tails = [f"w{k}" for k in range(200)], [[f"{x}{k}" for k in range(100)] for x in "ab"]
    a, b = ([*same, *tail] for tail in tails)
    texts = [" ".join(a), " ".join(b), " ".join([*b[:-1], "last"]), " ".join(b).upper() + " ", None, ""]
    texts += [" ".join([*tail, *[f"{x}{j}" for j in range(300)]]) for tail in tails for x in "pqrs"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    brought, bring = [], ngram_join._bring

    def watched(blocks, sets, lists=None):
        brought.append({r.node for r in blocks.select("node").distinct().collect()})
        return bring(blocks, sets, lists)

    monkeypatch.setattr(ngram_join, "_bring", watched)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert got == {k: 1 if k in (2, 3) else k for k in range(len(texts))}
    node = {ngram_join.class_of(s) for s in ngram_join.shingle_sets(pa.array([texts[1], texts[2]]), 3)}
    assert brought[-1] == node
