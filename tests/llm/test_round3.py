"""Token alignment, curriculum and whitening against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, WORD

from relloom.llm import curriculum as mixing
from relloom.llm import token_alignment, whitening
from relloom.llm.curriculum import SCHEDULES, Schedule, by_first_copy, curriculum, training_order
from relloom.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


# ---- op11 --------------------------------------------------------------------------------

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts that tokenizers trip over: special tokens, the space mark, bytes, control signs.
TRICKY = ["x▁y", "<|endoftext|> hi", "<s>a</s>", "\x00z", "\r\n  ok", "ﬁ ﬀ", "   ", " a", "a ", "Ġ<0x41>", "שלום мир 你好"]


def brute_alignment(rows):
    """From ends of tokens alone, a text at a time."""
    tok_a, known_a = token_alignment.byte_tokenizer(tokenizer_path(A))
    tok_b, known_b = token_alignment.piece_tokenizer(tokenizer_path(B))
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = tok_a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = tok_b.encode(text or "")
        bytes_a, bytes_b = [known_a.tokens[i] for i in a], [known_b.tokens[i] for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        ends_a, ends_b = (np.cumsum([len(t) for t in x]) for x in (bytes_a, bytes_b))
        at_a, at_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
        shared = sorted(set(at_a) & set(at_b))
        links = [(at_a[e], at_b[e]) for e in shared]
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in shared:
            from_a, from_b = i, j
            while i < len(a) and ends_a[i] <= end:
                i += 1
            while j < len(b) and ends_b[j] <= end:
                j += 1
            groups.append("|".join(",".join(map(str, x)) for x in (a[from_a:i], b[from_b:j])))
        docs.append((doc_id, a, b, links, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (d, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(counts[k] == most[k[1]] for k in links),
         sum(counts[k] for k in links), g)
        for d, a, b, links, g in docs
    ]


def test_alignment_of_odd_texts(spark):
    texts = ODD[:-2] + TRICKY + ["one two three", "one two three"]
    rows = [(None if k == 4 else k, t, f"x{k}", k, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, place int, n long").repartition(3)
    got = token_alignment.token_alignment(df, tokenizer_path(A), tokenizer_path(B)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute_alignment([r[:2] for r in rows]), key=key)


def test_alignment_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_token_alignment"](spark, SF).collect()
    want = [
        (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "")
        for r in brute_alignment([(r.doc_id, r.text) for r in docs.collect()])
    ]
    assert sorted(map(tuple, got)) == sorted(want)
    assert all(r.n_links == r.n_groups and r.n_best <= r.n_links <= r.count_sum for r in got)


def test_alignment_forgets_and_begins_new_chunks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()
    want = sorted(brute_alignment([(r.doc_id, r.text) for r in docs.collect()]))
    paths = tokenizer_path(A), tokenizer_path(B)
    monkeypatch.setattr(token_alignment, "TOKEN_STEP", 4000)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 300)
    monkeypatch.setattr(token_alignment, "CHUNK_PAIRS", 500)

    def small(batches):
        token_alignment.TOKEN_STEP, token_alignment.REMEMBERED, token_alignment.CHUNK_PAIRS = 4000, 300, 500
        return token_alignment._aligned(batches, *paths, True)

    from relloom.llm.common import map_batches, settle, text_columns

    made = settle(map_batches(text_columns(docs, "doc_id", "text"), small, token_alignment.SCHEMA), "aligned")
    assert made.select("chunk").distinct().count() > 3
    got = token_alignment.linked_documents(made, token_alignment.pair_counts(made)).collect()
    assert sorted(map(tuple, got)) == want


def test_alignment_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.token_alignment(empty, tokenizer_path(A), tokenizer_path(B)).count() == 0


def test_windows_are_aligned_once():
    sizes = np.array([1, 2, 3])
    windows = token_alignment.Windows(sizes, sizes)
    a, b = np.array([0, 1, 2, 2, 0]), np.array([2, 2, 0, 1, 0])
    key = np.array([5, *a, *b], np.uint32).tobytes()
    first = windows([key, key])
    assert list(first) == [0, 0] and list(windows([key])) == [0] and len(windows.texts) == 1
    # sizes 1 2 3 3 1 and 3 3 1 2 1 end together after 3, 6, 9 and 10 bytes
    assert windows.texts[0] == "0,1|2;2|2;2|0,1;0|0;"
    assert list(windows.pairs) == [1 << 32 | 2, 2 << 32 | 2, 2 << 32 | 1, 0]


# ---- op12 --------------------------------------------------------------------------------


def brute_targets(sizes, weights, share=1.5, most=2):
    """Share what is left among the sources that have not stopped, until none is above."""
    left, stopped = share * sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in stopped}
        each = left / sum(free.values()) if free else 0
        above = [s for s in free if each * weights[s] > most * sizes[s]]
        if not above:
            return stopped | {s: each * w for s, w in free.items()}
        for s in above:
            stopped[s] = most * sizes[s]
            left -= stopped[s]


def naive_time(schedule, share):
    """The integral by small steps."""
    times = np.linspace(0, 1, 200_001)
    weights = np.interp(times, schedule.times, schedule.weights)
    whole = np.concatenate([[0], np.cumsum((weights[1:] + weights[:-1]) / 2)])
    return times[np.searchsorted(whole, share * whole[-1] - 1e-9)]


@pytest.mark.parametrize("schedule", [
    *SCHEDULES, Schedule((0, 0.25, 0.5, 1), (0, 0, 1, 0)), Schedule((0, 0.5, 0.75, 1), (4, 0, 0, 4)), Schedule((0, 1), (0, 1)),
])
def test_inverse_of_an_integrated_schedule(spark, schedule):
    schedule.check()
    shares = [0.0, 1e-6, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    rows = spark.createDataFrame([(s,) for s in shares], "s double").select("s", schedule.inverse(F.col("s")).alias("t")).collect()
    for r in rows:
        assert 0 <= r.t <= 1 and abs(r.t - naive_time(schedule, r.s)) < 1e-3


@pytest.mark.parametrize("schedule", [
    Schedule((0, 1), (1,)), Schedule((0.1, 1), (1, 1)), Schedule((0, 0.5, 0.5, 1), (1, 1, 1, 1)), Schedule((0, 1), (0, 0)),
    Schedule((0, 1), (-1, 3)),
])
def test_bad_schedules_are_refused(schedule):
    with pytest.raises(ValueError):
        schedule.check()


def check_mix(docs, got, share=1.5, most=2):
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += len(WORD.findall(text or ""))
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ordered)}
    want = brute_targets(sizes, weights, share, most)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == sum(c.words for c in r.copies) <= most * r.size
        assert all(c.words == r.size for c in r.copies[:-1]) and [c.copy for c in r.copies] == list(range(len(r.copies)))
        assert all(0 <= c["at"] <= 1 for c in r.copies)
        assert [c["at"] for c in r.copies] == sorted(c["at"] for c in r.copies)
    for s in sizes:
        assert want[s] - 1 - 1e-6 <= taken[s] <= want[s] + 1e-6


def test_mix_of_odd_rows(spark):
    docs = [(None if k == 4 else k, [None, "", "b", "a", "ü", "z", "A"][k % 7], t) for k, t in enumerate(ODD)]
    docs += [docs[6], docs[6]] + [(None, "hot", "x y z")] * 40
    df = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, source string, text string, size int, key string")
    got = curriculum(df.repartition(3)).collect()
    key = lambda r: (repr(r[0]), repr(r[1]), r[2])
    sized = sorted(((d, s, len(WORD.findall(t or ""))) for d, s, t in docs), key=key)
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=key) == sized
    check_mix(docs, got)


def test_mix_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = curriculum(docs)
    got = mix.collect()
    check_mix([(r.doc_id, r.source, r.text) for r in docs.collect()], got)
    # reruns agree, whatever the partitions
    again = by_first_copy(curriculum(docs.repartition(5))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, by_first_copy(mix).collect()))
    order = training_order(mix).collect()
    assert len(order) == sum(len(r.copies) for r in got)
    assert [r["at"] for r in order] == sorted(r["at"] for r in order)
    # by half of the time a source has given the share that its schedule says
    for k, source in enumerate(sorted({r.source for r in got})[:3]):
        words = [(r["at"], r.words) for r in order if r.source == source]
        due = (0.5, 0.375, 0.75)[k] * sum(w for _, w in words)
        assert due - 1 <= sum(w for t, w in words if t < 0.5) <= due + max(w for _, w in words)


def test_sources_that_all_stop_and_other_shares(spark):
    docs = [(k, "ab"[k % 2], "w " * (k + 1)) for k in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    check_mix(docs, curriculum(df, share=1.0, most=1).collect(), 1.0, 1)
    check_mix(docs, curriculum(df, share=0.3).collect(), 0.3)
    check_mix(docs, curriculum(df, share=2.5, most=3).collect(), 2.5, 3)


def test_mix_of_nothing(spark):
    schema = "doc_id long, source string, text string"
    assert curriculum(spark.createDataFrame([], schema)).count() == 0
    got = curriculum(spark.createDataFrame([(1, "a", None), (2, None, "")], schema)).collect()
    assert [(r.taken, r.target, r.copies) for r in got] == [(0, 0.0, [])] * 2


def test_word_pattern_is_that_of_the_contract():
    assert mixing.WORD == WORD.pattern


# ---- op13 --------------------------------------------------------------------------------


def brute_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(k, int((values > 1e-12 * values[0]).sum()))
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return values, kept, centred @ axes[:, :kept] / np.sqrt(values[:kept]), deviation, centred


def whitened_rows(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, x string")
    return whitening.whiten(df.repartition(3), **more).collect()


def check_whitening(got, ids, vectors, k=8, distinct=True):
    values, kept, want, deviation, centred = brute_whitening(vectors, k)
    assert len(got) == kept * len(vectors) and all(r.n == len(vectors) for r in got)
    table = defaultdict(dict)
    for r in got:
        table[r.vec_id][r.component] = r
    made = np.array([[table[i][c].whitened for c in range(1, kept + 1)] for i in ids])
    assert [table[i][1].deviation for i in ids] == deviation
    explained = [table[ids[0]][c].explained for c in range(1, kept + 1)]
    assert explained == pytest.approx((values / values.sum())[:kept], rel=1e-9)
    assert np.allclose(made.T @ made / len(ids), np.eye(kept), atol=1e-9) and got[0].identity_error < 1e-9
    if distinct:
        sign = np.sign((made * want).sum(0))
        assert np.allclose(made * sign, want, atol=1e-8)


def test_whitening_equals_a_dense_decomposition(spark):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((300, 12)) * np.linspace(3, 0.2, 12) + draw.standard_normal(12)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    spoilt = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12),
              (905, [1e300] * 12), (906, [1.0, 2.0])]
    check_whitening(whitened_rows(spark, rows + spoilt), list(range(300)), vectors)
    check_whitening(whitened_rows(spark, rows, components=3), list(range(300)), vectors, 3)


def test_whitening_of_given_embeddings(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    got = QUERIES["op13_whitening"](spark, SF).collect()
    check_whitening(got, [r.vec_id for r in table], [r.embedding for r in table])


@pytest.mark.parametrize("vectors", [
    [[a, b, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)],  # one eigenvalue three times
    [[a, b, a + b, 0.0] for a in (0.0, 1.0, 2.0) for b in (0.0, 5.0)],  # two dimensions of four
    [[float(k)] for k in range(5)],
    [[1.0, 2.0]] * 3 + [[2.0, 2.0]],
    np.vstack([np.eye(20), -np.eye(20)]).tolist(),  # one eigenvalue twenty times
])
def test_whitening_of_repeated_and_zero_eigenvalues(spark, vectors):
    got = whitened_rows(spark, list(enumerate(vectors)))
    check_whitening(got, list(range(len(vectors))), vectors, distinct=False)


def test_whitening_without_variation_or_rows(spark):
    assert whitened_rows(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])]) == []
    assert whitened_rows(spark, [(1, None)]) == []
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_repeated_rows_without_identifier(spark):
    got = whitened_rows(spark, [(None, [0.0, 1.0]), (None, [0.0, 1.0]), (7, [3.0, 1.0])])
    assert sorted((r.vec_id is None, r.n, r.deviation) for r in got) == [(False, 3, 6144**2), (True, 3, 3072**2), (True, 3, 3072**2)]


def test_deviation_beyond_a_long_is_null():
    mean = whitening.Centre(10**9, np.array([0]), np.array([0]))
    assert mean.deviation(np.array([[1], [10]])) == [10**18, None]
