"""Findings of the sixth round on the training-data operators."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relloom.llm import common, piece_lattice
from relloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def pieces(spark):
    return piece_lattice.read_pieces(spark, tokenizer_path("piece_bpe_32k.model"))


def test_edges_are_all_pieces_and_all_characters(spark, pieces):
    words = ["▁", "▁constitutionally", "▁▁a", "▁naïve", "▁日本語🙂x", "▁" + "ab" * 30, "▁zq\nthe", "▁e\u0301", "▁internationalization"]
    known = {r.piece: r.id for r in pieces.frame.collect()}
    want = {
        (w, a, b, known.get(w[a:b])) for w in words for a in range(len(w)) for b in range(a + 1, len(w) + 1)
        if w[a:b] in known or b == a + 1
    }
    found = piece_lattice._edges(spark.createDataFrame([(w,) for w in words], "word string"), pieces)
    rows = [(r.word, r.start, r.end, r.id) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert pieces.frame.select(F.xxhash64("piece")).distinct().count() == pieces.frame.count()


def test_few_substrings_without_a_piece_are_tried(spark, pieces):
    """every substring of up to 16 characters was joined with the pieces."""
    words = spark.createDataFrame([("▁" + "xqzj" * 12,)], "word string")
    plan = piece_lattice._edges(words, pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert "reach" in plan


def test_ids_of_words_are_not_shuffled_again(spark, pieces, tmp_path):
    """the table of distinct words was shuffled once more for the join with their places."""
    docs = spark.createDataFrame([(k, f"word{k} and word{k % 7} again") for k in range(50)], "doc_id long, text string")
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    plan = piece_lattice.digests(spark.read.parquet(path), pieces)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """Pipeline: 10,000 rows of whole texts were one Arrow batch in executor and worker."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.range(2000, numPartitions=1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    found = common.map_batches(docs, sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 2000
    assert max(r["size"] for r in found) < 2 * common.STEP_BYTES
