"""The pipeline, each stage on what the one before kept."""

from __future__ import annotations

from fractions import Fraction

from test_operators import brute_join

import corpus_pipeline
from relloom.llm.common import settle
from relloom.llm.quality_rules import quality_rules
from relloom.llm.secret_scan import redact

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality_rules(before).where("kept"))
    before, after = seen["language_id"]
    assert after.count() >= 0.98 * before.count()
    before, after = seen["ngram_join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == sorted({c for _, _, c in brute_join(rows, 5, Fraction(4, 5))})
    before, after = seen["secret_scan"]
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {
        r.doc_id: (t := redact(r.text), len(t)) for r in before.collect()
    }
    before, after = seen["best_fit_packing"]
    assert ids(after.where("piece = 0")) == ids(before)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, after.drop("sequence_id", "offset").collect())
    )
