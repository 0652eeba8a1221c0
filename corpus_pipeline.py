"""A corpus from raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the documents of the next. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.llm.common import settle, table
from relloom.llm.language_id import UNKNOWN, predict, train
from relloom.llm.ngram_join import keep_one
from relloom.llm.packing import SEQUENCE, SEQUENCE_WEIGHTS, pack
from relloom.llm.quality_rules import keep_good
from relloom.llm.queries import query, tokenizer_path
from relloom.llm.secret_scan import redact_secrets

#: A document whose language scores less is taken to be in none of those learned.
LEAST_LANGUAGE_SCORE = 0.4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that were learned from these documents.

    ``lang`` stays what it was; the prediction only decides. All documents stay if none
    has a language to learn from.
    """
    network = train(docs)
    if network is None:
        return docs
    text_last = [c for c in docs.columns if c != "text"]
    carried = {f"in_{c}": F.col(f"`{c}`") for c in text_last} | {"in_text": F.col("text")}
    judged = predict(docs, network, "text", carried)
    sure = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return sure.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return keep_one(docs, width=5, threshold=Fraction(4, 5))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path(), SEQUENCE, weights=SEQUENCE_WEIGHTS)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Language identification and packing cannot be expressed in SQL.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
