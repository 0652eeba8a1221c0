"""Model queries on the synthesised features of documents; SQL cannot express them."""

from __future__ import annotations

from dataclasses import asdict
from uuid import uuid4

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from relloom.operators import model
from relloom.operators.lookup import split_by_ids
from relloom.operators.matrix import training_matrix
from relloom.runtime import shared_dir
from relloom.sources.writers import write_predictions
from relloom.workload.exploration import _wide_embeddings
from relloom.workload.matrices import CATEGORICAL, LABEL, NUMERIC, document_matrix
from relloom.workload.registry import query, table

PARAMS = model.ForestParams(
    k=2, k_best_percent=80, n_components=10, reweight_ratio=2, n_estimators=20, max_depth=6, max_features=50
)
FEATURES = [*NUMERIC, "label_quality"]


def _rows(spark: SparkSession, sf_dir: str, include_unlabeled: bool) -> DataFrame:
    rows = document_matrix(spark, sf_dir)
    return training_matrix(rows, "doc_id", LABEL, FEATURES + CATEGORICAL, include_unlabeled=include_unlabeled)


def _fitted(spark: SparkSession, sf_dir: str) -> model.ForestModel:
    return model.fit_forests(_rows(spark, sf_dir, False), LABEL, FEATURES, CATEGORICAL, PARAMS)


@query("reduce_svd")
def reduce_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, columns = _wide_embeddings(spark, sf_dir)
    vectors = VectorAssembler(inputCols=columns, outputCol="x").transform(wide)
    reduced = model.truncated_svd(vectors, "x", "reduced", 8).transform(vectors)
    return reduced.select("vec_id", vector_to_array("reduced").alias("components"))


@query("model_scores")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the forests fitted on the labeled ones."""
    scored = _fitted(spark, sf_dir).predict(_rows(spark, sf_dir, True))
    return scored.select("doc_id", "cluster", "probability")


@query("model_auc")
def model_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = _rows(spark, sf_dir, False)
    auc = model.roc_auc(_fitted(spark, sf_dir).predict(labeled), LABEL)
    return spark.createDataFrame([(auc,)], "auc double")


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _fitted(spark, sf_dir).importances()
    return spark.createDataFrame(ranked, "cluster int, feature string, weight double")


@query("cv_scores")
def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = model.cv_scores(_rows(spark, sf_dir, False), "doc_id", LABEL, FEATURES, CATEGORICAL, PARAMS)
    return spark.createDataFrame(list(enumerate(scores)), "fold int, auc double")


@query("param_search")
def param_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As wide as the reference's random search: 30 points from all seven ranges, three folds each."""
    points = model.random_points(30, model.PARAM_RANGES, seed=7)
    found = model.param_search(
        _rows(spark, sf_dir, False), "doc_id", LABEL, FEATURES, CATEGORICAL, points, folds=3
    )
    return spark.createDataFrame(
        [(*[getattr(p, name) for name in model.PARAM_RANGES], auc, trees) for p, auc, trees in found],
        ", ".join([*[f"{name} int" for name in model.PARAM_RANGES], "auc double", "trees int"]),
    )


@query("feature_quality_model")
def feature_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of the usual size for each feature alone."""
    quality = model.feature_quality_by_model(
        _rows(spark, sf_dir, False), "doc_id", LABEL, FEATURES, CATEGORICAL, model.ForestParams()
    )
    return spark.createDataFrame(list(quality.items()), "feature string, quality double")


@query("prediction_output")
def prediction_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on documents with a label, write predictions for the others, read them back."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    unlabeled, labeled = split_by_ids(_rows(spark, sf_dir, True), "doc_id", labels)
    scored, used = model.train_and_predict(labeled, unlabeled, "doc_id", LABEL, FEATURES, CATEGORICAL, PARAMS)
    name = ",".join(f"{k}_{v}" for k, v in asdict(used).items())
    path = f"{shared_dir(spark)}/predictions-{uuid4().hex}/{name}"
    write_predictions(scored, path, "doc_id", header=["doc_id", "probability"])
    return spark.read.schema("doc_id long, probability double").csv(path, header=True)
