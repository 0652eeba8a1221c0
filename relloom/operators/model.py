"""Cluster-wise random forests on Spark ML, cross-validation and parameter search.

Rows are encoded, scaled, reduced and clustered; every cluster gets its own feature
choice and forest. All fits are Spark jobs; the driver only loops over clusters,
folds and parameter points.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from math import ceil
from threading import Lock
from typing import Any

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    UnivariateFeatureSelector,
    VarianceThresholdSelector,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relloom.operators import forest
from relloom.operators.matrix import zero_filled
from relloom.operators.statistics import ranked_areas
from relloom.operators.svd import truncated_svd
from relloom.runtime import materialize, plan_bytes

# Deepest tree Spark grows; stands for "no limit".
MAX_DEPTH = 30
# What an absent category is called before it is indexed.
MISSING = "\u0000missing"


@dataclass(frozen=True)
class ForestParams:
    k: int = 1
    k_best_percent: float = 100
    n_components: int = 100
    reweight_ratio: float = 1
    n_estimators: int = 200
    max_depth: int | None = None
    max_features: float = 50
    seed: int = 0


# Ranges of the parameter search, both ends included.
PARAM_RANGES: dict[str, tuple[int, int]] = {
    "k": (1, 6),
    "n_components": (10, 500),
    "k_best_percent": (10, 100),
    "reweight_ratio": (1, 10),
    "n_estimators": (50, 500),
    "max_depth": (1, 20),
    "max_features": (1, 100),
}


@dataclass
class ForestModel:
    numeric: list[str]
    categorical: list[str]
    encoder: PipelineModel
    svd: Any
    clusters: Any
    forests: dict[int, PipelineModel | None]
    params: ForestParams
    names: list[str] = field(default_factory=list)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Add the encoded vector ``_features`` and the number of the ``cluster``."""
        out = self.encoder.transform(_plain_inputs(df, self.numeric, self.categorical))
        out = self.svd.transform(out) if self.svd else out.withColumn("_features", F.col("_kept"))
        if self.clusters is None:
            return out.withColumn("cluster", F.lit(0))
        return self.clusters.transform(out)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``cluster`` and ``probability`` of class 1; 0.5 without a forest.

        Rows are prepared once and written; every cluster's forest reads its own.
        """
        prepared = self.prepare(df).select(*df.columns, "_features", "cluster")
        return self.score(materialize(prepared, "prepared") if len(self.forests) > 1 else prepared, df.columns)

    def score(self, prepared: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Probabilities of rows that have ``_features`` and ``cluster``."""
        parts = []
        for number, forest in self.forests.items():
            rows = prepared.where(F.col("cluster") == number) if self.clusters else prepared
            if forest is None:
                parts.append(rows.withColumn("_p", F.lit(0.5)))
            else:
                scored = forest.transform(rows)
                parts.append(scored.withColumn("_p", vector_to_array("_probability")[1]))
        chosen = [*[F.col(f"`{c}`") for c in columns], F.col("cluster"), F.col("_p").alias("probability")]
        return reduce(DataFrame.unionByName, [p.select(*chosen) for p in parts])

    def importances(self) -> list[tuple[int, str, float]]:
        """``(cluster, feature, weight)``, heaviest first within a cluster."""
        out = []
        for number, forest in self.forests.items():
            if forest is None:
                continue
            names = self.names
            if len(forest.stages) > 1:
                names = [names[i] for i in forest.stages[0].selectedFeatures]
            weights = forest.stages[-1].featureImportances.toArray()
            ranked = sorted(zip(names, weights, strict=True), key=lambda p: (-abs(p[1]), p[0]))
            out += [(number, name, float(weight)) for name, weight in ranked]
        return out


def _plain_inputs(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    return df.select(
        "*",
        *[zero_filled(c).alias(f"_n{i}") for i, c in enumerate(numeric)],
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias(f"_c{i}") for i, c in enumerate(categorical)],
    )


def _encoder(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """One-hot encoding with unknown values as zeros, unit variance, no constants.

    The scaler divides by the sample deviation: against the population deviation
    all columns change by one common factor, which moves no component, cluster or
    split.
    """
    values = [f"_n{i}" for i in range(len(numeric))]
    stages: list[Any] = []
    if categorical:
        raw = [f"_c{i}" for i in range(len(categorical))]
        index = [f"_i{i}" for i in range(len(categorical))]
        hot = [f"_h{i}" for i in range(len(categorical))]
        # The unknown value takes the last index, which the encoder drops.
        stages.append(
            StringIndexer(inputCols=raw, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc")
        )
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True))
        values += hot
    stages.append(VectorAssembler(inputCols=values, outputCol="_raw"))
    stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=False, withStd=True))
    stages.append(VarianceThresholdSelector(featuresCol="_scaled", outputCol="_kept", varianceThreshold=0.0))
    return Pipeline(stages=stages)


def _names(encoder: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    names = list(numeric)
    if categorical:
        for column, labels in zip(categorical, encoder.stages[0].labelsArray, strict=True):
            names += [f"{column}={'' if v == MISSING else v}" for v in labels]
    return [names[i] for i in encoder.stages[-1].selectedFeatures]


def fit_forests(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    params: ForestParams | None = None,
) -> ForestModel:
    """Fit on labeled rows; the label is 0 or 1 (or 0, 1, 2, ... for more classes)."""
    params = params or ForestParams()
    numeric, categorical = list(numeric), list(categorical)
    rows = _plain_inputs(df.select(label, *numeric, *categorical), numeric, categorical).persist()
    encoder = _encoder(numeric, categorical).fit(rows)
    names = _names(encoder, numeric, categorical)
    encoded = encoder.transform(rows)
    ready = encoded.select(F.col(label).cast("double").alias("_label"), "_kept")
    model = ForestModel(numeric, categorical, encoder, None, None, {}, params, names)
    try:
        _fit_encoded(model, ready, names)
    finally:
        rows.unpersist()
    return model


def _reduced(rows: DataFrame, names: Sequence[str], params: ForestParams) -> Any:
    """The reduction of encoded rows, if there are fewer components than columns."""
    if params.n_components >= len(names):
        return None
    return truncated_svd(rows, "_kept", "_features", params.n_components)


def _fit_encoded(model: ForestModel, encoded: DataFrame, names: Sequence[str]) -> None:
    """Reduce, cluster and fit on rows of ``_label`` and the encoded vector ``_kept``."""
    params = model.params
    model.svd = _reduced(encoded, names, params)
    ready = _ready(encoded, model.svd).persist()
    try:
        _fit_clusters(model, _Clusters(ready, params.k, params.seed), names)
    finally:
        ready.unpersist()


def _ready(encoded: DataFrame, svd: Any, *carry: str) -> DataFrame:
    """Rows of ``_label`` and ``_features``, reduced if there is a reduction."""
    rows = svd.transform(encoded) if svd else encoded.withColumn("_features", F.col("_kept"))
    return rows.select(*carry, "_label", "_features")


class _Clusters:
    """Clusters of rows, with what forests of any other parameters need to know of them."""

    def __init__(self, ready: DataFrame, k: int, seed: int) -> None:
        self.means = None
        self.rows = ready.withColumn("cluster", F.lit(0))
        if k > 1:
            means = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster")
            self.means = means.fit(ready)
            self.rows = self.means.transform(ready)
        self.counts: dict[int, dict[float, int]] = {n: {} for n in range(k)} if k > 1 else {}
        for row in self.rows.groupBy("cluster", "_label").count().collect():
            counts = self.counts.setdefault(row["cluster"], {})
            if row["_label"] is not None:
                counts[row["_label"]] = row["count"]
        self._ranked: dict[int, list[int]] = {}
        self._lock = Lock()

    def members(self, number: int, ratio: float) -> DataFrame:
        """A cluster's rows with their ``_weight``, the label marked with the number of its classes.

        Spark counts the classes of an unmarked label by a job of its own.
        """
        counts = self.counts[number]
        classes = {"ml_attr": {"type": "nominal", "num_vals": int(max(counts)) + 1}}
        weight, rarer = F.lit(1.0), self.rarer(number)
        if rarer is not None:
            weight = F.when(F.col("_label") == F.lit(rarer), F.lit(float(ratio))).otherwise(1.0)
        rows = self.rows.where(F.col("cluster") == number)
        return rows.select(F.col("_label").alias("_label", metadata=classes), "_features", weight.alias("_weight"))

    def rarer(self, number: int) -> float | None:
        """The rarer label of a cluster; none if there are more than two."""
        counts = self.counts[number]
        return min(counts, key=lambda label: (counts[label], label)) if len(counts) <= 2 else None

    def ranked(self, number: int, members: DataFrame, width: int) -> list[int]:
        """The places of a cluster's features, those with the least p-value first."""
        with self._lock:
            if number not in self._ranked:
                self._ranked[number] = list(_selector(width).fit(members).selectedFeatures)
        return self._ranked[number]


def _selector(features: int) -> UnivariateFeatureSelector:
    selector = UnivariateFeatureSelector(
        featuresCol="_features", labelCol="_label", outputCol="_chosen", selectionMode="numTopFeatures"
    )
    return selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(features)


def _fit_clusters(model: ForestModel, clusters: _Clusters, names: Sequence[str]) -> None:
    """A forest per cluster."""
    params = model.params
    model.names = [f"component_{i}" for i in range(params.n_components)] if model.svd else list(names)
    model.clusters = clusters.means
    for number, counts in sorted(clusters.counts.items()):
        model.forests[number] = _fit_cluster(clusters, number, len(model.names), params) if len(counts) > 1 else None


def _k_best(width: int, params: ForestParams) -> int:
    return max(1, int(0.01 * params.k_best_percent * width))


def _feature_share(params: ForestParams) -> float:
    """The share of the features that each node may be split by."""
    return max(params.max_features, 1) * 0.01


def _fit_cluster(clusters: _Clusters, number: int, width: int, params: ForestParams) -> PipelineModel:
    members = clusters.members(number, params.reweight_ratio)
    k_best = _k_best(width, params)
    stages: list[Any] = []
    if k_best < width:
        stages.append(_selector(k_best))
    stages.append(
        RandomForestClassifier(
            featuresCol="_chosen" if stages else "_features",
            labelCol="_label",
            weightCol="_weight",
            probabilityCol="_probability",
            rawPredictionCol="_raw_prediction",
            predictionCol="_prediction",
            numTrees=params.n_estimators,
            maxDepth=params.max_depth or MAX_DEPTH,
            featureSubsetStrategy=str(_feature_share(params)),
            seed=params.seed,
        )
    )
    return Pipeline(stages=stages).fit(members)


def roc_auc(scored: DataFrame, label: str, probability: str = "probability") -> float:
    evaluator = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="_score", numBins=0)
    return evaluator.evaluate(
        scored.select(F.col(label).cast("double").alias("_label"), F.col(probability).alias("_score"))
    )


def with_fold(df: DataFrame, id_column: str, folds: int) -> DataFrame:
    """A fold per id that does not change between runs."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(id_column), F.lit(folds)).cast("int"))


def cv_scores(
    df: DataFrame,
    id_column: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    params: ForestParams | None = None,
    folds: int = 3,
) -> list[float]:
    """ROC AUC per fold over the labeled rows."""
    labeled = with_fold(df.where(F.col(label).isNotNull()), id_column, folds).persist()
    scores = []
    try:
        for fold in range(folds):
            model = fit_forests(labeled.where(F.col("_fold") != fold), label, numeric, categorical, params)
            held_out = labeled.where(F.col("_fold") == fold).drop("_fold")
            scores.append(roc_auc(model.predict(held_out), label))
    finally:
        labeled.unpersist()
    return scores


def feature_quality_by_model(
    df: DataFrame,
    id_column: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    params: ForestParams | None = None,
    folds: int = 2,
) -> dict[str, float]:
    """Mean AUC of a model of each feature alone; 0 where none can be fitted."""
    quality = {}
    for feature in [*numeric, *categorical]:
        as_numeric = [feature] if feature in numeric else []
        as_category = [] if as_numeric else [feature]
        try:
            scores = cv_scores(df, id_column, label, as_numeric, as_category, params, folds)
        except (IllegalArgumentException, AnalysisException):
            scores = [0.0]
        quality[feature] = sum(scores) / len(scores)
    return quality


def random_points(
    n: int, ranges: Mapping[str, tuple[int, int]] | None = None, seed: int = 0
) -> list[ForestParams]:
    """Seeded uniform integer points within the ranges."""
    draw = random.Random(seed)
    ranges = ranges or PARAM_RANGES
    return [
        replace(ForestParams(seed=seed), **{name: draw.randint(*bounds) for name, bounds in ranges.items()})
        for _ in range(n)
    ]


class _Fold:
    """One fold, encoded and written once for every point of a search."""

    def __init__(self, train: DataFrame, test: DataFrame, label: str, numeric: list[str], categorical: list[str]) -> None:
        self.numeric, self.categorical = numeric, categorical
        rows = _plain_inputs(train, numeric, categorical)
        self.encoder = _encoder(numeric, categorical).fit(rows)
        self.names = _names(self.encoder, numeric, categorical)
        self.train, self.test = (self._encoded(part, label) for part in (train, test))
        self._made: dict[Any, Any] = {}
        self._locks: dict[Any, Lock] = {}
        self._lock = Lock()

    def _encoded(self, part: DataFrame, label: str) -> DataFrame:
        """Written rows in as few partitions as their size asks for: a tree level is a job."""
        rows = self.encoder.transform(_plain_inputs(part, self.numeric, self.categorical))
        rows = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(label).cast("double").alias("_label"), "_kept")
        written = materialize(rows, "fold")
        return written.coalesce(int(plan_bytes(written) // FOLD_BYTES) + 1)

    def _once(self, key: Any, make: Callable[[], Any]) -> Any:
        """What ``make`` gives, computed once for all points that ask for ``key``."""
        with self._lock:
            lock = self._locks.setdefault(key, Lock())
        with lock:
            if key not in self._made:
                self._made[key] = make()
            return self._made[key]

    def svd(self, components: int | None) -> Any:
        """Leading directions nest: those of the widest reduction serve all others."""
        if components is None:
            return None
        whole = self._once("svd", lambda: truncated_svd(self.train, "_kept", "_features", len(self.names) - 1))
        return replace(whole, singular_values=whole.singular_values[:components], components=whole.components[:, :components])

    def reduced(self, components: int | None) -> tuple[Any, DataFrame, DataFrame]:
        """The reduction, and the rows to learn from and to score in it."""

        def make() -> tuple[Any, DataFrame, DataFrame]:
            svd = self.svd(components)
            return svd, _ready(self.train, svd, "_row").persist(), _ready(self.test, svd, "_row").persist()

        return self._once(("reduced", components), make)

    def key(self, params: ForestParams) -> tuple[int | None, int, int]:
        """What points must agree in to learn from the same clusters."""
        components = params.n_components if params.n_components < len(self.names) else None
        return components, params.k, params.seed

    def clusters(self, key: tuple[int | None, int, int]) -> tuple[_Clusters, DataFrame]:
        """Clusters of the rows to learn from, and the rows to score with their ``cluster``."""

        def make() -> tuple[_Clusters, DataFrame]:
            components, k, seed = key
            _, ready, test = self.reduced(components)
            found = _Clusters(ready, k, seed)
            return found, found.means.transform(test) if found.means else test.withColumn("cluster", F.lit(0))

        return self._once(("clusters", key), make)

    def forest(self, params: ForestParams, number: int) -> dict[str, Any]:
        """What :class:`forest.Forest` needs to know of a point's forest of a cluster."""
        components, _, _ = key = self.key(params)
        clusters, _ = self.clusters(key)
        counts = clusters.counts[number]
        width = components or len(self.names)
        k_best, places, weights = _k_best(width, params), range(width), [1.0]
        if len(counts) > 1:
            if any(label < 0 or label != int(label) for label in counts):
                raise ValueError(f"labels must be 0, 1, 2, ...: {sorted(counts)}")
            if k_best < width:
                members = clusters.members(number, params.reweight_ratio)
                places = sorted(clusters.ranked(number, members, width)[:k_best])
            weights = [1.0] * (int(max(counts)) + 1)
            if (rarer := clusters.rarer(number)) is not None:
                weights[int(rarer)] = float(params.reweight_ratio)
        return {
            "depth": params.max_depth or MAX_DEPTH, "per_node": ceil(_feature_share(params) * len(places)),
            "places": [int(p) for p in places], "weights": weights, "seed": params.seed,
        }

    def close(self) -> None:
        for key, made in self._made.items():
            if key[0] == "reduced":
                made[1].unpersist()
                made[2].unpersist()


#: A round of a search keeps one in so many points, and gives each so many times the trees.
HALVING = 3
#: Folds and clusters prepared at the same time; each is a row of small jobs that leave cores idle.
CONCURRENT = 8
#: Written bytes of a fold in one partition.
FOLD_BYTES = 16 << 20


def param_search(
    df: DataFrame,
    id_column: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    points: Sequence[ForestParams],
    folds: int = 3,
    rounds: int = 3,
) -> list[tuple[ForestParams, float, int]]:
    """``point, mean AUC, trees``, best first, by successive halving over the number of trees.

    The first round fits every point with few of its trees, each later one the best third
    with three times as many; the last fits whole forests. Every fit uses all labeled rows of
    its fold. Points that went further come first; within a round the AUC decides. The
    reduction to fewer components is computed once for each fold; folds are those of
    :func:`cv_scores`. Forests of a round grow together (:mod:`relloom.operators.forest`); a later
    round adds trees to those of the rounds before.
    """
    numeric, categorical = list(numeric), list(categorical)
    labeled = with_fold(df.where(F.col(label).isNotNull()), id_column, folds).persist()

    def fold(n: int) -> _Fold:
        return _Fold(labeled.where(F.col("_fold") != n), labeled.where(F.col("_fold") == n), label, numeric, categorical)

    left, done, grown, votes = list(enumerate(points)), {}, {}, []
    made: list[_Fold] = []
    try:
        with ThreadPoolExecutor(max_workers=CONCURRENT) as pool:
            made += pool.map(fold, range(folds))
            first = _first_data([sorted({f.key(p) for p in points}, key=str) for f in made])
            sets = _sets(made, first, pool)
            for turn in range(rounds):
                share = HALVING ** (rounds - 1 - turn)
                tries = {n: -(-p.n_estimators // share) for n, p in left}
                asked = [(n * folds + k, f, first[k, f.key(p)], p, c) for n, p in left for k, f in enumerate(made)
                         for c in f.clusters(f.key(p))[0].counts]
                facts = pool.map(lambda job: job[1].forest(job[3], job[4]), asked)
                votes.append(sets.votes([
                    forest.Forest(number=number, data=base + c, first=grown.get(number // folds, 0), last=tries[number // folds], **fact)
                    for (number, _, base, _, c), fact in zip(asked, facts, strict=True)
                ]))
                grown |= tries
                scores = _aucs(votes, [n * folds + k for n in tries for k in range(folds)])
                for n, trees in tries.items():
                    mean = sum(scores[n * folds + k] for k in range(folds)) / folds
                    done[n] = (turn, mean, trees)
                kept = sorted(left, key=lambda pair: (-done[pair[0]][1], pair[0]))
                left = kept[: max(1, -(-len(left) // HALVING))]
    finally:
        labeled.unpersist()
        for f in made:
            f.close()
    order = sorted(range(len(points)), key=lambda n: (-done[n][0], -done[n][1], n))
    return [(points[n], done[n][1], done[n][2]) for n in order]


def _first_data(keys: Sequence[Sequence[tuple[int | None, int, int]]]) -> dict[tuple[int, Any], int]:
    """The number of the first cluster of each key of each fold."""
    out, number = {}, 0
    for n, found in enumerate(keys):
        for key in found:
            out[n, key] = number
            number += key[1]
    return out


def _sets(made: Sequence[_Fold], first: Mapping[tuple[int, Any], int], pool: ThreadPoolExecutor) -> forest.Sets:
    """The clusters of all folds as numbered data sets."""
    found = list(pool.map(lambda job: made[job[0]].clusters(job[1]), first))
    columns = ["_row", "_label", "_features"]
    parts = []
    for number, (clusters, test) in zip(first.values(), found, strict=True):
        for rows, held_out in ((clusters.rows, False), (test, True)):
            parts.append(rows.select((F.lit(number) + F.col("cluster")).alias("data"), F.lit(held_out).alias("test"), *columns))
    return forest.Sets(reduce(DataFrame.unionByName, parts))


def _aucs(votes: Sequence[DataFrame], tries: Sequence[int]) -> dict[int, float]:
    """The AUC of each try, by the votes of all rounds; as :func:`roc_auc` where rows are of one class or none."""
    rows = reduce(DataFrame.unionByName, votes).where(F.col("try").isin(list(tries)))
    total = rows.groupBy("try", "row").agg(
        F.first("label").alias("label"), (F.sum("votes") / F.nullif(F.sum("trees"), F.lit(0))).alias("share")
    ).withColumn("share", F.coalesce("share", F.lit(0.0)))
    out = dict.fromkeys(tries, 0.5)
    for r in ranked_areas(total, "try", F.col("label") > 0.5, "share").collect():
        out[r["try"]] = r.area / (r.p * r.n) if r.p and r.n else float(r.n == 0)
    return out


def train_and_predict(
    train: DataFrame,
    test: DataFrame,
    id_column: str,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    params: ForestParams | None = None,
    search: Sequence[ForestParams] = (),
) -> tuple[DataFrame, ForestParams]:
    """Fit on one part, score the other: ``id, probability`` and the parameters used."""
    if search:
        params = param_search(train, id_column, label, numeric, categorical, search)[0][0]
    model = fit_forests(train, label, numeric, categorical, params)
    return model.predict(test).select(id_column, "probability"), model.params
