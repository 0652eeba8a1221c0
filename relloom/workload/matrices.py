"""Queries on training matrices: encodings, scaling, statistics of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators import matrix, statistics
from relloom.operators.aggregate import AggSpec, aggregate_onto
from relloom.operators.profile import varying_columns
from relloom.plans.build import feature_matrix
from relloom.plans.rules import candidate_features
from relloom.plans.synthesis import synthesize
from relloom.workload.data import CATEGORY, entity_set, metadata
from relloom.workload.registry import cents, query, single, table

TEXT_CONFIG = {"entities": {"documents": metadata(lang=CATEGORY, source=CATEGORY)}}
NUMERIC = ["length_text", "n_chars"]
CATEGORICAL = ["lang", "source"]
LABEL = "label_toxic"


def document_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthesised features of documents, with both labels looked up one to one."""
    made = synthesize(entity_set(spark, sf_dir, ["documents", "labels"], TEXT_CONFIG), "documents")
    features = [f for f in made.predictable("documents") if f.column != "doc_id"]
    return feature_matrix(made, "documents", features)


DOCUMENTS = """(select d.doc_id, cast(strlen(text) as integer) as length_text, n_chars, lang, source,
                       toxic as label_toxic, quality as label_quality
                from documents d left join labels l on d.doc_id = l.doc_id)"""


@query(
    "training_matrix",
    f"""select doc_id, coalesce(label_toxic, 0) as label_toxic, length_text, n_chars, lang, source
        from {DOCUMENTS} where n_chars > 0""",
)
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_matrix(spark, sf_dir)
    return matrix.training_matrix(rows, "doc_id", LABEL, NUMERIC + CATEGORICAL, F.col("n_chars") > 0)


@query(
    "training_matrix_labeled",
    f"select doc_id, label_toxic, length_text, n_chars, lang, source from {DOCUMENTS} where label_toxic is not null",
)
def training_matrix_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_matrix(spark, sf_dir)
    return matrix.training_matrix(rows, "doc_id", LABEL, NUMERIC + CATEGORICAL, include_unlabeled=False)


@query(
    "usable_features",
    " union all ".join(
        f"select '{name}' as feature from {DOCUMENTS} having count(distinct {column}) >= 2"
        for name, column in [
            ("n_chars", "n_chars"), ("lang", "lang"), ("source", "source"), ("length(text)", "length_text"),
            ("label.quality", "label_quality"),
        ]
    ),
)
def usable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthesize(entity_set(spark, sf_dir, ["documents", "labels"], TEXT_CONFIG), "documents")
    target = made.features["documents"]["label.toxic"]
    candidates = candidate_features(made.of("documents"), target)
    names = {f.column: f.name for f in candidates}
    varying = varying_columns(feature_matrix(made, "documents", candidates), list(names)).where("varies")
    readable = F.create_map(*[F.lit(text) for pair in names.items() for text in pair])
    return varying.select(readable[F.col("column")].alias("feature"))


@query(
    "null_fill",
    """select c_custkey, coalesce(n, 0)::double as count_events, round(coalesce(total, 0), 2) as sum_value
       from customer left join (select user_id, count(*) as n, sum(value) as total from events group by 1)
       on c_custkey = user_id""",
)
def null_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [AggSpec("count_events", "COUNT"), AggSpec("sum_value", "sum", "value")]
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    out = aggregate_onto(customers, "c_custkey", table(spark, sf_dir, "events"), "user_id", specs)
    return matrix.null_fill(out, ["count_events", "sum_value"]).withColumn("sum_value", cents("sum_value"))


@query(
    "label_encode",
    """select doc_id, source, dense_rank() over (order by source nulls first) - 1 as source_code from documents""",
)
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.label_encode(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "source_code")


LANGUAGES_SQL = "select distinct lang from documents where lang <> ''"


@query(
    "one_hot",
    "select doc_id, "
    + ", ".join(f"coalesce(cast(lang = '{v}' as integer), 0) as lang_{v}" for v in ("de", "en", "es", "fr"))
    + " from documents",
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    es = entity_set(spark, sf_dir, ["documents"])
    values = es.profile.values("documents", "lang")
    return matrix.one_hot(es["documents"].df.select("doc_id", "lang"), "lang", values).drop("lang")


@query(
    "scale_unit_variance",
    """select p_partkey, cast(p_size / s1 * 1.000000001e0 as float) as p_size, cast(p_retailprice / s2 * 1.000000001e0 as float) as p_retailprice
       from part, (select stddev_pop(p_size) as s1, stddev_pop(p_retailprice) as s2 from part)""",
)
def scale_unit_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    scaled = statistics.scale_unit_variance(parts, ["p_size", "p_retailprice"])
    return scaled.select("p_partkey", single("p_size"), single("p_retailprice"))


@query(
    "scale_standard",
    """select p_partkey, cast((p_size - a1) / s1 * 1.000000001e0 as float) as p_size,
              cast((p_retailprice - a2) / s2 * 1.000000001e0 as float) as p_retailprice
       from part, (select avg(p_size) as a1, stddev_pop(p_size) as s1, avg(p_retailprice) as a2,
                          stddev_pop(p_retailprice) as s2 from part)""",
)
def scale_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    scaled = statistics.scale_standard(parts, ["p_size", "p_retailprice"])
    return scaled.select("p_partkey", single("p_size"), single("p_retailprice"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "variance_filter",
    " union all ".join(
        f"select '{c}' as feature, cast(var_pop({v}) * 1.000000001e0 as float) as variance from lineitem having var_pop({v}) > 0"
        for c, v in [*zip(MEASURES, MEASURES, strict=True), ("constant", "1.0")]
    ),
)
def variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(1.0))
    found = statistics.variances(lines, [*MEASURES, "constant"]).where("kept")
    return found.select("feature", single("variance"))


def _anova_sql(feature: str) -> str:
    return f"""select '{feature}' as feature, cast(
        (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) * 1.000000001e0 as float) as f_score
      from (select l_returnflag, count(*) as n, avg({feature}) as m, var_pop({feature}) as v
            from lineitem group by 1), (select avg({feature}) as g from lineitem)"""


@query("anova_f_scores", " union all ".join(_anova_sql(m) for m in MEASURES))
def anova_f_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = statistics.anova_f(table(spark, sf_dir, "lineitem"), "l_returnflag", MEASURES)
    return scores.withColumn("f_score", single("f_score"))


@query(
    "class_weights",
    """select doc_id, toxic, case when toxic = (
           select toxic from labels where toxic is not null group by 1 order by count(*), toxic limit 1)
         then 5.0::double else 1.0::double end as weight from labels""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.class_weights(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", 5)


def _auc_sql(column: str, label: str, source: str) -> str:
    """Mid-rank formula: sum of the ranks of the positives."""
    return f"""(select (sum(mid * pos) - sum(pos) * (sum(pos) + 1) / 2.0::double) / (sum(pos) * sum(n - pos)) from (
        select pos, n, (sum(n) over (order by v) - n + (n + 1) / 2.0::double)::double as mid from (
          select {column} as v, sum({label})::double as pos, count(*)::double as n
          from {source} where {label} is not null group by 1)))"""


@query("auc_by_rank", f"select cast({_auc_sql('n_chars', 'label_toxic', DOCUMENTS)} * 1.000000001e0 as float) as auc")
def auc_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = document_matrix(spark, sf_dir).select(LABEL, "n_chars")
    return statistics.auc_by_rank(scored, LABEL, "n_chars").select(single("auc"))


QUALITY_FEATURES = ["length_text", "n_chars", "label_toxic"]


@query(
    "feature_quality_auc",
    " union all ".join(
        f"select '{c}' as feature, cast(greatest(a, 1 - a) * 1.000000001e0 as float) as quality from "
        f"(select {_auc_sql(c, 'label_quality', DOCUMENTS)} as a)"
        for c in QUALITY_FEATURES
    ),
)
def feature_quality_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_matrix(spark, sf_dir).select("label_quality", *QUALITY_FEATURES)
    found = statistics.feature_quality(rows, "label_quality", QUALITY_FEATURES)
    return found.withColumn("quality", single("quality"))
