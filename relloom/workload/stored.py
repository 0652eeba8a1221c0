"""Queries that write something and return what is read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators.aggregate import AggSpec
from relloom.operators.lookup import attach
from relloom.operators.states import append_state, from_state, load_state
from relloom.plans.build import feature_matrix
from relloom.plans.synthesis import synthesize
from relloom.runtime import shared_dir
from relloom.sources.writers import load_features, save_features, write_predictions
from relloom.workload.data import entity_set
from relloom.workload.registry import cents, query, single, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


@query(
    "features_after_append",
    """select c_custkey, n as count_orders, round(s, 2) as sum_price, cast(a * 1.000000001e0 as float) as avg_price,
              x as max_price, cast(d * 1.000000001e0 as float) as std_price, i as min_price
       from customer left join (
         select o_custkey, count(*) as n, sum(o_totalprice) as s, avg(o_totalprice) as a, max(o_totalprice) as x,
                case when stddev_pop(o_totalprice) < 1e-6 then 0 else stddev_pop(o_totalprice) end as d,
                min(o_totalprice) as i
         from orders group by 1) on c_custkey = o_custkey""",
)
def features_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive in batches by date, the last one twice; stored states make up the features."""
    orders = table(spark, sf_dir, "orders")
    path, measured = _folder(spark, "states"), ["o_totalprice"]
    early, late = F.col("o_orderdate") < "1994-01-01", F.col("o_orderdate") >= "1997-01-01"
    between = F.col("o_orderdate").isNotNull() & ~early & ~late
    batches = {"early": early | F.col("o_orderdate").isNull(), "between": between, "late": late}
    for name in [*batches, "late"]:
        append_state(orders.where(batches[name]), "o_custkey", measured, path, name)
    functions = {"count_orders": "COUNT", "sum_price": "sum", "avg_price": "avg", "max_price": "max",
                 "std_price": "std", "min_price": "min"}
    specs = [AggSpec(name, f, None if f == "COUNT" else "o_totalprice") for name, f in functions.items()]
    per_key = from_state(load_state(spark, path, measured), "o_custkey", specs)
    out = attach(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", per_key, "o_custkey")
    deviation = F.when(F.col("std_price") < 1e-6, F.lit(0.0)).otherwise(F.col("std_price"))
    return out.withColumn("std_price", deviation).select(
        "c_custkey", "count_orders", cents("sum_price"), single("avg_price"), "max_price", single("std_price"),
        "min_price",
    )


@query(
    "saved_features",
    """select c_custkey, c_name, c_acctbal, c_mktsegment, n as count_events, x as max_events_value, i as min_events_value
       from customer left join (select user_id, count(*) as n, max(value) as x, min(value) as i from events group by 1)
       on c_custkey = user_id""",
)
def saved_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix saved with its catalog; the columns read back are those the catalog names."""
    made = synthesize(entity_set(spark, sf_dir, ["customer", "events"]), "customer")
    names = ["c_name", "c_acctbal", "c_mktsegment", "COUNT(events)", "max(events.value)", "min(events.value)"]
    chosen = [made.features["customer"][n] for n in names]
    path = _folder(spark, "features")
    save_features(feature_matrix(made, "customer", chosen), chosen, path)
    matrix, catalog = load_features(spark, path)
    columns = [r["column"] for r in catalog.select("column").collect()]
    return matrix.select("c_custkey", *[c for c in matrix.columns if c in columns])


@query(
    "prediction_file_with_ids",
    """select c_name as customer, c_nationkey as nation, (c_custkey % 100) / 100.0::double as probability
       from customer where c_acctbal >= 0""",
)
def prediction_file_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions written under the names and nations that stand for the keys, and read back."""
    customers = table(spark, sf_dir, "customer")
    share = (F.col("c_custkey") % 100 / F.lit(100.0)).alias("probability")
    scored = customers.where(F.col("c_acctbal") >= 0).select("c_custkey", share)
    nation = dict(customers.dtypes)["c_nationkey"]
    path = _folder(spark, "predictions")
    write_predictions(
        scored, path, "c_custkey", header=["customer", "nation", "probability"],
        id_map=customers.select("c_custkey", "c_name", "c_nationkey"),
    )
    return spark.read.schema(f"customer string, nation {nation}, probability double").csv(path, header=True)
