"""Categories of any width: sparse counts per key, their cells by window, chosen columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.operators import categories, profile
from relloom.operators.lookup import attach
from relloom.workload.registry import query, table

PARTS = (1, 2, 3, 500, 100_000_000)


@query(
    "count_by_open_category",
    """with codes as (select l_partkey, row_number() over (order by l_partkey) - 1 as place from
         (select distinct l_partkey from lineitem where l_partkey is not null)),
       counts as (select l_suppkey, place, count(*) as n from lineitem join codes using (l_partkey)
         where l_suppkey is not null group by all)
       select l_suppkey, string_agg(place || ':' || n, ',' order by place) as cells from counts group by l_suppkey""",
)
def count_by_open_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines by part: as many values as there are parts, none of them collected."""
    lines = table(spark, sf_dir, "lineitem")
    codes = categories.dictionary(lines, "l_partkey")
    return categories.as_text(categories.sparse_counts(lines, "l_suppkey", "l_partkey", codes), "l_suppkey")


@query(
    "count_by_chosen_values",
    "select s_suppkey, " + ", ".join(f"n_{p}" for p in PARTS) + " from supplier left join (select l_suppkey, "
    + ", ".join(f"nullif(count(*) filter (l_partkey = {p}), 0) as n_{p}" for p in PARTS)
    + " from lineitem group by 1) on s_suppkey = l_suppkey",
)
def count_by_chosen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide columns of a few parts out of the sparse counts; the last part does not exist."""
    lines = table(spark, sf_dir, "lineitem")
    codes = categories.dictionary(lines, "l_partkey")
    sparse = categories.sparse_counts(lines, "l_suppkey", "l_partkey", codes)
    wide = categories.chosen_values(sparse, "l_suppkey", codes, {p: f"n_{p}" for p in PARTS})
    return attach(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", wide, "l_suppkey")


CELLS_SQL = """with codes as (select {value} as v, row_number() over (order by {value}) - 1 as place from
         (select distinct {value} from {child} where {value} is not null)),
       placed as (select {key}, place,
           9 - floor(date_diff('microsecond', {ts}, (select max({ts}) from {child})) / 604800000000.0)::bigint as w
         from {child} join codes on {value} = v where {key} is not null),
       counts as (select {key}, w * (select count(*) from codes) + place as cell, count(*) as n from placed
         where w between 0 and 9 group by all)
       select {key}, string_agg(cell || ':' || n, ',' order by cell) as cells from counts group by {key}"""


@query("count_by_window_and_category", CELLS_SQL.format(child="events", key="user_id", value="event_type", ts="ts"))
def count_by_window_and_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events by week and type, ten weeks back from the latest, in one pass."""
    events = table(spark, sf_dir, "events")
    codes = categories.dictionary(events, "event_type")
    return categories.as_text(categories.sparse_cells(events, "user_id", "ts", "event_type", codes), "user_id")


@query(
    "count_by_window_and_part",
    CELLS_SQL.format(child="lineitem", key="l_suppkey", value="l_partkey", ts="l_shipdate"),
)
def count_by_window_and_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten weeks times every part: the cells of a supplier that are not zero."""
    lines = table(spark, sf_dir, "lineitem")
    codes = categories.dictionary(lines, "l_partkey")
    cells = categories.sparse_cells(lines, "l_suppkey", "l_shipdate", "l_partkey", codes)
    return categories.as_text(cells, "l_suppkey")


@query(
    "one_hot_sparse",
    """select event_id, props_place::varchar || ':1' as cells from events left join
         (select props, row_number() over (order by props) - 1 as props_place from
           (select distinct props from events where props is not null and props <> '')) using (props)""",
)
def one_hot_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties as one place among all that occur."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    hot = categories.one_hot_places(events, "props", categories.dictionary(events, "props"))
    text = categories.as_text(hot, "event_id")
    return text.withColumn("cells", F.when(F.col("cells") != "", F.col("cells")))


SCREENED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "screened_distinct_counts",
    " union all ".join(
        f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from orders having count(distinct {c}) <= 100"
        for c in SCREENED
    ),
)
def screened_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of the columns that a sketch shows to have few values."""
    return profile.few_valued(table(spark, sf_dir, "orders"), SCREENED, 100)
