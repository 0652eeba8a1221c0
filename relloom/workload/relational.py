"""Queries over single relationships: profiling, filters, row features, aggregates, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.functions.predicates import Predicate
from relloom.functions.rows import add_row_features
from relloom.operators import profile
from relloom.operators.aggregate import (
    AggSpec,
    aggregate,
    aggregate_onto,
    category_counts,
    distinct_per_key,
    mean_gap_days,
)
from relloom.operators.intervals import interval_predicates, interval_rows
from relloom.operators.lookup import (
    SPREAD,
    attach,
    flatten,
    lookup_join,
    split_by_ids,
    wide_read,
    with_spread,
)
from relloom.operators.ordered import add_decile, group_median
from relloom.workload.data import EDGES, KEYS, entity_set
from relloom.workload.registry import cents, query, single, table

FUNCTIONS = ("sum", "avg", "max", "std", "min")
SQL_FUNCTION = {
    "sum": "round(sum({0}), 2)",
    "avg": "cast(avg({0}) * 1.000000001e0 as float)",
    "max": "cast(max({0}) as double)",
    "std": "cast(stddev_pop({0}) * 1.000000001e0 as float)",
    "min": "cast(min({0}) as double)",
}
ROUNDED = {"sum": cents, "avg": single, "std": single}


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


# Sources and profiling


@query(
    "entity_row_counts",
    _union([f"select '{n}' as entity, count(*) as num_rows from {n}" for n in KEYS]),
)
def entity_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_set(spark, sf_dir, KEYS).row_counts()


def _edge_label(child: str, fk: str, parent: str) -> str:
    return f"{child}.{fk}->{parent}.{KEYS[parent]}"


@query(
    "relationship_stats",
    _union(
        [
            f"select '{_edge_label(c, fk, p)}' as edge, count(*) as referenced_parents, "
            f"cast(coalesce(sum(n), 0) as bigint) as child_rows, max(n) as max_children, "
            f"cast(avg(n) * 1.000000001e0 as float) as mean_children "
            f"from (select {fk}, count(*) as n from {c} where {fk} is not null group by 1)"
            for c, fk, p in EDGES
        ]
    ),
)
def relationship_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = entity_set(spark, sf_dir, KEYS).relationship_stats()
    return stats.withColumn("mean_children", single("mean_children"))


@query(
    "key_problems",
    _union(
        [
            f"select '{n}.{k}' as \"constraint\", 'key' as kind, count(*) as problems from "
            f"(select {k} from {n} group by 1 having count(*) > 1 or {k} is null)"
            for n, k in KEYS.items()
            if k
        ]
        + [
            f"select '{_edge_label(c, fk, p)}', 'foreign key', count(distinct {fk}) from {c} "
            f"where {fk} is not null and not exists (select 1 from {p} where {p}.{KEYS[p]} = {c}.{fk})"
            for c, fk, p in EDGES
        ]
    ),
)
def key_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_set(spark, sf_dir, KEYS).key_problems()


COUNTED = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]


@query(
    "distinct_counts",
    _union([f"select '{c}' as \"column\", count(distinct {c}) as n_distinct from lineitem" for c in COUNTED]),
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_counts(table(spark, sf_dir, "lineitem"), COUNTED)


BINARY_TABLES = {
    "lineitem": ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                 "l_linestatus", "l_shipdate"],
    "orders": ["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "labels": ["quality", "toxic"],
}


@query(
    "infer_binary_columns",
    _union(
        [
            f"select '{t}' as entity, '{c}' as \"column\" from {t} having count(distinct {c}) <= 2"
            for t, columns in BINARY_TABLES.items()
            for c in columns
        ]
    ),
)
def infer_binary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    es = entity_set(spark, sf_dir, BINARY_TABLES)
    rows = [(t, c) for t in BINARY_TABLES for c in es.profile.binary(t)]
    return spark.createDataFrame(rows, "entity string, column string")


@query(
    "distinct_values",
    "select distinct o_orderpriority as value from orders "
    "where o_orderpriority is not null and o_orderpriority <> '' order by 1",
)
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("column_range", "select max(o_orderdate) as max_value, min(o_orderdate) as min_value from orders")
def column_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_range(table(spark, sf_dir, "orders"), "o_orderdate")


@query(
    "one_to_one_check",
    _union(
        [
            f"select '{_edge_label(c, fk, p)}' as edge, "
            f"coalesce(min(n) = 1 and max(n) = 1, false) as one_to_one from "
            f"(select {p}.{KEYS[p]} as k, count(*) as n from {p} join {c} on {p}.{KEYS[p]} = {c}.{fk} group by 1)"
            for c, fk, p in EDGES
        ]
    ),
)
def one_to_one_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.one_to_one_report(entity_set(spark, sf_dir, KEYS))


# Filters and wide reads

WIDE_SQL = """
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, o_orderdate, o_orderpriority,
       c_name, c_mktsegment, n_name
from lineitem
left join orders on l_orderkey = o_orderkey
left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey
where o_orderstatus = 'F' and l_quantity >= 10 and c_mktsegment is not null
"""
WIDE_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "o_orderdate", "o_orderpriority",
                "c_name", "c_mktsegment", "n_name"]


@query(
    "filter_conjunction",
    "select o_orderkey, o_custkey, o_totalprice, 'orders.o_orderstatus=F_AND_orders.o_totalprice>100000' as label "
    "from orders where o_orderstatus = 'F' and o_totalprice > 100000 and o_orderdate is not null",
)
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = Predicate.of(("o_orderstatus", "=", "F", "orders.o_orderstatus"))
    dear = Predicate.of(("o_totalprice", ">", 100000, "orders.o_totalprice"))
    dated = Predicate.of(("o_orderdate", "IS NOT NULL", None, "orders.o_orderdate", True))
    chosen = finished & dear & dated
    orders = table(spark, sf_dir, "orders").where(chosen.to_column())
    return orders.select("o_orderkey", "o_custkey", "o_totalprice", F.lit(chosen.label).alias("label"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their parents: small parents first, so lines are joined once."""
    read = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    nation = read("nation", "n_nationkey", "n_name")
    customer = read("customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = lookup_join(customer, "c_nationkey", nation, "n_nationkey")
    orders = lookup_join(orders, "o_custkey", customer, "c_custkey")
    lines = with_spread(table(spark, sf_dir, "lineitem"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", SPREAD)
    return lookup_join(lines, "l_orderkey", orders, "o_orderkey")


WIDE_FILTER = Predicate.of(("o_orderstatus", "=", "F"), ("l_quantity", ">=", 10), ("c_mktsegment", "IS NOT NULL", None))


@query("wide_read", WIDE_SQL)
def wide_read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_read(_wide(spark, sf_dir), WIDE_COLUMNS, WIDE_FILTER.to_column())


@query(
    "wide_read_top",
    "select l_orderkey, l_linenumber, l_quantity, l_extendedprice, o_orderdate, c_name from ("
    + WIDE_SQL
    + ") order by l_extendedprice desc, l_orderkey, l_linenumber, l_quantity limit 1000",
)
def wide_read_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "o_orderdate", "c_name"]
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_quantity")]
    return wide_read(_wide(spark, sf_dir), columns, WIDE_FILTER.to_column(), order, 1000)


# Row features


@query("row_text_length", 'select doc_id, cast(strlen(text) as integer) as "length(text)" from documents')
def row_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return add_row_features(documents, ["doc_id"], ["text"]).drop("text")


@query(
    "row_weekday",
    'select o_orderkey, cast(isodow(o_orderdate) - 1 as integer) as "weekday(o_orderdate)" from orders',
)
def row_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return add_row_features(orders, ["o_orderkey"], included=["weekday"]).drop("o_orderdate")


@query(
    "row_month",
    'select o_orderkey, cast(month(o_orderdate) as integer) as "month(o_orderdate)" from orders',
)
def row_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return add_row_features(orders, ["o_orderkey"], included=["month"]).drop("o_orderdate")


@query(
    "row_features_orders",
    """select *, cast(strlen(o_orderpriority) as integer) as "length(o_orderpriority)",
       cast(isodow(o_orderdate) - 1 as integer) as "weekday(o_orderdate)",
       cast(month(o_orderdate) as integer) as "month(o_orderdate)" from orders""",
)
def row_features_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_row_features(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"], ["o_orderpriority"])


@query(
    "row_decile",
    """select c_custkey, c_acctbal, cast(round(10.0::double * (cnt - r + 1) / cnt, 0) as integer)
         as "[c_acctbal]_decile"
       from (select c_custkey, c_acctbal, count(*) over () as cnt,
                    row_number() over (order by c_acctbal desc nulls last, c_custkey) as r from customer)""",
)
def row_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_decile(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey")


# Aggregates of one edge


def _orders_per_customer(function: str) -> tuple[str, str]:
    name = f"{function.lower()}_orders"
    value = "nullif(count(o_custkey), 0)" if function == "COUNT" else SQL_FUNCTION[function].format("o_totalprice")
    sql = (
        f"select c_custkey, {name} from customer left join "
        f"(select o_custkey, {value} as {name} from orders group by 1) on c_custkey = o_custkey"
    )
    return name, sql


def _lines_per_order(function: str) -> tuple[str, str]:
    name = f"{function.lower()}_lines"
    value = "count(l_orderkey)" if function == "COUNT" else SQL_FUNCTION[function].format("l_extendedprice")
    sql = (
        f"select o_orderkey, {name} from orders left join "
        f"(select l_orderkey, {value} as {name} from lineitem group by 1) on o_orderkey = l_orderkey"
    )
    return name, sql


def _register_single(function: str, suffix: str) -> None:
    """Orders without lines keep NULL in every one of these, counts included."""
    name, sql = _lines_per_order(function)

    @query(f"agg_{suffix}", sql)
    def one_function(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey")
        lines = table(spark, sf_dir, "lineitem")
        column = None if function == "COUNT" else "l_extendedprice"
        out = aggregate_onto(orders, "o_orderkey", lines, "l_orderkey", [AggSpec(name, function, column)])
        return out.withColumn(name, ROUNDED[function](name)) if function in ROUNDED else out


for _function, _suffix in [("COUNT", "count"), *[(f, f) for f in FUNCTIONS]]:
    _register_single(_function, _suffix)

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "agg_all_numeric",
    "select o_orderkey, a.* exclude (l_orderkey) from orders left join (select l_orderkey, "
    "count(l_orderkey) as count_lines, "
    + ", ".join(f"{SQL_FUNCTION[f].format(m)} as {f}_{m}" for f in FUNCTIONS for m in MEASURES)
    + " from lineitem group by 1) a on o_orderkey = l_orderkey",
)
def agg_all_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [AggSpec("count_lines", "COUNT")]
    specs += [AggSpec(f"{f}_{m}", f, m) for f in FUNCTIONS for m in MEASURES]
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    out = aggregate_onto(orders, "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey", specs)
    rounded = [ROUNDED[s.function](s.name) if s.function in ROUNDED else F.col(s.name) for s in specs]
    return out.select("o_orderkey", *rounded)


@query(
    "agg_customer_orders",
    "select c_custkey, a.* exclude (o_custkey) from customer left join (select o_custkey, "
    "count(o_custkey) as count_orders, "
    + ", ".join(f"{SQL_FUNCTION[f].format('o_totalprice')} as {f}_price" for f in FUNCTIONS)
    + " from orders group by 1) a on c_custkey = o_custkey",
)
def agg_customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [AggSpec("count_orders", "COUNT")] + [AggSpec(f"{f}_price", f, "o_totalprice") for f in FUNCTIONS]
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    out = aggregate_onto(customers, "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", specs)
    rounded = [ROUNDED[s.function](s.name) if s.function in ROUNDED else F.col(s.name) for s in specs]
    return out.select("c_custkey", *rounded)


ORDER_QUANTITY = "select l_orderkey, sum(l_quantity) as q from lineitem group by 1"


@query(
    "agg_stacked_two_level",
    f"""select c_custkey, sum_quantity, avg_quantity from customer left join (
          select o_custkey, round(sum(q), 2) as sum_quantity, cast(avg(q) * 1.000000001e0 as float) as avg_quantity
          from orders left join ({ORDER_QUANTITY}) on o_orderkey = l_orderkey group by 1
        ) on c_custkey = o_custkey""",
)
def agg_stacked_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = aggregate_onto(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey",
        table(spark, sf_dir, "lineitem"), "l_orderkey", [AggSpec("q", "sum", "l_quantity")],
    )
    specs = [AggSpec("sum_quantity", "sum", "q"), AggSpec("avg_quantity", "avg", "q")]
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    out = aggregate_onto(customers, "c_custkey", orders, "o_custkey", specs)
    return out.select("c_custkey", cents("sum_quantity"), single("avg_quantity"))


@query(
    "agg_stacked_three_level",
    """select n_nationkey, avg_lines from nation left join (
         select c_nationkey, cast(avg(lines) * 1.000000001e0 as float) as avg_lines from customer left join (
           select o_custkey, sum(n) as lines from orders left join
             (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey
           group by 1) on c_custkey = o_custkey
         group by 1) on n_nationkey = c_nationkey""",
)
def agg_stacked_three_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = aggregate_onto(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey",
        table(spark, sf_dir, "lineitem"), "l_orderkey", [AggSpec("n", "COUNT")],
    )
    customers = aggregate_onto(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey",
        orders, "o_custkey", [AggSpec("lines", "sum", "n")],
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    out = aggregate_onto(nations, "n_nationkey", customers, "c_nationkey", [AggSpec("avg_lines", "avg", "lines")])
    return out.select("n_nationkey", single("avg_lines"))


@query(
    "agg_over_flat",
    """select p_partkey, avg_order_price, max_order_price from part left join (
         select l_partkey, cast(avg(o_totalprice) * 1.000000001e0 as float) as avg_order_price,
                max(o_totalprice) as max_order_price
         from lineitem left join orders on l_orderkey = o_orderkey group by 1) on p_partkey = l_partkey""",
)
def agg_over_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = with_spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_partkey", SPREAD)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    flat = lookup_join(lines, "l_orderkey", orders, "o_orderkey")
    specs = [AggSpec("avg_order_price", "avg", "o_totalprice"), AggSpec("max_order_price", "max", "o_totalprice")]
    out = aggregate_onto(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", flat, "l_partkey", specs)
    return out.withColumn("avg_order_price", single("avg_order_price"))


@query(
    "agg_training_filter",
    """select c_custkey, count_orders, sum_price from customer left join (
         select o_custkey, count(o_custkey) as count_orders, round(sum(o_totalprice), 2) as sum_price
         from orders where o_orderdate < timestamp '1998-01-01' group by 1) on c_custkey = o_custkey""",
)
def agg_training_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = Predicate.of(("o_orderdate", "<", "1998-01-01 00:00:00"))
    specs = [AggSpec("count_orders", "COUNT", None, early), AggSpec("sum_price", "sum", "o_totalprice", early)]
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    out = aggregate_onto(customers, "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", specs)
    return out.withColumn("sum_price", cents("sum_price"))


STATUSES = ["F", "O", "P"]


@query(
    "count_by_category",
    "select c_custkey, "
    + ", ".join(f"count_{s}" for s in STATUSES)
    + " from customer left join (select o_custkey, "
    + ", ".join(f"nullif(count(*) filter (o_orderstatus = '{s}'), 0) as count_{s}" for s in STATUSES)
    + " from orders group by 1) on c_custkey = o_custkey",
)
def count_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    es = entity_set(spark, sf_dir, ["customer", "orders"])
    names = {v: f"count_{v}" for v in es.profile.values("orders", "o_orderstatus")}
    counts = category_counts(es["orders"].df, "o_custkey", "o_orderstatus", names)
    return attach(es["customer"].df.select("c_custkey"), "c_custkey", counts, "o_custkey")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _priority_sql(extra: str) -> str:
    return (
        "select s_suppkey, "
        + ", ".join(f"count_{p[0]}" for p in PRIORITIES)
        + " from supplier left join (select l_suppkey, "
        + ", ".join(
            f"nullif(count(*) filter (starts_with(o_orderpriority, '{p[0]}') {extra}), 0) as count_{p[0]}"
            for p in PRIORITIES
        )
        + " from lineitem left join orders on l_orderkey = o_orderkey group by 1) on s_suppkey = l_suppkey"
    )


def _supplier_priorities(spark: SparkSession, sf_dir: str, predicate: Predicate | None) -> DataFrame:
    es = entity_set(spark, sf_dir, ["supplier", "lineitem", "orders"])
    lines = with_spread(es["lineitem"].df).select("l_orderkey", "l_suppkey", SPREAD)
    orders = es["orders"].df.select("o_orderkey", "o_orderpriority", "o_orderdate")
    flat = lookup_join(lines, "l_orderkey", orders, "o_orderkey")
    names = {v: f"count_{v[0]}" for v in es.profile.values("orders", "o_orderpriority")}
    counts = category_counts(flat, "l_suppkey", "o_orderpriority", names, predicate)
    return attach(es["supplier"].df.select("s_suppkey"), "s_suppkey", counts, "l_suppkey")


@query("count_by_flat_category", _priority_sql(""))
def count_by_flat_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_priorities(spark, sf_dir, None)


@query("count_by_category_filtered", _priority_sql("and o_orderdate >= timestamp '1997-01-01'"))
def count_by_category_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplier_priorities(spark, sf_dir, Predicate.of(("o_orderdate", ">=", "1997-01-01 00:00:00")))


@query(
    "count_by_wide_category",
    "select n_nationkey, "
    + ", ".join(f"count_{n}" for n in range(1, 51))
    + " from nation left join (select s_nationkey, "
    + ", ".join(f"nullif(count(*) filter (l_quantity = {n}), 0) as count_{n}" for n in range(1, 51))
    + " from lineitem left join supplier on l_suppkey = s_suppkey group by 1) on n_nationkey = s_nationkey",
)
def count_by_wide_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty values: counted through a pivot instead of fifty conditions."""
    es = entity_set(spark, sf_dir, ["nation", "supplier", "lineitem"])
    lines = with_spread(es["lineitem"].df).select("l_suppkey", "l_quantity", SPREAD)
    flat = lookup_join(lines, "l_suppkey", es["supplier"].df.select("s_suppkey", "s_nationkey"), "s_suppkey")
    names = {v: f"count_{v:.0f}" for v in es.profile.values("lineitem", "l_quantity")}
    counts = category_counts(flat, "s_nationkey", "l_quantity", names)
    return attach(es["nation"].df.select("n_nationkey"), "n_nationkey", counts, "s_nationkey")


WINDOWS = [(3, 0), (2, 7), (1, 14), (0, 21)]
INTERVAL_SQL = (
    "select user_id, i as interval, count(*) as n, round(sum(value), 2) as total from "
    "(select user_id, value, case "
    + " ".join(f"when ts > m - interval '{d + 7} days' then {n}" for n, d in WINDOWS)
    + " end as i from events, (select max(ts) as m from events)) where i is not null and user_id is not null group by 1, 2"
)


@query(
    "agg_intervals",
    "select c_custkey, "
    + ", ".join(f"count_int_{n}, sum_int_{n}" for n, _ in WINDOWS)
    + f" from customer left join (select user_id, "
    + ", ".join(
        f"max(n) filter (interval = {n}) as count_int_{n}, max(total) filter (interval = {n}) as sum_int_{n}"
        for n, _ in WINDOWS
    )
    + f" from ({INTERVAL_SQL}) group by 1) on c_custkey = user_id",
)
def agg_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    es = entity_set(spark, sf_dir, ["customer", "events"])
    latest, earliest = es.profile.extent("events", "ts")
    specs = []
    for window in interval_predicates("ts", latest, earliest, 4, 7):
        specs.append(AggSpec(f"count_int_{window.interval}", "COUNT", None, window))
        specs.append(AggSpec(f"sum_int_{window.interval}", "sum", "value", window))
    out = aggregate_onto(es["customer"].df.select("c_custkey"), "c_custkey", es["events"].df, "user_id", specs)
    sums = {s.name: cents(s.name) for s in specs if s.function == "sum"}
    return out.withColumns(sums)


@query("interval_long_export", INTERVAL_SQL)
def interval_long_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interval_rows(table(spark, sf_dir, "events"), "user_id", "ts", "value", 4, 7)
    return rows.withColumn("total", cents("total"))


FIRST_CUSTOMER = "select c_nationkey as fn, c_mktsegment as fs, min(c_custkey) as referrer from customer group by 1, 2"


@query(
    "agg_self_reference",
    f"""select c.c_custkey, count_referrer, sum_referrer_acctbal from customer c left join (
          select referrer, count(referrer) as count_referrer, round(sum(c_acctbal), 2) as sum_referrer_acctbal
          from customer join ({FIRST_CUSTOMER}) on c_nationkey = fn and c_mktsegment = fs group by 1
        ) r on c.c_custkey = r.referrer""",
)
def agg_self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers refer to the first customer of their nation and segment."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    first = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("referrer"))
    people = customer.join(first, ["c_nationkey", "c_mktsegment"])
    specs = [AggSpec("count_referrer", "COUNT"), AggSpec("sum_referrer_acctbal", "sum", "c_acctbal")]
    out = aggregate_onto(customer.select("c_custkey"), "c_custkey", people, "referrer", specs)
    return out.withColumn("sum_referrer_acctbal", cents("sum_referrer_acctbal"))


@query(
    "agg_mean_gap",
    """select o_custkey, cast(datesub('day', min(o_orderdate), max(o_orderdate))
         / nullif(count(o_orderdate) - 1, 0)::double * 1.000000001e0 as float) as mean_gap
       from orders where o_custkey is not null group by 1""",
)
def agg_mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = mean_gap_days(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")
    return gaps.withColumn("mean_gap", single("mean_gap"))


@query(
    "agg_count_distinct",
    "select l_suppkey, count(distinct l_partkey) as distinct_parts from lineitem where l_suppkey is not null group by 1",
)
def agg_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_per_key(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "distinct_parts")


@query(
    "agg_median",
    "select l_suppkey, cast(median(l_extendedprice) * 1.000000001e0 as float) as median_price from lineitem "
    "where l_suppkey is not null group by 1",
)
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = group_median(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "median_price")
    return medians.withColumn("median_price", single("median_price"))


# Lookups


@query(
    "flat_parent",
    """select o_orderkey, o_custkey, c_name as "c_custkey.c_name", c_acctbal as "c_custkey.c_acctbal",
              c_mktsegment as "c_custkey.c_mktsegment"
       from orders left join customer on o_custkey = c_custkey""",
)
def flat_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer")
    return flatten(orders, "o_custkey", customers, "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], "c_custkey")


@query(
    "flat_multi_hop",
    """select l_orderkey, l_linenumber, l_quantity, o_totalprice, c_acctbal, n_name, r_name
       from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
       left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""",
)
def flat_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parents are folded into each other first, so lines are joined once."""
    read = lambda name, *columns: table(spark, sf_dir, name).select(*columns)
    nation = lookup_join(
        read("nation", "n_nationkey", "n_name", "n_regionkey"), "n_regionkey",
        read("region", "r_regionkey", "r_name"), "r_regionkey",
    )
    customer = lookup_join(read("customer", "c_custkey", "c_acctbal", "c_nationkey"), "c_nationkey", nation, "n_nationkey")
    orders = lookup_join(read("orders", "o_orderkey", "o_totalprice", "o_custkey"), "o_custkey", customer, "c_custkey")
    lines = with_spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity", SPREAD)
    lines = lookup_join(lines, "l_orderkey", orders, "o_orderkey")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity", "o_totalprice", "c_acctbal", "n_name", "r_name")


@query(
    "flat_of_agg",
    """select o_orderkey, count_orders as "c_custkey.COUNT(orders)" from orders left join
       (select o_custkey as k, count(*) as count_orders from orders group by 1) on o_custkey = k""",
)
def flat_of_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = aggregate_onto(
        table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders, "o_custkey",
        [AggSpec("COUNT(orders)", "COUNT")],
    )
    return flatten(orders, "o_custkey", customers, "c_custkey", ["COUNT(orders)"], "c_custkey").drop("o_custkey")


@query(
    "flat_one_to_one",
    """select d.doc_id, lang, source, n_chars, quality as "label.quality", toxic as "label.toxic"
       from documents d left join labels l on d.doc_id = l.doc_id""",
)
def flat_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return flatten(documents, "doc_id", table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"], "label")


# Splits by an id list: customers who appear in the events are the test rows.


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ids = table(spark, sf_dir, "events").select("user_id")
    return split_by_ids(table(spark, sf_dir, "customer"), "c_custkey", ids)


@query("split_train_rows", "select * from customer where c_custkey not in (select user_id from events)")
def split_train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[0]


@query("split_test_rows", "select * from customer where c_custkey in (select user_id from events)")
def split_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)[1]


@query(
    "conversation_roles",
    """select conv_id, count(*) as count_turns, nullif(count(*) filter (role = 'user'), 0) as count_user,
              nullif(count(*) filter (role = 'assistant'), 0) as count_assistant,
              cast(sum(strlen(text)) as double) as sum_length, cast(max(strlen(text)) as double) as max_length
       from conversations group by 1""",
)
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates for an entity that exists only as a key of its children."""
    turns = add_row_features(table(spark, sf_dir, "conversations"), ["conv_id"], ["text"])
    specs = [
        AggSpec("count_turns", "COUNT"),
        AggSpec("count_user", "COUNT", None, Predicate.of(("role", "=", "user"))),
        AggSpec("count_assistant", "COUNT", None, Predicate.of(("role", "=", "assistant"))),
        AggSpec("sum_length", "sum", "length(text)"),
        AggSpec("max_length", "max", "length(text)"),
    ]
    return aggregate(turns, "conv_id", specs)
