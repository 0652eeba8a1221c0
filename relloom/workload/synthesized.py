"""Queries whose features are chosen and computed by synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relloom.plans.build import feature_matrix
from relloom.plans.features import catalog_frame
from relloom.plans.synthesis import Synthesis, synthesize
from relloom.sources.writers import interval_long
from relloom.workload.data import FILTER, entity_set, metadata
from relloom.workload.registry import query

STATUS_FILTER = {"entities": {"orders": metadata(o_orderstatus=FILTER)}}


def _comparable(df: DataFrame) -> DataFrame:
    """Doubles in single precision, after dropping the noise around zero deviations."""
    return df.selectExpr(*[_single(f"`{c}`", f"`{c}`") if t == "double" else f"`{c}`" for c, t in df.dtypes])


def _chosen(made: Synthesis, entity: str, names: list[str]) -> DataFrame:
    return _comparable(feature_matrix(made, entity, [made.features[entity][n] for n in names]))


def _single(value: str, name: str) -> str:
    """The same in Spark's and DuckDB's SQL."""
    return f"cast(case when abs({value}) < 1e-9 then 0 else {value} end * 1.000000001e0 as float) as {name}"


CUSTOMER_FEATURES = {
    "c_acctbal": "c_acctbal",
    "c_mktsegment": "c_mktsegment",
    "COUNT(orders)": "count_orders",
    "COUNT(orders[orders.o_orderstatus=F])": "count_orders_orders_o_orderstatus_f",
    "COUNT(orders[orders.o_orderstatus=O])": "count_orders_orders_o_orderstatus_o",
    "COUNT(orders[orders.o_orderstatus=P])": "count_orders_orders_o_orderstatus_p",
    "sum(orders.o_totalprice)": "sum_orders_o_totalprice",
    "avg(orders.o_totalprice)": "avg_orders_o_totalprice",
    "max(orders.o_totalprice)": "max_orders_o_totalprice",
    "std(orders.o_totalprice)": "std_orders_o_totalprice",
    "min(orders.o_totalprice)": "min_orders_o_totalprice",
    "sum(orders.COUNT(lineitem))": "sum_orders_count_lineitem",
    "avg(orders.sum(lineitem.l_quantity))": "avg_orders_sum_lineitem_l_quantity",
    "max(orders.max(lineitem.l_extendedprice))": "max_orders_max_lineitem_l_extendedprice",
    "std(orders.avg(lineitem.l_discount))": "std_orders_avg_lineitem_l_discount",
    "COUNT(events)": "count_events",
    "sum(events.value)": "sum_events_value",
    "n_nationkey.n_name": "n_nationkey_n_name",
    "n_nationkey.COUNT(customer)": "n_nationkey_count_customer",
    "n_nationkey.avg(customer.c_acctbal)": "n_nationkey_avg_customer_c_acctbal",
    "n_nationkey.sum(customer.sum(orders.o_totalprice))": "n_nationkey_sum_customer_sum_orders_o_totalprice",
    "n_nationkey.max(customer.COUNT(events))": "n_nationkey_max_customer_count_events",
    "n_nationkey.r_regionkey.r_name": "n_nationkey_r_regionkey_r_name",
    "n_nationkey.r_regionkey.COUNT(nation)": "n_nationkey_r_regionkey_count_nation",
    "n_nationkey.r_regionkey.max(nation.COUNT(customer))": "n_nationkey_r_regionkey_max_nation_count_customer",
}

CUSTOMER_SQL = f"""
with line as (
  select l_orderkey, count(*) as n, sum(l_quantity) as q, max(l_extendedprice) as e, avg(l_discount) as d
  from lineitem group by 1),
ord as (
  select o_custkey, count(o_custkey) as n,
    nullif(count(*) filter (o_orderstatus = 'F'), 0) as f, nullif(count(*) filter (o_orderstatus = 'O'), 0) as o,
    nullif(count(*) filter (o_orderstatus = 'P'), 0) as p,
    sum(o_totalprice) as s, avg(o_totalprice) as a, max(o_totalprice) as x, stddev_pop(o_totalprice) as d,
    min(o_totalprice) as i, cast(sum(line.n) as double) as ln, avg(q) as lq, max(e) as le, stddev_pop(line.d) as ld
  from orders left join line on o_orderkey = l_orderkey group by 1),
ev as (select user_id, count(*) as n, sum(value) as v from events group by 1),
cust as (
  select customer.*, ord.* exclude (o_custkey), ev.n as en, ev.v as v from customer
  left join ord on c_custkey = o_custkey left join ev on c_custkey = user_id),
nat as (
  select c_nationkey, count(*) as n, avg(c_acctbal) as a, sum(s) as s, cast(max(en) as double) as en
  from cust group by 1),
nation_full as (select nation.*, nat.* exclude (c_nationkey) from nation left join nat on n_nationkey = c_nationkey),
reg as (select n_regionkey as rk, count(*) as n, cast(max(n) as double) as mx from nation_full group by 1)
select c_custkey, {_single('c_acctbal', 'c_acctbal')}, c_mktsegment, cust.n as count_orders,
  f as count_orders_orders_o_orderstatus_f, o as count_orders_orders_o_orderstatus_o,
  p as count_orders_orders_o_orderstatus_p,
  {_single('cust.s', 'sum_orders_o_totalprice')}, {_single('cust.a', 'avg_orders_o_totalprice')},
  {_single('x', 'max_orders_o_totalprice')}, {_single('d', 'std_orders_o_totalprice')},
  {_single('i', 'min_orders_o_totalprice')}, {_single('ln', 'sum_orders_count_lineitem')},
  {_single('lq', 'avg_orders_sum_lineitem_l_quantity')}, {_single('le', 'max_orders_max_lineitem_l_extendedprice')},
  {_single('ld', 'std_orders_avg_lineitem_l_discount')}, cust.en as count_events, {_single('v', 'sum_events_value')},
  n_name as n_nationkey_n_name, nf.n as n_nationkey_count_customer,
  {_single('nf.a', 'n_nationkey_avg_customer_c_acctbal')},
  {_single('nf.s', 'n_nationkey_sum_customer_sum_orders_o_totalprice')},
  {_single('nf.en', 'n_nationkey_max_customer_count_events')},
  r_name as n_nationkey_r_regionkey_r_name, reg.n as n_nationkey_r_regionkey_count_nation,
  {_single('reg.mx', 'n_nationkey_r_regionkey_max_nation_count_customer')}
from cust left join nation_full nf on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey
left join reg on r_regionkey = rk
"""


@query("customer_feature_matrix", CUSTOMER_SQL)
def customer_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["region", "nation", "customer", "orders", "lineitem", "events"]
    made = synthesize(entity_set(spark, sf_dir, names, STATUS_FILTER), "customer")
    return _chosen(made, "customer", list(CUSTOMER_FEATURES))


# Every feature of orders with customers above and lines below.

LINE_COLUMNS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FUNCTIONS = {"sum": "sum", "avg": "avg", "max": "max", "std": "stddev_pop", "min": "min"}
FORBIDDEN = {("sum", "max"), ("sum", "min"), ("max", "min"), ("min", "max"), ("std", "std")}


def _order_sql() -> str:
    inner = {f"{f}_lineitem_{c}": (f, f"{fn}({c})::double") for c in LINE_COLUMNS for f, fn in FUNCTIONS.items()}
    per_line = ", ".join(f"{value} as {name}" for name, (_, value) in inner.items())
    outer = {"count_lineitem": "COUNT", "o_totalprice": None, **{name: f for name, (f, _) in inner.items()}}
    stacked = {
        f"{f}_orders_{name}": f"{fn}({name})::double"
        for name, below in outer.items()
        for f, fn in FUNCTIONS.items()
        if (f, below) not in FORBIDDEN
    }
    per_customer = ", ".join(f"{value} as {name}" for name, value in stacked.items())
    own = ", ".join(["count_lineitem", *[_single(name, name) for name in inner]])
    copied = ", ".join(_single(name, f"c_custkey_{name}") for name in stacked)
    return f"""
with line as (select l_orderkey, count(*) as count_lineitem, {per_line} from lineitem group by 1),
ord as (select * from orders left join line on o_orderkey = l_orderkey),
cust as (select o_custkey as k, count(*) as n, {per_customer} from ord group by 1)
select o_orderkey, o_orderstatus, {_single('o_totalprice', 'o_totalprice')}, o_orderdate, o_orderpriority, {own},
  cast(isodow(o_orderdate) - 1 as integer) as weekday_o_orderdate,
  cast(month(o_orderdate) as integer) as month_o_orderdate, c_name as c_custkey_c_name,
  {_single('c_acctbal', 'c_custkey_c_acctbal')}, c_mktsegment as c_custkey_c_mktsegment,
  c_nationkey as c_custkey_c_nationkey, n as c_custkey_count_orders, {copied}
from ord left join customer on o_custkey = c_custkey left join cust on o_custkey = k
"""


@query("order_feature_matrix", _order_sql())
def order_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"entities": {"lineitem": metadata(l_partkey={"ignore": True}, l_suppkey={"ignore": True})}}
    made = synthesize(entity_set(spark, sf_dir, ["customer", "orders", "lineitem"], config), "orders")
    names = [f.name for f in made.of("orders") if not f.key]
    return _chosen(made, "orders", names)


@query(
    "supplier_feature_matrix",
    f"""
with o as (select o_orderkey, o_totalprice, o_orderpriority from orders),
agg as (select l_suppkey, count(l_suppkey) as n, {_single('avg(o_totalprice)', 'a')}, {_single('max(p_retailprice)', 'm')},
          nullif(count(*) filter (o_orderpriority = '1-URGENT' and l_shipdate >= timestamp '1998-01-01'), 0) as u,
          nullif(count(*) filter (o_orderpriority = '5-LOW' and l_shipdate >= timestamp '1998-01-01'), 0) as l
        from lineitem left join o on l_orderkey = o_orderkey left join part on l_partkey = p_partkey
        where l_shipdate >= timestamp '1998-01-01' group by 1)
select s_suppkey, n as count_lineitem_lineitem_l_shipdate_1998_01_01_00_00_00,
  a as avg_lineitem_o_orderkey_o_totalprice_lineitem_l_shipdate_1998_01_01_00_00_00,
  m as max_lineitem_p_partkey_p_retailprice_lineitem_l_shipdate_1998_01_01_00_00_00,
  u as count_lineitem_orders_o_orderpriority_1_urgent_and_lineitem_l_shipdate_1998_01_01_00_00_00,
  l as count_lineitem_orders_o_orderpriority_5_low_and_lineitem_l_shipdate_1998_01_01_00_00_00
from supplier left join agg on s_suppkey = l_suppkey""",
)
def supplier_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates over looked-up columns and categories, under a training filter."""
    config = {
        "max_categorical_filter": 2,
        "entities": {
            "orders": metadata(o_orderpriority=FILTER),
            "lineitem": {"train_filter": [["l_shipdate", ">=", "1998-01-01 00:00:00"]]},
        },
    }
    made = synthesize(entity_set(spark, sf_dir, ["supplier", "part", "orders", "lineitem"], config), "supplier")
    since = "lineitem.l_shipdate>=1998-01-01 00:00:00"
    return _chosen(
        made,
        "supplier",
        [
            f"COUNT(lineitem[{since}])",
            f"avg(lineitem.o_orderkey.o_totalprice[{since}])",
            f"max(lineitem.p_partkey.p_retailprice[{since}])",
            f"COUNT(lineitem[orders.o_orderpriority=1-URGENT_AND_{since}])",
            f"COUNT(lineitem[orders.o_orderpriority=5-LOW_AND_{since}])",
        ],
    )


WINDOWS = [(3, 0), (2, 7), (1, 14), (0, 21)]


def _interval_sql() -> str:
    cases = " ".join(f"when ts > m - interval '{d + 7} days' then {n}" for n, d in WINDOWS)
    return f"""
with bucket as (select user_id, value, case {cases} end as i from events, (select max(ts) as m from events)),
agg as (select user_id, i, count(*)::double as c, sum(value) as s, avg(value) as a, max(value) as x,
          stddev_pop(value) as d, min(value) as n from bucket where i is not null group by 1, 2)
select c_custkey, w.i as interval, {_single('c', '"COUNT(events[int])"')}, {_single('s', '"sum(events.value[int])"')},
  {_single('a', '"avg(events.value[int])"')}, {_single('x', '"max(events.value[int])"')},
  {_single('d', '"std(events.value[int])"')}, {_single('n', '"min(events.value[int])"')}
from customer join (values (0), (1), (2), (3)) w(i) on true left join agg on c_custkey = user_id and w.i = agg.i"""


@query("interval_feature_export", _interval_sql())
def interval_feature_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval features made by synthesis, one line per customer and window."""
    config = {"entities": {"customer": {"make_intervals": {"events": {"n_intervals": 4, "delta_days": 7}}}}}
    made = synthesize(entity_set(spark, sf_dir, ["customer", "events"], config), "customer")
    windows = [f for f in made.of("customer") if f.interval is not None]
    return _comparable(interval_long(feature_matrix(made, "customer", windows), "c_custkey", windows))


def _catalog_sql() -> str:
    def row(name: str, numeric: bool, column: str | None, steps: int) -> str:
        categorical = f"(select count(distinct {column}) <= 2 from customer)" if column else "false"
        return (
            f"select '{name}' as name, {str(numeric).lower()} as \"numeric\", "
            f"{categorical} as categorical, {steps} as steps"
        )

    base = [row("c_custkey", False, None, 0), row("c_name", False, "c_name", 0)]
    base += [row(c, True, c, 0) for c in ("c_nationkey", "c_acctbal")] + [row("c_mktsegment", False, "c_mktsegment", 0)]
    made = [row("COUNT(orders)", True, None, 1)]
    made += [row(f"{f}(orders.o_totalprice)", True, None, 1) for f in FUNCTIONS]
    by_value = (
        "select 'COUNT(orders[orders.o_orderstatus=' || o_orderstatus || '])', true, false, 1 "
        "from (select distinct o_orderstatus from orders where o_orderstatus <> '')"
    )
    return " union all ".join([*base, *made, by_value])


@query("feature_catalog", _catalog_sql())
def feature_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthesize(entity_set(spark, sf_dir, ["customer", "orders"], STATUS_FILTER), "customer")
    catalog = catalog_frame(spark, made.of("customer"))
    return catalog.select("name", "numeric", "categorical", F.size("path").alias("steps"))
