"""Which features are made, on tiny key graphs, and that their values follow the lineage."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from relloom.entityset import EntitySet
from relloom.functions.aggregates import AGGREGATES
from relloom.plans.build import feature_matrix
from relloom.plans.features import catalog_frame
from relloom.plans.rules import candidate_features, predictable_features
from relloom.plans.synthesis import singular, synthesize, visits


class FixedProfile:
    """Answers without data: what the test says."""

    def __init__(self, values=None, one_to_one=()):
        self._values = values or {}
        self._one_to_one = set(one_to_one)

    def prefetch(self):
        pass

    def binary(self, entity):
        return frozenset()

    def values(self, entity, column):
        return self._values.get(f"{entity}.{column}", [])

    def one_to_one(self, edge):
        return edge.label in self._one_to_one

    def extent(self, entity, column):
        raise AssertionError("no dates here")


def graph(spark, tables, edges, config=None, **profile):
    es = EntitySet(config)
    for name, columns in tables.items():
        df = spark.createDataFrame([], columns)
        es.add_entity(name, df, df.columns[0])
    for edge in edges:
        es.add_relationship(*edge)
    es.profile = FixedProfile(**profile)
    return es


def names(made, entity):
    return [f.name for f in made.of(entity)]


@pytest.fixture
def chain(spark):
    tables = {
        "a": "a_id int, va double",
        "b": "b_id int, a_id int, vb double",
        "c": "c_id int, b_id int, vc double",
        "d": "d_id int, c_id int, vd double",
        "e": "e_id int, d_id int, ve double",
    }
    edges = [("b", "a_id", "a"), ("c", "b_id", "b"), ("d", "c_id", "c"), ("e", "d_id", "d")]
    return graph(spark, tables, edges)


def test_lineage_limit(chain):
    made = names(synthesize(chain, "a"), "a")
    assert "COUNT(b)" in made
    assert "sum(b.sum(c.sum(d.sum(e.ve))))" not in made
    assert "sum(b.sum(c.sum(d.vd)))" in made
    assert "avg(b.sum(c.COUNT(d)))" in made
    assert all(len(f.path) <= 4 for f in synthesize(chain, "a").of("a"))


def test_forbidden_combinations(chain):
    made = set(names(synthesize(chain, "a"), "a"))
    for outer, function in AGGREGATES.items():
        for inner in function.not_over:
            assert f"{outer}(b.{inner}(c.vc))" not in made
            assert f"{outer}(b.avg(c.{inner}(d.vd)))" not in made
    assert {"avg(b.max(c.vc))", "max(b.max(c.vc))", "min(b.min(c.vc))", "std(b.sum(c.vc))"} <= made


def test_order_of_functions(chain):
    own = [n for n in names(synthesize(chain, "d"), "d") if n.endswith("(e.ve)") or n == "COUNT(e)"]
    assert own == ["COUNT(e)", "sum(e.ve)", "avg(e.ve)", "max(e.ve)", "std(e.ve)", "min(e.ve)"]


def test_visiting_order(chain):
    steps = list(visits(chain, "c"))
    assert [s for s in steps if s[0] == "agg"] == [
        ("agg", "e", "d"), ("agg", "d", "c"), ("agg", "c", None), ("agg", "b", "c"), ("agg", "a", "b"),
    ]
    assert steps[-1] == ("flat", "c", None)


def test_cycle_ends(spark):
    tables = {"a": "a_id int, c_ref int, x double", "b": "b_id int, a_ref int", "c": "c_id int, b_ref int"}
    es = graph(spark, tables, [("b", "a_ref", "a"), ("c", "b_ref", "b"), ("a", "c_ref", "c")])
    made = names(synthesize(es, "a"), "a")
    assert "COUNT(b)" in made and "c_id.COUNT(a)" in made


def test_lookup_names_and_keys(spark):
    tables = {"Orders": "id int, CustomerID int", "Customers": "CustomerID int, City string, Age int"}
    es = graph(spark, tables, [("Orders", "CustomerID", "Customers")])
    made = names(synthesize(es, "Orders"), "Orders")
    assert "Customer.City" in made and "Customer.avg(Orders.Age)" not in made
    assert not [n for n in made if n.endswith("CustomerID") and n != "CustomerID"]


@pytest.mark.parametrize(
    ("plural", "one"),
    [("Categories", "Category"), ("Boxes", "Box"), ("Customers", "Customer"), ("Class", "Class"), ("Status", "Status")],
)
def test_singular(plural, one):
    assert singular(plural) == one


def test_two_keys_to_one_parent_and_self_reference(spark):
    tables = {"address": "address_id int, zip int", "trip": "trip_id int, start int, stop int, km double"}
    es = graph(spark, tables, [("trip", "start", "address"), ("trip", "stop", "address")])
    assert {"start.zip", "stop.zip"} <= set(names(synthesize(es, "trip"), "trip"))
    assert {"COUNT(start)", "COUNT(stop)", "sum(stop.km)"} <= set(names(synthesize(es, "address"), "address"))
    staff = graph(spark, {"staff": "staff_id int, boss int, pay double"}, [("staff", "boss", "staff")])
    made = names(synthesize(staff, "staff"), "staff")
    assert {"COUNT(boss)", "max(boss.pay)"} <= set(made)
    assert "sum(boss.sum(boss.pay))" not in made and "staff_id.pay" not in made


SHOP = {
    "Outcomes": "id int, user_id int, merchant_id int, label int",
    "Users": "user_id int, age_range int",
    "Merchants": "merchant_id int",
    "Behaviors": "bid int, user_id int, action_id int, item_id int, merchant_id int",
    "Actions": "action_id int, name string",
    "Items": "item_id int",
}
SHOP_EDGES = [
    ("Outcomes", "user_id", "Users"), ("Outcomes", "merchant_id", "Merchants"), ("Behaviors", "user_id", "Users"),
    ("Behaviors", "action_id", "Actions"), ("Behaviors", "item_id", "Items"), ("Behaviors", "merchant_id", "Merchants"),
]
FILTER = {"categorical": True, "numeric": False, "categorical_filter": True}


@pytest.fixture
def shop(spark):
    config = {
        "entities": {
            "Users": {"feature_metadata": {"age_range": FILTER}},
            "Actions": {"feature_metadata": {"name": FILTER}},
            "Outcomes": {"feature_metadata": {"label": FILTER}},
        }
    }
    values = {"Users.age_range": [1, 2], "Actions.name": ["click", "purchase"], "Outcomes.label": [0, 1]}
    return graph(spark, SHOP, SHOP_EDGES, config, values=values)


def test_stacks_through_many_to_many(shop):
    made = synthesize(shop, "Outcomes")
    have = set(names(made, "Outcomes"))
    assert {
        "User.age_range",
        "Merchant.COUNT(Behaviors)",
        "Merchant.COUNT(Behaviors[Actions.name=click])",
        "Merchant.COUNT(Behaviors[Users.age_range=2])",
        "Merchant.sum(Behaviors.User.COUNT(Outcomes))",
        "Merchant.sum(Behaviors.Action.COUNT(Behaviors[Users.age_range=1]))",
        "User.max(Behaviors.Merchant.COUNT(Behaviors[Actions.name=purchase]))",
    } <= have
    assert "User.COUNT(Behaviors[Users.age_range=1])" not in have
    assert max(len(f.path) for f in made.of("Outcomes")) == 4


def test_label_leaks_are_left_out(shop):
    made = synthesize(shop, "Outcomes")
    label = made.features["Outcomes"]["label"]
    everything = predictable_features(made.of("Outcomes"))
    guarded = predictable_features(made.of("Outcomes"), label="Outcomes.label")
    dropped = {f.name for f in everything} - {f.name for f in guarded}
    assert "User.COUNT(Outcomes[Outcomes.label=1])" in dropped
    assert all("label=" in n for n in dropped)
    assert label not in candidate_features(made.of("Outcomes"), label)
    without = predictable_features(made.of("Outcomes"), ["Merchants"])
    assert without and not any("Merchant" in f.name for f in without)


def test_excluded_entities_are_left_out_by_default(spark):
    config = {"entities": {"Outcomes": {"excluded_predict_entities": ["Merchants"]}}}
    made = synthesize(graph(spark, SHOP, SHOP_EDGES, config, one_to_one=["Outcomes.user_id->Users.user_id"]), "Outcomes")
    assert any("Merchant" in f.name for f in made.of("Outcomes"))
    kept = made.predictable("Outcomes")
    assert kept and not any("Merchants" in f.entities for f in kept)


def test_config_of_aggregates(spark, shop):
    config = {"entities": {"Users": {"excluded_agg_entities": ["Outcomes"]}}}
    es = graph(spark, SHOP, SHOP_EDGES, config, one_to_one=["Outcomes.user_id->Users.user_id"])
    assert not [n for n in names(synthesize(es, "Users"), "Users") if "COUNT(Outcomes" in n and "." not in n.split("COUNT(Outcomes")[0]]


def test_one_to_one_children_are_copied(spark):
    tables = {"Projects": "pid int, cost double", "Essays": "pid int, words int"}
    es = graph(spark, tables, [("Essays", "pid", "Projects")], one_to_one=["Essays.pid->Projects.pid"])
    made = synthesize(es, "Projects")
    assert names(made, "Projects") == ["pid", "cost", "Essay.words"]
    assert "Project.Essay.words" not in names(synthesize(es, "Essays"), "Essays")


def test_training_filter_and_ignored_columns(spark):
    tables = {"u": "u_id int", "log": "l_id int, u_id int, test int, v double, w double"}
    config = {
        "entities": {
            "log": {"feature_metadata": {"test": {"ignore": True}}, "train_filter": [["test", "=", 0], ["w", ">", 1]]}
        }
    }
    es = graph(spark, tables, [("log", "u_id", "u")], config)
    made = synthesize(es, "u")
    assert {"COUNT(log[log.w>1])", "sum(log.v[log.w>1])"} <= set(names(made, "u"))
    assert not [n for n in names(made, "u") if "test" in n or "sum(log.w" in n]


def test_filters_on_derived_columns(spark):
    tables = {"u": "u_id int", "s": "s_id int, u_id int, k int", "x": "x_id int, s_id int, v double"}
    base = {"entities": {"s": {"train_filter": [["k", "=", 1]]}}}
    edges = [("s", "u_id", "u"), ("x", "s_id", "s")]
    one = names(synthesize(graph(spark, tables, edges, base), "u"), "u")
    assert not [n for n in one if n.startswith("sum(s.sum(x.v)")]
    two = names(synthesize(graph(spark, tables, edges, {**base, "max_categorical_filter": 2}), "u"), "u")
    assert "sum(s.sum(x.v)[s.k=1])" in two


def _sales(spark, config=None):
    es = EntitySet(config)
    es.add_entity("n", spark.createDataFrame([(1, "x"), (2, "y")], "nk int, nm string"), "nk")
    es.add_entity("c", spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "ck int, nk int"), "ck")
    es.add_entity(
        "o", spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, 2, 1.0), (4, None, 9.0)], "ok int, ck int, p double"), "ok"
    )
    es.add_entity("l", spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0), (9, 1.0)], "ok int, q double"))
    return es.add_relationship("c", "nk", "n").add_relationship("o", "ck", "c").add_relationship("l", "ok", "o")


def test_values_follow_the_lineage(spark):
    """Every numeric feature equals its last step applied to the column it came from."""
    made = synthesize(_sales(spark), "c")
    features = [f for f in made.of("c") if f.path and f.kind == "agg"]
    matrix = {r.ck: r for r in feature_matrix(made, "c", features).collect()}
    assert len(features) > 30
    for f in features:
        child = feature_matrix(made, f.edge.child, [f.source]) if not f.source.key else made.es[f.edge.child].df
        orders = made.es["o"].df.select("ok", "ck")
        if f.edge.child == "o" and "ck" not in child.columns:
            child = child.join(orders, "ok")
        expected = child.where(F.col("ck").isNotNull()).groupBy("ck").agg(
            AGGREGATES[f.function].build(F.col(f.source.column)).alias("v")
        )
        want = {r.ck: r.v for r in expected.collect()}
        for key, row in matrix.items():
            assert row[f.column] == pytest.approx(want.get(key)), f.name


def test_all_features_together_equal_each_alone(spark):
    made = synthesize(_sales(spark), "o")
    features = [f for f in made.of("o") if not f.key and f.path]
    together = {r.ok: r for r in feature_matrix(made, "o").collect()}
    assert len(together) == 4
    for f in features[:: max(1, len(features) // 12)]:
        for r in feature_matrix(made, "o", [f]).collect():
            assert r[f.column] == pytest.approx(together[r.ok][f.column]), f.name


def test_results_do_not_depend_on_broadcast(no_broadcast):
    made = synthesize(_sales(no_broadcast), "o")
    matrix = feature_matrix(made, "o")
    got = rows(matrix.select("ok", "c_n_nm", "c_n_count_c", "c_count_o", "sum_l_q"), "ok")
    assert got == [(1, "x", 2, 2, 5.0), (2, "x", 2, 2, 4.0), (3, "x", 2, 1, None), (4, None, None, None, None)]


def test_each_edge_is_aggregated_once_per_frame(spark):
    """All features of an edge share one aggregate, however many there are."""
    made = synthesize(_sales(spark), "o")
    features = [f for f in made.of("o") if f.kind == "agg"]
    plan = feature_matrix(made, "o", features)._jdf.queryExecution().optimizedPlan().toString()
    assert len(features) == 6 and plan.count("Aggregate") == 1


def test_catalog(spark):
    made = synthesize(_sales(spark), "c")
    catalog = catalog_frame(spark, made.of("c"))
    row = catalog.where("name = 'sum(o.sum(l.q))'").first()
    assert (row.column, row.numeric, [s.function for s in row.path]) == ("sum_o_sum_l_q", True, ["sum", "sum"])
    listed = [r.name for r in catalog.collect()]
    assert listed == sorted(listed) and len({r.column for r in catalog.collect()}) == len(listed)
