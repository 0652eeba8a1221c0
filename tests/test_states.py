"""Stored states, and medians of groups too large to be ordered by one task."""

from __future__ import annotations

import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from relloom.functions.predicates import Predicate
from relloom.operators.aggregate import AggSpec, aggregate
from relloom.operators.ordered import group_median
from relloom.operators.states import append_state, compact, from_state, load_state

SPECS = [AggSpec("n", "COUNT"), *[AggSpec(f, f, "v") for f in ("sum", "avg", "max", "std", "min")]]


def _batches(spark):
    """Keys in one batch or all, keys of NULL values only, NULL keys, a third of the rows on one key."""
    draw = random.Random(3)
    made = []
    for number in range(4):
        data = [(draw.choice([7, 7, draw.randrange(20), None]), 1e6 + draw.gauss(0, 1)) for _ in range(200)]
        data += [(100 + number, None), (200, None), (300 + number, 5.0)]
        made.append(spark.createDataFrame(data, "fk long, v double"))
    return made


def _close(have, want):
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        assert a[:2] == b[:2]
        assert [x is None for x in a] == [x is None for x in b]
        for x, y in zip(a[2:], b[2:], strict=True):
            assert y is None or x == pytest.approx(y, rel=1e-9, abs=1e-6)


def test_appended_batches_equal_a_fresh_build(spark, tmp_path):
    batches = _batches(spark)
    whole = batches[0]
    for number, batch in enumerate(batches):
        append_state(batch, "fk", ["v"], str(tmp_path / "s"), f"b{number}")
        whole = whole if number == 0 else whole.unionByName(batch)
    append_state(batches[2], "fk", ["v"], str(tmp_path / "s"), "b2")  # again, as after a failure
    want = rows(aggregate(whole, "fk", SPECS), "fk")
    _close(rows(from_state(load_state(spark, str(tmp_path / "s"), ["v"]), "fk", SPECS), "fk"), want)

    compact(spark, str(tmp_path / "s"), ["v"], str(tmp_path / "one"), "all")
    append_state(batches[0], "fk", ["v"], str(tmp_path / "one"), "more")
    want = rows(aggregate(whole.unionByName(batches[0]), "fk", SPECS), "fk")
    _close(rows(from_state(load_state(spark, str(tmp_path / "one"), ["v"]), "fk", SPECS), "fk"), want)


def test_states_of_empty_batches_and_what_they_lack(spark, tmp_path):
    empty = spark.createDataFrame([], "fk long, v double")
    append_state(empty, "fk", ["v"], str(tmp_path / "s"), "none")
    state = load_state(spark, str(tmp_path / "s"), ["v"])
    assert from_state(state, "fk", SPECS).count() == 0
    with pytest.raises(ValueError):
        from_state(state, "fk", [AggSpec("n", "COUNT", None, Predicate.of(("v", "=", 1)))])
    with pytest.raises(ValueError):
        append_state(empty, "fk", ["v"], str(tmp_path / "s"), "../b")


@pytest.mark.parametrize("kind", ["double", "long", "decimal(12,2)", "int"])
def test_medians_of_large_groups_are_narrowed(spark, kind):
    draw = random.Random(5)
    data = [(1, round(draw.lognormvariate(3, 3), 2)) for _ in range(3001)]  # odd, long tail
    data += [(2, float(n)) for n in range(2000)]  # even: the middle lies between two values
    data += [(3, 4.0)] * 1000 + [(3, float(n)) for n in range(900)]  # most on one value
    data += [(4, draw.choice([-1.0, 1.0]) * n) for n in range(40)]  # small
    data += [(5, None), (None, 3.0), (6, 2.5)]
    df = spark.createDataFrame(data, "g int, v double").withColumn("v", F.col("v").cast(kind))
    have = {g: float(m) for g, m in rows(group_median(df, "g", "v", "m", most=20), "g")}
    whole = {}
    for g, v in df.collect():
        if g is not None and v is not None:
            whole.setdefault(g, []).append(float(v))
    assert have == pytest.approx({g: statistics.median(v) for g, v in whole.items()}, abs=1e-9)
    assert have == {g: float(m) for g, m in rows(group_median(df, "g", "v", "m"), "g")}


def test_medians_without_rows_and_of_text_groups(no_broadcast):
    df = no_broadcast.createDataFrame([], "g string, v double")
    assert group_median(df, "g", "v").count() == 0
    df = no_broadcast.range(500).selectExpr("case when id % 3 = 0 then 'a' else concat('k', id % 5) end as g", "id as v")
    have = dict(rows(group_median(df, "g", "v", most=10), "g"))
    whole = {}
    for g, v in df.collect():
        whole.setdefault(g, []).append(v)
    assert have == {g: statistics.median(v) for g, v in whole.items()}
