"""Distinct counts without copies of rows, and mergeable sketches of them."""

from __future__ import annotations

from relloom.operators import profile


def _table(spark):
    return spark.range(5000).selectExpr(
        "id as a", "id % 40 as b", "if(id % 9 = 0, null, cast(id % 300 as string)) as c", "cast(id % 3 as double) as d",
        "cast(null as date) as e",
    )


COLUMNS = ["a", "b", "c", "d", "e"]
EXACT = {"a": 5000, "b": 40, "c": 300, "d": 3, "e": 0}


def test_exact_counts_do_not_copy_rows(spark):
    counts = profile.distinct_counts(_table(spark), COLUMNS)
    assert {r["column"]: r.n_distinct for r in counts.collect()} == EXACT
    assert "Expand" not in counts._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_parts_merge(spark):
    df = _table(spark)
    parts = [profile.distinct_sketches(df.where(f"a % 3 = {k}"), COLUMNS) for k in range(3)]
    merged = profile.merge_sketches(parts[0].unionAll(parts[1]).unionAll(parts[2]), COLUMNS)
    got = {r["column"]: r.n_distinct for r in profile.estimated_counts(merged, COLUMNS).collect()}
    assert all(abs(got[c] - n) <= 0.08 * n for c, n in EXACT.items())


def test_screening_counts_only_what_may_pass(spark, monkeypatch):
    counted = []
    real = profile.distinct_counts
    monkeypatch.setattr(profile, "distinct_counts", lambda df, columns: counted.extend(columns) or real(df, columns))
    got = {r["column"]: r.n_distinct for r in profile.few_valued(_table(spark), COLUMNS, 40).collect()}
    assert got == {"b": 40, "d": 3, "e": 0} and set(counted) == {"b", "d", "e"}
    assert profile.few_valued(_table(spark), ["a"], 40).count() == 0
