"""Every registered query with SQL gives the rows of that SQL."""

from __future__ import annotations

import pytest
from conftest import SF_DIR

from check import compare, connect
from relloom.workload import ORACLES, QUERIES

MODELS = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    assert compare(spark, db, SF_DIR, name) is None


@pytest.mark.parametrize("name", ["cluster_assign", "cluster_coordinates", "reduce_svd", "prediction_output"])
def test_one_row_per_entity(spark, db, name):
    got = QUERIES[name](spark, SF_DIR)
    if name == "prediction_output":
        want = "select count(*) from documents where doc_id not in (select doc_id from labels)"
    else:
        want = "select count(*) from embeddings"
    assert got.count() == db.execute(want).fetchone()[0]


def test_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
