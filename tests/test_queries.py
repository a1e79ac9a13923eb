"""Every registered query of the engine gives the rows of its SQL."""

from pathlib import Path

import duckdb
import pytest

from larkspur import queries
from larkspur.engine import Engine
from larkspur.queries_api import API

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


QUERIES = queries.QUERIES | {name: run for name, (run, _) in API.items()}
SQL = queries.SQL | {name: same for name, (_, same) in API.items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = cursor.fetchall()
    order = [got.columns.index(n) for n in names]
    assert sorted(map(repr, (tuple(r[k] for k in order) for r in got.collect()))) == sorted(map(repr, want))


def test_filters_reach_the_scan(spark):
    plan = queries.CASES["scan_project"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "c_name" in plan and "c_mktsegment" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["json_objects", "prepared_rebind", "prepared_statement", "query_rows", "query_values"])
def test_results_pass_the_driver_by(spark, monkeypatch, name):
    """Queries whose results grow with the tables don't gather them on the driver."""
    monkeypatch.setattr(Engine, "query", None)
    assert QUERIES[name](spark, SF).count() > 0
