"""Every query with an SQL twin must agree with DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from gridloom.check import compare
from gridloom.plans import REGISTRY

from .conftest import SF

ORACLES = {name: q.oracle() for name, q in REGISTRY.items() if q.sql is not None}
#: plans that no longer show a nested loop or a cross product
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas")


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.queries())
    assert "e08_drought_metrics" in REGISTRY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in FORBIDDEN if p in plan]
    cur = duck.execute(ORACLES[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["l04_forest_probabilities", "f04_top_importances"])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
