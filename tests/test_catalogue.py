"""Every ledger query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from auditloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[k] for k in place)) for r in want.fetchall())


def test_findings_are_made_distinct_by_narrow_rows(spark):
    """No whole finding, with its message, is a key of an aggregate; the rules' largest keys are dealt to a fixed number of tasks."""
    from auditloom.plans import catalogue
    from auditloom.plans.frames import from_orders

    plan = catalogue.all_findings(from_orders(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert max(x.split("Aggregate [")[1].split("]")[0].count(",") for x in plan.splitlines() if "Aggregate [" in x) <= 1
    assert "RepartitionByExpression" in plan


def test_keys_of_findings_are_dealt_before_they_are_aggregated(spark):
    """A scan's task holds no table of its transactions: what is grouped by tx is dealt first, to parts of a fixed number."""
    from auditloom.operators import uniqueness
    from auditloom.plans import catalogue
    from auditloom.plans.frames import from_orders

    plan = catalogue.all_findings(from_orders(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    grouped = [k for k, x in enumerate(plan) if "Aggregate [tx" in x]
    assert len(grouped) == 6
    for k in grouped:
        below = next(x for x in plan[k + 1 :] if not any(step in x for step in ("Project [", "Filter (", "Join LeftAnti")))
        assert f", {uniqueness.SPREAD}" in below and "RepartitionByExpression [tx" in below, below
