"""Targets of a few cells: without small tables in the driver's memory, and the same as by joins."""

import pytest
from pyspark.sql import functions as F

from auditloom.llm import mixing


@pytest.fixture
def rows(spark):
    made = [(f"s{i % 5}", f"l{i % 3}", f"t{i % 4}", (i * 37) % 101 + 1) for i in range(60)]
    return spark.createDataFrame(made, "source string, lang string, topic string, n_tokens long")


def probabilities(cells):
    return {tuple(r[d] for d in mixing.DIMENSIONS): r["probability"] for r in cells.collect()}


def test_few_cells_need_no_broadcast(rows, monkeypatch):
    plans, durable = [], mixing.durable
    monkeypatch.setattr(mixing, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df))
    mixing.mixed_cells(rows)
    assert plans and not [p for p in plans if "Broadcast" in p or "Join" in p]


@pytest.mark.parametrize("given", [[], ["lang"]])
def test_targets_are_those_of_joins(spark, rows, monkeypatch, given):
    goal = spark.createDataFrame([("l0", 0.7), ("l1", 0.3), ("other", 0.4)], "lang string, target double")
    few = probabilities(mixing.mixed_cells(rows, {d: goal for d in given}))
    monkeypatch.setattr(mixing, "FEW", 0)
    many = probabilities(mixing.mixed_cells(rows, {d: goal for d in given}))
    assert len(few) == 60 and few.keys() == many.keys()
    assert all(few[k] == pytest.approx(many[k], rel=1e-12) for k in few)


@pytest.mark.parametrize("most", [0, 1000])
def test_no_tokens_at_all(rows, monkeypatch, most):
    monkeypatch.setattr(mixing, "FEW", most)
    assert set(probabilities(mixing.mixed_cells(rows.withColumn("n_tokens", F.lit(0).cast("long")))).values()) <= {0.0, None}
