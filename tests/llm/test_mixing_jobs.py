"""Raking: what it asks of the driver, and the same weights for few cells and for many."""

import pytest
from pyspark.sql import functions as F

from auditloom.llm import mixing


@pytest.fixture
def cells(spark):
    rows = [(f"s{i % 5}", f"l{i % 3}", f"t{i % 4}", (i * 37) % 101 + 1) for i in range(60)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def goals(cells):
    return {d: mixing.tempered(cells, d) for d in mixing.DIMENSIONS}


def weights(rows):
    return {tuple(r[d] for d in mixing.DIMENSIONS): r["weight"] for r in rows.collect()}


def test_sweeps_run_few_jobs(spark, cells):
    """A sweep is no query of its own: shuffles, broadcasts and threads of its jobs filled the driver's memory."""
    context = spark.sparkContext
    jobs = {}
    for sweeps in (1, 11):
        context.setJobGroup(f"rake-{sweeps}", "")
        with pytest.warns(UserWarning, match="did not converge"):
            mixing.rake(cells, goals(cells), close=-1.0, sweeps=sweeps)
        jobs[sweeps] = len(context.statusTracker().getJobIdsForGroup(f"rake-{sweeps}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[11] - jobs[1] <= 10


@pytest.mark.parametrize("tuning", [{}, {"close": 0.05}, {"close": 1e-9, "sweeps": 50}])
def test_few_cells_and_many_have_the_same_weights(cells, monkeypatch, tuning):
    """Sweeps that run together end at the same sweep as those that run one by one."""
    few = weights(mixing.rake(cells, goals(cells), **tuning))
    monkeypatch.setattr(mixing, "FEW", 0)
    many = weights(mixing.rake(cells, goals(cells), **tuning))
    assert few.keys() == many.keys()
    assert all(few[k] == pytest.approx(many[k], rel=1e-12) for k in few)


def test_no_cells(spark, cells):
    assert weights(mixing.rake(cells.filter(F.lit(False)), goals(cells))) == {}
