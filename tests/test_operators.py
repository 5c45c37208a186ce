from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from auditloom.functions import values
from auditloom.operators import findings, references, tables, totals, uniqueness


def test_a_33_digit_amount_still_unbalances(spark):
    tiny = "0." + "0" * 32 + "1"
    rows = [(1, "D", "10.00"), (1, "C", "10.00"), (2, "D", "5"), (2, "C", "5"), (2, "D", tiny), (3, "D", "1" * 40), (3, "C", "1" * 40)]
    lines = spark.createDataFrame(rows, "tx long, side string, amount_text string")
    got = totals.exact_unbalanced(lines).collect()
    assert [(r.tx, r.written_debit, r.written_credit) for r in got] == [(2, "5." + "0" * 32 + "1", "5")]


def test_exact_sums_of_nothing(spark):
    assert totals.exact_unbalanced(spark.createDataFrame([], "tx long, side string, amount_text string")).count() == 0


def test_sign_policies_never_give_minus_zero(spark):
    df = spark.createDataFrame([("0.00", "C"), ("-5.00", "D"), ("5.00", "x"), ("5.00", None)], "a string, s string")
    for policy, want in (("flip", ["0.00", "-5.00", None, None]), ("abs", ["0.00", "5.00", None, None])):
        _, signed = values.sided(F.col("a").cast("decimal(20,2)"), F.col("s"), policy)
        assert [None if r[0] is None else str(r[0]) for r in df.select(signed).collect()] == want


@pytest.mark.parametrize("policy,want", [("null", [None, "1.23"]), ("round", ["1.22", "1.23"])])
def test_inexact_policies(spark, policy, want):
    df = spark.createDataFrame([("1.225",), ("1.230",)], "v string").select(F.col("v").cast("decimal(20,3)").alias("v"))
    assert [r[0] and str(r[0]) for r in df.select(tables.narrowed(F.col("v"), policy)).collect()] == want


def test_inexact_raises(spark):
    df = spark.createDataFrame([("1.225",)], "v string").select(F.col("v").cast("decimal(20,3)").alias("v"))
    with pytest.raises(PySparkException):
        df.select(tables.narrowed(F.col("v"), "raise")).collect()
    with pytest.raises(ValueError):
        tables.narrowed(F.col("v"), "guess")


def test_period_zero_is_exempt_unless_asked_for(spark):
    tx = spark.createDataFrame([(1, "01"), (2, "0"), (3, "13"), (4, None), (5, "x")], "tx long, period_key string")
    periods = spark.createDataFrame([("1",)], "key string")
    assert {r.tx for r in references.undefined_periods(tx, periods).collect()} == {3, 5}
    assert {r.tx for r in references.undefined_periods(tx, periods, True).collect()} == {2, 3, 5}


def test_later_and_first_are_parts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "id string, ord int")
    assert {r.ord for r in uniqueness.first_wins(df, ["id"], ["ord"]).collect()} == {1, 3, 5}
    assert {r.ord for r in uniqueness.later(df, ["id"], ["ord"]).collect()} == {2, 4}


def test_limits_do_not_change_the_verdict(spark):
    rows = spark.range(500).select(F.lit("XAF4001").alias("code"), F.lit(30).alias("severity"), F.col("id").cast("string").alias("message"))
    assert findings.limited(rows, 100, ["message"]).count() == 100
    assert findings.verdict(rows).first().asDict() == {"findings": 500, "max_severity": 30, "ok": False}
    assert findings.verdict(findings.overridden(rows, {"XAF4001": None})).first()["ok"] is True


def test_long_values_are_cut(spark):
    rows = spark.createDataFrame([("x" * 300,)], "v string")
    cut = findings.finding(rows, "XAF3014", 30, F.lit("too long"), value=F.col("v")).first()["value"]
    assert cut == "x" * 200 + "…"


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_islands_go_on_over_blocks(spark, size):
    r = random.Random(size)
    rows = [(f, k, r.choice(["a", "b", None]), r.choice([None, 1])) for f in ("x", "y", None) for k in sorted(r.sample(range(400), 120))]
    want, number, before = {}, {}, {}
    for f, k, a, b in rows:
        number[f] = number[f] + (before[f] != (a, b)) if f in number else 0
        before[f] = a, b
        want[f, k] = number[f]
    df = spark.createDataFrame(rows, "file string, ord long, a string, b int").repartition(5).withColumns({c: F.lit("clash") for c in ("first", "last", "changes", "border", "island")})
    got = uniqueness.islands(df, ["a", "b"], ["file"], ["ord"], F.floor(F.col("ord") / size))
    assert {(x.file, x.ord): x.island for x in got.collect()} == want and got.columns == df.columns
    assert uniqueness.islands(df.filter("false"), ["a", "b"], ["file"], ["ord"], F.floor(F.col("ord") / size)).count() == 0


def test_limits_of_a_code_with_most_findings(spark):
    rows = spark.range(20_000).selectExpr("if(id % 10 = 0, 'B', 'A') code", "cast((id * 7919) % 20000 as int) line", "'m' message", "cast(null as string) value")
    rows = rows.unionAll(rows.filter("line < 50"))
    got = findings.limited(rows, 70, ["line", "message", "value"]).collect()
    for code in "AB":
        lines = sorted(x.line for x in rows.filter(f"code = '{code}'").collect())[:70]
        assert sorted(x.line for x in got if x.code == code) == lines and sorted(x.nth for x in got if x.code == code) == list(range(1, 71))
