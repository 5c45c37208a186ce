"""Values that parsers must take, and those that they must refuse."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from auditloom.functions import values
from auditloom.operators import totals

D = Decimal
CASES = {
    "amount": (values.parse_amount, [("1.50", D("1.50")), (" +7. ", D(7)), ("-.5", D("-0.5")), ("1e3", None), ("12,345", None), ("--1", None), ("", None), (".", None), ("NaN", None), (None, None), (" 12 ", D(12)), ("1" * 20, D("1" * 20)), ("1" * 40, None)]),
    "int": (values.parse_int, [("12", 12), ("+012", 12), ("-3", -3), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("1.0", None), ("1_0", None), ("١", None), ("", None), (None, None)]),
    "double": (values.parse_double, [("1.5e2", D(150)), ("-2E-1", D("-0.2")), ("INF", None), ("NaN", None), ("1e401", None), ("1e", None), (".5", D("0.5")), ("0x1p3", None), (None, None)]),
    "date": (values.parse_date, [("2024-02-29", datetime.date(2024, 2, 29)), ("2023-02-29", None), ("2024-02-30", None), ("2024-1-1", None), ("2024-01-01Z", datetime.date(2024, 1, 1)), ("2024-01-01+14:00", datetime.date(2024, 1, 1)), ("2024-01-01+14:01", None), ("2024-01-01T00:00:00", None), ("", None), (None, None)]),
    "fixed amount": (values.parse_adf_amount, [("10.239,87", D("10239.87")), ("1023987", D("10239.87")), ("5,00-", D("-5.00")), ("-5,00", D("-5.00")), ("5,0", None), ("", None), ("abc", None), (None, None)]),
    "fixed date": (values.parse_adf_date, [("01-12-1999", datetime.date(1999, 12, 1)), ("01121999", datetime.date(1999, 12, 1)), ("31-02-1999", None), ("1-1-1999", None), ("", None), (None, None)]),
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_values(spark, kind):
    parse, cases = CASES[kind]
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "k int, text string")
    got = {r.k: r.v for r in df.select("k", parse(F.col("text")).alias("v")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_amounts_that_need_the_exact_adder(spark):
    cases = [("1.5", False), ("0." + "0" * 9 + "1", True), ("0." + "1" * 8 + "000", False), ("1" * 30, True), ("x", False)]
    df = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "k int, text string")
    got = {r.k: bool(r.v) for r in df.select("k", values.inexact(F.col("text")).alias("v")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_sides_and_what_a_plan_says_of_them(spark):
    """Sides with white space around them, in either case, count; no pattern is tried on a line, and a side is read a few times at most."""
    spaces = [chr(c) for c in range(0x3001) if chr(c) in values.SPACE]
    texts = ["D", "C", "d", " c　", " \tD\r\n", " C\u0085", "D C", "X", "", " ", None, "​D", *(f"{x}d{x}" for x in spaces)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, side string").withColumn("amount", F.lit(D("-1.50")))
    side, signed = values.sided(F.col("amount"), F.col("side"))
    pattern = r"^[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"
    want = F.upper(F.regexp_replace("side", pattern, ""))
    got = rows.select("k", side.alias("s"), signed.alias("v"), want.alias("w"))
    for r in got.collect():
        assert (r.s, r.v) == ((r.w, D("-1.50") if r.w == "D" else D("1.50")) if r.w in ("D", "C") else (None, None)), repr(texts[r.k])
    plan = totals.signed_lines(rows).filter("signed_amount is not null").select("signed_amount")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and plan.count("upper(") <= 4
