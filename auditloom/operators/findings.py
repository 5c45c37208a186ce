"""Findings: one schema for all rules, and what a report makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "code string, severity int, message string, file string, line int, path string, value string"
# FIXED VALUES: severities, and the codes of the validation service's own rule set
ERROR, WARNING, INFO = 30, 20, 10
SERVICE = r"^(1[0-9]{3}|2[0-9]{3}|30(1[0-9]|2[01])|3040|50(0[4-9]|10)|600[1-3])$"

#: parts of a code's findings that are cut to a report's limit apart
SLOTS = 64


def finding(rows: DataFrame, code: str, severity: int, message: Column, *, file: Column | None = None, line: Column | None = None, path: Column | None = None, value: Column | None = None) -> DataFrame:
    """rows as findings; a value of more than 200 characters is cut."""
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    v = text(value)
    cut = F.when(F.length(v) > 200, F.concat(F.left(v, F.lit(200)), F.lit("…"))).otherwise(v)
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), text(file).alias("file"), at.alias("line"), text(path).alias("path"), cut.alias("value"))


def several(rows: DataFrame, rules: list[tuple], *, file: Column | None = None, line: Column | None = None, path: Column | None = None) -> DataFrame:
    """The findings of many rules (condition, code, severity, message, value or None) from one pass over rows."""
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")

    def one(condition: Column, code: str, severity: int, message: Column, value: Column | None) -> Column:
        v = text(value)
        cut = F.when(F.length(v) > 200, F.concat(F.left(v, F.lit(200)), F.lit("…"))).otherwise(v)
        return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), cut.alias("value")))

    each = F.explode(F.array_compact(F.array(*[one(*r) for r in rules]))).alias("x")
    at = F.lit(None).cast("int") if line is None else line.cast("int")
    return rows.select(each, text(file).alias("file"), at.alias("line"), text(path).alias("path")).select("x.code", "x.severity", "x.message", "file", "line", "path", "x.value")


def distinct(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["code", "file", "line", "path", "value", "message"])


def service_rules(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("code").rlike(SERVICE))


def overridden(findings: DataFrame, severities: dict[str, int | None]) -> DataFrame:
    """Severities set anew by code; None silences a code."""
    if not severities:
        return findings
    change = F.create_map(*[x for k, v in severities.items() for x in (F.lit(k), F.lit(v).cast("int"))])
    known = F.col("code").isin(list(severities))
    return findings.withColumn("severity", F.when(known, change[F.col("code")]).otherwise(F.col("severity"))).filter("severity is not null")


def limited(findings: DataFrame, per_code: int, order: list[str], total: int | None = None) -> DataFrame:
    """The first so many of each code, then of all; a feature of reports, counts are taken before it.

    A code's findings are dealt to SLOTS tasks, each of which keeps its first ones, so one task never meets more than SLOTS times
    per_code rows of a code however many there are; equal rows share a slot.
    """
    slot = F.pmod(F.xxhash64(*order), F.lit(SLOTS))
    nth = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    kept = findings.withColumn("__slot", slot).withColumn("nth", nth("code", "__slot")).filter(F.col("nth") <= per_code).drop("__slot")
    kept = kept.withColumn("nth", nth("code")).filter(F.col("nth") <= per_code)
    return kept if total is None else kept.orderBy("code", "nth").limit(total)


def by_code(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").alias("findings"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("findings"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: the number of findings, the worst severity, and whether there is no error."""
    worst = F.max("severity")
    return findings.agg(F.count("*").alias("findings"), worst.alias("max_severity"), F.coalesce(worst < ERROR, F.lit(True)).alias("ok"))
