"""Checks against a release of the reference chart of accounts: a code table, renames, and prefixes as ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixes(codes: DataFrame, column: str = "code") -> DataFrame:
    """Adds a row for each proper prefix of the code, in column prefix."""
    c = F.col(column)
    inner = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda n: F.left(c, n))
    return codes.withColumn("prefix", F.explode(F.when(F.length(c) > 1, inner).otherwise(F.array().cast("array<string>"))))


def ancestors(codes: DataFrame, chart: DataFrame, column: str = "code") -> DataFrame:
    """(code, parent): the longest proper prefix that is a code; codes without any are left out."""
    distinct = codes.select(column).distinct()
    known = chart.select(F.col("code").alias("prefix")).distinct()
    return prefixes(distinct, column).join(known, "prefix").groupBy(column).agg(F.max_by("prefix", F.length("prefix")).alias("parent"))


def checked(refs: DataFrame, chart: DataFrame, renames: DataFrame) -> DataFrame:
    """refs (id, code) that a release does not have, that it renamed, or that are no account level: (id, code, finding, hint)."""
    rows = refs.filter("code is not null").join(chart.select("code", "level"), "code", "left")
    rows = rows.join(renames.select(F.col("old").alias("code"), "new"), "code", "left")
    rows = rows.join(ancestors(refs.filter("code is not null"), chart), "code", "left")
    known = F.col("level").isNotNull()
    code = F.when(known & ~F.col("level").isin(4, 5), "XAF8006").when(~known & F.col("new").isNotNull(), "XAF8004").when(~known, "XAF8003")
    hint = F.when(known, F.col("level").cast("string")).when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("parent"))
    return rows.select("id", "code", code.alias("finding"), hint.alias("hint")).filter("finding is not null")
