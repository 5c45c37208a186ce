"""Checks of references between records: every lookup is an anti or left join on keys, without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undefined(rows: DataFrame, column: str, master: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose value is not null and not among the master's keys."""
    return rows.filter(F.col(column).isNotNull()).join(master.select(F.col(key).alias(column)), column, "left_anti")


def undefined_periods(transactions: DataFrame, periods: DataFrame, zero_is_period: bool = False) -> DataFrame:
    """Transactions whose period is neither a key nor, as a number, a period; period 0 is exempt unless asked for.

    Two anti joins in turn: a join on either condition would be a nested loop.
    """
    number = lambda c: F.col(c).try_cast("int").cast("string")
    rows = undefined(transactions, "period_key", periods, "key")
    rows = rows.withColumn("as_number", number("period_key"))
    numbers = periods.select(number("key").alias("as_number")).filter("as_number is not null")
    rows = rows.join(numbers, "as_number", "left_anti")
    return (rows if zero_is_period else rows.filter("coalesce(as_number, '') <> '0'")).drop("as_number")


def undefined_vat_accounts(vat_codes: DataFrame, accounts: DataFrame) -> DataFrame:
    """(id, which, account_id) of the payable and receivable accounts of VAT codes that no account defines."""
    sides = vat_codes.select("id", F.explode(F.array(*[F.struct(F.lit(w).alias("which"), F.col(f"{w}_account_id").alias("account_id")) for w in ("payable", "receivable")])).alias("x"))
    return undefined(sides.select("id", "x.*"), "account_id", accounts)


def unchecked(rows: DataFrame, columns: dict[str, DataFrame | None]) -> DataFrame:
    """(section, references) that can't be checked as their section is absent (None)."""
    counts = rows.agg(*[F.count(c).alias(c) for c in columns])
    absent = [c for c, master in columns.items() if master is None]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("references")) for c in absent])).alias("x")
    return counts.select(each).select("x.*").filter("references > 0")


def outside_period(transactions: DataFrame, periods: DataFrame) -> DataFrame:
    """Transactions dated outside their own period; periods without dates, and unknown ones, say nothing."""
    joined = transactions.join(periods.withColumnRenamed("key", "period_key"), "period_key")
    return joined.filter((F.col("date") < F.col("start_date")) | (F.col("date") > F.col("end_date")))
