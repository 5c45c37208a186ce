"""Structured Streaming: rules over lines as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditloom.operators.totals import signed_lines, summed


def running_balances(lines: DataFrame) -> DataFrame:
    """Balances of accounts so far; for update or complete mode."""
    return signed_lines(lines).groupBy("account_id").agg(summed(F.col("signed_amount")).alias("balance"), F.count("*").alias("lines"))


def windowed_totals(lines: DataFrame, time: str, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """Totals of either side by window of event time; state is dropped once the watermark has passed."""
    rows = signed_lines(lines.withWatermark(time, late)).groupBy(F.window(time, every))
    return rows.agg(summed(F.col("debit")).alias("total_debit"), summed(F.col("credit")).alias("total_credit")).select(F.col("window.start").alias("start"), "total_debit", "total_credit")


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def each_batch(rows: DataFrame, rule: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs a rule of batch DataFrames on each micro-batch and appends what it finds; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        rule(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
