"""Exact sums: of transactions, files and opening balances, and what is declared of them."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal, MAX_EMAX, MIN_EMIN

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.values import sided, split

SUM = "decimal(38,2)"


def summed(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(SUM)


def signed_lines(lines: DataFrame, policy: str = "flip") -> DataFrame:
    """Adds signed_amount (debit-positive), debit and credit."""
    side, signed = sided(F.col("amount"), F.col("side"), policy)
    rows = lines.withColumns({"side": side, "signed_amount": signed})
    debit, credit = split(F.col("signed_amount"))
    return rows.withColumns({"debit": debit, "credit": credit})


def trial_balance(lines: DataFrame) -> DataFrame:
    rows = signed_lines(lines).groupBy("account_id")
    return rows.agg(summed(F.col("debit")).alias("debit"), summed(F.col("credit")).alias("credit"), summed(F.col("signed_amount")).alias("balance"))


def transaction_totals(lines: DataFrame) -> DataFrame:
    """Per transaction: lines, totals of either side, and whether they balance; a line without amount adds nothing."""
    rows = signed_lines(lines).groupBy("tx").agg(F.count("*").alias("line_count"), summed(F.col("debit")).alias("total_debit"), summed(F.col("credit")).alias("total_credit"))
    return rows.withColumn("balanced", F.col("total_debit") == F.col("total_credit"))


def written_totals(lines: DataFrame) -> DataFrame:
    """Per transaction: sums of the amounts as written, by side as written."""
    side = lambda s: summed(F.when(F.upper("side") == s, F.col("amount")))
    return lines.groupBy("tx").agg(side("D").alias("written_debit"), side("C").alias("written_credit"))


def unbalanced(lines: DataFrame) -> DataFrame:
    return written_totals(lines).filter("written_debit <> written_credit")


def declared_differs(transactions: DataFrame, lines: DataFrame) -> DataFrame:
    """Transactions whose declared total is not the sum of their lines; without lines the sum is 0."""
    sums = lines.groupBy("tx").agg(summed(F.col("amount")).alias("summed"))
    joined = transactions.select("tx", "declared").join(sums, "tx", "left").withColumn("summed", F.coalesce("summed", F.lit(0).cast(SUM)))
    return joined.filter(F.col("declared") != F.col("summed"))


def control_totals(lines: DataFrame) -> DataFrame:
    """One row: lines and sums of either side."""
    rows = signed_lines(lines)
    return rows.agg(F.count("*").alias("lines_count"), summed(F.col("debit")).alias("total_debit"), summed(F.col("credit")).alias("total_credit"))


def set_totals(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Declared totals of a set of files: the sum, or null where any part declares none."""
    return parts.agg(*[F.when(F.count("*") == F.count(c), F.sum(c)).alias(c) for c in columns])


EXACT = Context(prec=100_000, Emax=MAX_EMAX, Emin=MIN_EMIN)


def exact_unbalanced(lines: DataFrame) -> DataFrame:
    """(tx, written_debit, written_credit as text) of unbalanced transactions, for amounts of any number of digits.

    lines: tx, side, amount_text. Sums are formed by side and transaction; the digits don't fit a decimal column, so Arrow batches
    add them exactly: partial sums in each task first, then one row for each task, transaction and side.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, Decimal] = {}

        def rows() -> pa.RecordBatch:
            keys = list(sums)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.string()), pa.array([format(sums[k], "f") for k in keys], pa.string())], names=["tx", "side", "amount_text"])
            sums.clear()
            return out

        for batch in batches:
            for tx, side, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[tx, side] = EXACT.add(sums.get((tx, side), Decimal(0)), Decimal(text))
            if len(sums) > 100_000:
                yield rows()
        yield rows()

    schema = "tx long, side string, amount_text string"
    parts = lines.filter("side in ('D', 'C') and amount_text is not null").select("tx", "side", "amount_text").mapInArrow(partial, schema)
    whole = parts.repartition("tx").sortWithinPartitions("tx")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, out = None, {"D": Decimal(0), "C": Decimal(0)}, []
        last = False

        def settle() -> None:
            if last and sums["D"] != sums["C"]:
                out.append((now, format(sums["D"], "f"), format(sums["C"], "f")))

        for batch in batches:
            for tx, side, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not last or tx != now:
                    settle()
                    now, sums, last = tx, {"D": Decimal(0), "C": Decimal(0)}, True
                sums[side] = EXACT.add(sums[side], Decimal(text))
        settle()
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["tx", "written_debit", "written_credit"])

    return whole.mapInArrow(judge, "tx long, written_debit string, written_credit string")
