"""The fixed tables of a ledger, and the policies for values that don't fit their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.codes import account_kind, journal_kind, relation_kind, rgs_code, rgs_extension, rgs_placeholder
from auditloom.functions.values import exact_or_null, half_even
from auditloom.operators.totals import SUM, signed_lines, transaction_totals
from auditloom.plans.frames import MONEY, Ledger, part_of

POLICIES = ("raise", "null", "round")


def narrowed(value: Column, policy: str, kind: str = MONEY) -> Column:
    """raise: an error on a value that does not fit exactly; null: drop it; round: half to even."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "round":
        return half_even(value, kind)
    fits = exact_or_null(value, kind)
    return fits if policy == "null" else F.when(value.isNull() | fits.isNotNull(), fits).otherwise(F.raise_error(F.lit("a value does not fit its column exactly")))


def accounts(ledger: Ledger) -> DataFrame:
    raw = F.col("rgs_raw")
    return ledger.accounts.select(
        "id", "description", "account_type", account_kind(F.col("account_type")).alias("account_kind"), "rgs_raw",
        rgs_code(raw).alias("rgs_code"), rgs_extension(raw).alias("rgs_extension"), F.coalesce(rgs_placeholder(raw), F.lit(False)).alias("rgs_placeholder"),
    )


def relations(ledger: Ledger) -> DataFrame:
    return ledger.relations.select("id", "name", "relation_type", relation_kind(F.col("relation_type")).alias("relation_kind"), F.col("balance").alias("opening_balance"))


def journals(ledger: Ledger) -> DataFrame:
    return ledger.journals.select("id", "journal_type", journal_kind(F.col("journal_type")).alias("journal_kind"), "offset_account_id")


def periods(ledger: Ledger) -> DataFrame:
    return ledger.periods.select("key", F.col("key").try_cast("bigint").alias("number"), "start_date", "end_date")


def transactions(ledger: Ledger) -> DataFrame:
    totals = transaction_totals(ledger.lines).select("tx", "line_count", "total_debit", "total_credit")
    rows = ledger.transactions.select("tx", "journal_id", "number", "period_key", F.col("period_key").try_cast("bigint").alias("period_number"), "date").join(totals, "tx", "left")
    zero = F.lit(0)
    return rows.withColumns({"line_count": F.coalesce("line_count", zero.cast("long")), **{c: F.coalesce(c, zero.cast(SUM)) for c in ("total_debit", "total_credit")}})


def lines(ledger: Ledger) -> DataFrame:
    heads = ledger.transactions.select("tx", "journal_id", "period_key", F.col("date").alias("transaction_date"), "relation_id")
    rows = signed_lines(ledger.lines).select("tx", "number", "account_id", "amount", "side", "signed_amount", "debit", "credit", "effective_date", "vat_code")
    return rows.join(heads, "tx")


def line_vat(ledger: Ledger) -> DataFrame:
    """VAT of lines: code, percentage, and the amount that the percentage makes of the line, on the line's side."""
    amount = part_of("amount", "vat_percentage")
    rows = ledger.lines.select("tx", "number", F.lit(0).cast("long").alias("index"), F.col("vat_code").alias("code"), F.col("vat_percentage").alias("percentage"), amount.alias("amount"), "side")
    return rows.withColumn("signed_amount", F.when(F.col("side") == "D", F.col("amount")).otherwise(-F.col("amount")))
