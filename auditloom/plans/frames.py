"""A ledger as DataFrames, and the adapter that lays one over the order tables.

The rules read these frames only, so a parsed audit file and a table source run the same plans. Frames are lazy: what a rule
does not read is not scanned, and Catalyst prunes and pushes into the Parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"


@dataclass(frozen=True)
class Ledger:
    header: DataFrame  # fiscal_year, start_date, end_date; of files also file, ord
    accounts: DataFrame  # id, description, account_type, rgs_raw
    relations: DataFrame  # id, name, relation_type, balance
    vat_codes: DataFrame  # id, payable_account_id, receivable_account_id
    periods: DataFrame  # key, start_date, end_date
    journals: DataFrame  # id, journal_type, offset_account_id
    transactions: DataFrame  # tx, journal_id, number, period_key, date, relation_id, declared
    lines: DataFrame  # tx, number, account_id, amount, side, vat_code, vat_percentage, effective_date


def money(column: str) -> Column:
    return F.col(column).cast(MONEY)


def part_of(amount: str, percentage: str) -> Column:
    """A percentage of an amount, rounded half up to cents; decimals are multiplied, as a division would leave exactness."""
    return F.round(F.col(amount) * F.col(percentage) * F.lit("0.01").cast("decimal(3,2)"), 2).cast(MONEY)


def from_orders(spark: SparkSession, folder: str) -> Ledger:
    """The single-entry ledger of the order tables: orders are transactions, order lines are lines."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    part, customer, orders, lineitem = read("part"), read("customer"), read("orders"), read("lineitem")
    text = lambda c: F.col(c).cast("string")
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.element_at(F.create_map(*[F.lit(x) for x in "1B2S3P4M5O"]), first)
    return Ledger(
        header=spark.createDataFrame([("1997", "1997-01-01", "1997-12-31")], "fiscal_year string, s string, e string").select("fiscal_year", F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date")),
        accounts=part.filter("p_size <= 40").select(text("p_partkey").alias("id"), F.col("p_name").alias("description"), F.col("p_type").alias("account_type"), F.col("p_brand").alias("rgs_raw")),
        relations=customer.filter("c_acctbal >= 0").select(text("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("relation_type"), money("c_acctbal").alias("balance")),
        vat_codes=spark.createDataFrame([("A", "1", "2"), ("N", "3", "x9")], "id string, payable_account_id string, receivable_account_id string"),
        periods=spark.range(1, 12).select(text("id").alias("key"), F.make_date(F.lit(1997), F.col("id").cast("int"), F.lit(1)).alias("start_date")).withColumn("end_date", F.last_day("start_date")),
        journals=orders.select("o_orderpriority").distinct().select(F.col("o_orderpriority").alias("id"), kind.alias("journal_type"), F.when(first == "4", "x4").otherwise(first).alias("offset_account_id")),
        transactions=orders.select(
            F.col("o_orderkey").alias("tx"), F.col("o_orderpriority").alias("journal_id"), text("o_orderkey").alias("number"), F.month("o_orderdate").cast("string").alias("period_key"),
            F.col("o_orderdate").cast("date").alias("date"), text("o_custkey").alias("relation_id"), money("o_totalprice").alias("declared"),
        ),
        lines=lineitem.select(
            F.col("l_orderkey").alias("tx"), text("l_linenumber").alias("number"), text("l_partkey").alias("account_id"), money("l_extendedprice").alias("amount"),
            F.when(F.col("l_linestatus") == "F", "D").otherwise("C").alias("side"), F.col("l_returnflag").alias("vat_code"),
            (F.col("l_tax").cast("decimal(8,3)") * 100).cast("decimal(8,3)").alias("vat_percentage"), F.col("l_shipdate").cast("date").alias("effective_date"), F.col("l_suppkey").alias("supplier"),
        ),
    )


def double_entry(ledger: Ledger) -> DataFrame:
    """Lines of the balanced ledger: each line becomes a debit of net and tax, and a credit of either."""
    tax = part_of("amount", "vat_percentage")
    parts = lambda *rows: F.explode(F.array(*[F.struct(F.lit(a).alias("account_id"), F.lit(s).alias("side"), v.cast(MONEY).alias("amount")) for a, s, v in rows]))
    rows = ledger.lines.withColumn("tax", tax)
    return rows.select("tx", "number", parts(("1300", "D", F.col("amount") + F.col("tax")), ("8000", "C", F.col("amount")), ("1800", "C", F.col("tax"))).alias("x")).select("tx", "number", "x.*")


#: The same ledger as SQL common table expressions.
SQL = """
header as (select '1997' fiscal_year, date '1997-01-01' start_date, date '1997-12-31' end_date),
accounts as (select cast(p_partkey as varchar) id, p_name description, p_type account_type, p_brand rgs_raw from part where p_size <= 40),
relations as (select cast(c_custkey as varchar) id, c_name "name", c_mktsegment relation_type, cast(c_acctbal as decimal(20,2)) balance from customer where c_acctbal >= 0),
vat_codes as (select * from (values ('A', '1', '2'), ('N', '3', 'x9')) v(id, payable_account_id, receivable_account_id)),
periods as (select cast(m as varchar) key, make_date(1997, m, 1) start_date, last_day(make_date(1997, m, 1)) end_date from range(1, 12) r(m)),
journals as (select distinct o_orderpriority id, case left(o_orderpriority, 1) when '1' then 'B' when '2' then 'S' when '3' then 'P' when '4' then 'M' when '5' then 'O' end journal_type,
  case left(o_orderpriority, 1) when '4' then 'x4' else left(o_orderpriority, 1) end offset_account_id from orders),
transactions as (select o_orderkey tx, o_orderpriority journal_id, cast(o_orderkey as varchar) number, cast(month(o_orderdate) as varchar) period_key,
  cast(o_orderdate as date) "date", cast(o_custkey as varchar) relation_id, cast(o_totalprice as decimal(20,2)) declared from orders),
lines as (select l_orderkey tx, cast(l_linenumber as varchar) number, cast(l_partkey as varchar) account_id, cast(l_extendedprice as decimal(20,2)) amount,
  case l_linestatus when 'F' then 'D' else 'C' end side, l_returnflag vat_code, cast(cast(l_tax as decimal(8,3)) * 100 as decimal(8,3)) vat_percentage,
  cast(l_shipdate as date) effective_date, l_suppkey supplier from lineitem),
double_lines as (select tx, number, unnest([{'a': '1300', 's': 'D', 'v': amount + tax}, {'a': '8000', 's': 'C', 'v': cast(amount as decimal(21,2))}, {'a': '1800', 's': 'C', 'v': cast(tax as decimal(21,2))}]) x
  from (select *, cast(round(amount * vat_percentage * 0.01, 2) as decimal(20,2)) tax from (select tx, number, amount, vat_percentage from lines)))
"""
