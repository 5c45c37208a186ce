"""All queries of the ledger operators, by name, each with the SQL it is held against.

Every query reads the whole of its tables through the ledger frames of auditloom.plans.frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import codes, values
from auditloom.operators import findings, references, rgs, structure, tables, totals, uniqueness
from auditloom.plans.frames import MONEY, SQL, Ledger, double_entry, from_orders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OPENING = "period_key in ('0', '00', '000') or kind = 'opening'"


def on_ledger(sql: str | None) -> Callable[[Callable[[Ledger], DataFrame]], Callable[[Ledger], DataFrame]]:
    """Registers a query over the ledger frames, under its function's name."""

    def register(make: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
        QUERIES[make.__name__] = lambda spark, folder: make(from_orders(spark, folder))
        if sql is not None:
            ORACLES[make.__name__] = f"with {SQL.strip()}{sql if sql.startswith(',') else ' ' + sql}"
        return make

    return register


def on_tables(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query over a session and a folder, under its function's name."""

    def register(make: Query) -> Query:
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return register


# ---- totals
SIDES = """sum(case side when 'D' then amount else -amount end)::decimal(38,2)"""
DEBIT = "coalesce(sum(case when (side = 'D' and amount > 0) or (side = 'C' and amount < 0) then abs(amount) else 0 end), 0)::decimal(38,2)"
CREDIT = "coalesce(sum(case when (side = 'C' and amount > 0) or (side = 'D' and amount < 0) then abs(amount) else 0 end), 0)::decimal(38,2)"


@on_ledger(f"select account_id, {DEBIT} debit, {CREDIT} credit, {SIDES} balance from lines group by 1")
def trial_balance(ledger: Ledger) -> DataFrame:
    return totals.trial_balance(ledger.lines)


@on_ledger(f"select tx, count(*) line_count, {DEBIT} total_debit, {CREDIT} total_credit, {DEBIT} = {CREDIT} balanced from lines group by 1")
def tx_totals(ledger: Ledger) -> DataFrame:
    return totals.transaction_totals(ledger.lines)


WRITTEN = "coalesce(sum(case when side = '{}' then amount end), 0)::decimal(38,2)"
UNBALANCED = f"select tx, {WRITTEN.format('D')} written_debit, {WRITTEN.format('C')} written_credit from {{}} group by 1 having {WRITTEN.format('D')} <> {WRITTEN.format('C')}"


@on_ledger(UNBALANCED.format("lines"))
def unbalanced_tx(ledger: Ledger) -> DataFrame:
    # a transaction has few lines: to add them up in the scan as well would hold wide sums of nearly all transactions there
    return totals.unbalanced(uniqueness.dealt(ledger.lines.select("tx", "side", "amount"), ["tx"]))


@on_ledger(UNBALANCED.format("(select tx, x.s side, x.v amount from double_lines)"))
def unbalanced_tx_double_entry(ledger: Ledger) -> DataFrame:
    return totals.unbalanced(double_entry(ledger))


@on_ledger("select x.a account_id, sum(case x.s when 'D' then x.v else -x.v end)::decimal(38,2) balance from double_lines group by 1")
def trial_balance_double_entry(ledger: Ledger) -> DataFrame:
    return totals.trial_balance(double_entry(ledger)).select("account_id", "balance")


@on_ledger(f"select count(*) lines_count, {DEBIT} total_debit, {CREDIT} total_credit from lines")
def control_totals(ledger: Ledger) -> DataFrame:
    return totals.control_totals(ledger.lines)


@on_ledger("""select t.tx, declared, coalesce(s, 0)::decimal(38,2) summed from transactions t left join (select tx, sum(amount)::decimal(38,2) s from lines group by 1) l on t.tx = l.tx
where declared <> coalesce(s, 0)""")
def declared_vs_sum(ledger: Ledger) -> DataFrame:
    return totals.declared_differs(ledger.transactions, ledger.lines)


@on_ledger("""select journal_id, sum(declared)::decimal(38,2) declared, case when count(*) = count(nullif(declared, 0)) then sum(declared) end::decimal(38,2) if_all from transactions group by 1""")
def declared_by_journal(ledger: Ledger) -> DataFrame:
    complete = F.when(F.count("*") == F.count(F.nullif("declared", F.lit(0))), F.sum("declared"))
    return ledger.transactions.groupBy("journal_id").agg(F.sum("declared").cast("decimal(38,2)").alias("declared"), complete.cast("decimal(38,2)").alias("if_all"))


@on_ledger(f"""select (select count(*) from transactions) transactions, (select count(*) from lines) lines, (select {DEBIT} from lines) debit, (select {CREDIT} from lines) credit""")
def info_summary(ledger: Ledger) -> DataFrame:
    sums = totals.control_totals(ledger.lines).select(F.col("lines_count").alias("lines"), F.col("total_debit").alias("debit"), F.col("total_credit").alias("credit"))
    return ledger.transactions.agg(F.count("*").alias("transactions")).crossJoin(sums)


@on_ledger(" union all ".join(f"select '{t}' section, count(*) n from {t}" for t in ("transactions", "lines", "accounts", "relations", "vat_codes", "periods", "journals")))
def stats(ledger: Ledger) -> DataFrame:
    parts = [getattr(ledger, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("section"), "n") for t in ("transactions", "lines", "accounts", "relations", "vat_codes", "periods", "journals")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@on_ledger("select count(distinct account_id) accounts_used from lines")
def accounts_used(ledger: Ledger) -> DataFrame:
    return ledger.lines.select("account_id").distinct().agg(F.count("*").alias("accounts_used"))


# ---- opening balance
def opening_lines(ledger: Ledger) -> DataFrame:
    kinds = tables.journals(ledger).select(F.col("id").alias("journal_id"), F.col("journal_kind").alias("kind"))
    heads = ledger.transactions.join(kinds, "journal_id", "left").filter(OPENING).select("tx", "journal_id")
    return totals.signed_lines(ledger.lines).join(heads, "tx")


OB = """ob as (select l.*, t.journal_id, case side when 'D' then amount else -amount end signed_amount from lines l join transactions t using (tx) where left(t.journal_id, 1) = '5' or period_key in ('0', '00', '000'))"""


@on_ledger(f", {OB} select tx, number, account_id, amount, side, signed_amount::decimal(20,2) signed_amount, journal_id from ob")
def ob_unified(ledger: Ledger) -> DataFrame:
    return opening_lines(ledger).select("tx", "number", "account_id", "amount", "side", F.col("signed_amount").cast(MONEY).alias("signed_amount"), "journal_id")


@on_ledger(f", {OB} select account_id, sum(signed_amount)::decimal(38,2) balance from ob group by 1")
def by_account_opening(ledger: Ledger) -> DataFrame:
    return opening_lines(ledger).filter("account_id is not null and signed_amount is not null").groupBy("account_id").agg(totals.summed(F.col("signed_amount")).alias("balance"))


@on_ledger(f", {OB} select count(*) lines_count, {DEBIT} total_debit, {CREDIT} total_credit, {DEBIT} = {CREDIT} balanced from ob")
def ob_totals(ledger: Ledger) -> DataFrame:
    return totals.control_totals(opening_lines(ledger)).withColumn("balanced", F.col("total_debit") == F.col("total_credit"))


@on_ledger(f", {OB} select case when count(*) = 0 then 'none' else 'transactions' end convention, count(*) lines_count from ob")
def ob_conventions(ledger: Ledger) -> DataFrame:
    count = F.count("*")
    return opening_lines(ledger).agg(F.when(count == 0, "none").otherwise("transactions").alias("convention"), count.alias("lines_count"))


# ---- references
@on_ledger("select tx, number, account_id from lines l where not exists (select 1 from accounts a where a.id = l.account_id)")
def undefined_accounts(ledger: Ledger) -> DataFrame:
    return references.undefined(ledger.lines.select("tx", "number", "account_id"), "account_id", ledger.accounts)


@on_ledger("select tx, relation_id from transactions t where not exists (select 1 from relations r where r.id = t.relation_id)")
def undefined_relations(ledger: Ledger) -> DataFrame:
    return references.undefined(ledger.transactions.select("tx", "relation_id"), "relation_id", ledger.relations)


@on_ledger("select tx, number, vat_code from lines l where vat_code is not null and not exists (select 1 from vat_codes v where v.id = l.vat_code)")
def undefined_vat(ledger: Ledger) -> DataFrame:
    return references.undefined(ledger.lines.select("tx", "number", "vat_code"), "vat_code", ledger.vat_codes)


@on_ledger("select tx, period_key from transactions t where not exists (select 1 from periods p where p.key = t.period_key or try_cast(p.key as int) = try_cast(t.period_key as int)) and try_cast(period_key as int) <> 0")
def undefined_periods(ledger: Ledger) -> DataFrame:
    return references.undefined_periods(ledger.transactions.select("tx", "period_key"), ledger.periods)


@on_ledger("select id, offset_account_id from journals j where not exists (select 1 from accounts a where a.id = j.offset_account_id)")
def offset_account_missing(ledger: Ledger) -> DataFrame:
    return references.undefined(ledger.journals.select("id", "offset_account_id"), "offset_account_id", ledger.accounts)


@on_ledger("""select id, which, account_id from (select id, 'payable' which, payable_account_id account_id from vat_codes union all select id, 'receivable', receivable_account_id from vat_codes) v
where account_id is not null and not exists (select 1 from accounts a where a.id = v.account_id)""")
def vat_account_missing(ledger: Ledger) -> DataFrame:
    return references.undefined_vat_accounts(ledger.vat_codes, ledger.accounts)


@on_ledger(f", {OB} select tx, number, account_id from ob where not exists (select 1 from accounts a where a.id = ob.account_id)")
def ob_account_missing(ledger: Ledger) -> DataFrame:
    return references.undefined(opening_lines(ledger).select("tx", "number", "account_id"), "account_id", ledger.accounts)


@on_ledger("select 'account_id' section, count(account_id) \"references\" from lines union all select 'vat_code', count(vat_code) from lines")
def unchecked_references(ledger: Ledger) -> DataFrame:
    return references.unchecked(ledger.lines, {"account_id": None, "vat_code": None})


# ---- uniqueness
@on_ledger("select tx, number, count(*) occurrences from lines group by 1, 2 having count(*) > 1")
def dup_line_numbers(ledger: Ledger) -> DataFrame:
    return uniqueness.duplicate_counts(ledger.lines, ["tx", "number"], rare=True)


@on_ledger("select tx, number, account_id, amount, nth::int nth from (select *, row_number() over (partition by tx, number order by account_id, amount, supplier, vat_code, effective_date) nth from lines) where nth > 1")
def later_line_numbers(ledger: Ledger) -> DataFrame:
    return uniqueness.later(ledger.lines, ["tx", "number"], ["account_id", "amount", "supplier", "vat_code", "effective_date"]).select("tx", "number", "account_id", "amount", "nth")


@on_ledger("select journal_id, number, count(*) occurrences from (select journal_id, right(number, 3) number from transactions) group by 1, 2 having count(*) > 1")
def dup_tx_numbers(ledger: Ledger) -> DataFrame:
    return uniqueness.duplicate_counts(ledger.transactions.select("journal_id", F.substring("number", -3, 3).alias("number")), ["journal_id", "number"])


@on_ledger("select description, id from (select description, id, row_number() over (partition by description order by id) n from accounts) where n = 1")
def dup_ids_first_wins(ledger: Ledger) -> DataFrame:
    return uniqueness.first_wins(ledger.accounts.select("description", "id"), ["description"], ["id"])


@on_ledger("""select id, rgs_raw, first_id from (select id, rgs_raw, first_value(id) over w first_id, row_number() over w n from accounts window w as (partition by rgs_raw order by id)) where n > 1""")
def dup_rgs(ledger: Ledger) -> DataFrame:
    return uniqueness.first_holder(ledger.accounts.select("id", "rgs_raw"), "rgs_raw", "id", ["id"])


@on_ledger("select journal_type, count(*) occurrences from (select left(id, 0) || 'J' journal_type from journals) group by 1 having count(*) > 1")
def dup_journals(ledger: Ledger) -> DataFrame:
    return uniqueness.duplicate_counts(ledger.journals.select(F.lit("J").alias("journal_type")), ["journal_type"])


@on_ledger(f", {OB} select number, count(*) occurrences from ob group by 1 having count(*) > 1")
def dup_ob_lines(ledger: Ledger) -> DataFrame:
    return uniqueness.duplicate_counts(opening_lines(ledger), ["number"])


@on_tables("""select a.c_nationkey from (select c_nationkey, min(c_name) n, max(c_acctbal) m from customer where c_mktsegment in ('AUTOMOBILE', 'BUILDING') group by 1) a
join (select c_nationkey, min(c_name) n, max(c_acctbal) m from customer where c_mktsegment not in ('AUTOMOBILE', 'BUILDING') group by 1) b using (c_nationkey) where a.n is distinct from b.n or a.m is distinct from b.m""")
def conflicting_master(spark: SparkSession, folder: str) -> DataFrame:
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    one = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING")
    file = lambda test: customer.filter(test).groupBy("c_nationkey").agg(F.min("c_name").alias("n"), F.max("c_acctbal").alias("m"))
    return uniqueness.conflicts(file(one), file(~one), "c_nationkey", ["n", "m"])


ISLANDS = """select journal_id, relation_id, tx, sum(starts) over (partition by relation_id order by "date", tx rows unbounded preceding)::bigint island from (select *, case when row_number() over w = 1 then 0
when journal_id is distinct from lag(journal_id) over w then 1 else 0 end starts from transactions window w as (partition by relation_id order by "date", tx))"""


@on_ledger(ISLANDS)
def adf_islands(ledger: Ledger) -> DataFrame:
    return uniqueness.islands(ledger.transactions, ["journal_id"], ["relation_id"], ["date", "tx"], F.unix_date("date").bitwiseAND(-1024)).select("journal_id", "relation_id", "tx", "island")


# ---- quality
@on_ledger("""select tx, "date" from transactions, header where "date" < start_date or "date" > end_date""")
def tx_outside_fy(ledger: Ledger) -> DataFrame:
    return ledger.transactions.crossJoin(F.broadcast(ledger.header)).filter("date < start_date or date > end_date").select("tx", "date")


@on_ledger("select count(*) outside from lines, header where effective_date < start_date or effective_date > end_date")
def eff_date_outside_fy_count(ledger: Ledger) -> DataFrame:
    return ledger.lines.crossJoin(F.broadcast(ledger.header)).filter("effective_date < start_date or effective_date > end_date").agg(F.count("*").alias("outside"))


@on_ledger("""select tx, period_key, "date" from transactions join periods on key = period_key where "date" < start_date or "date" > end_date""")
def tx_outside_period(ledger: Ledger) -> DataFrame:
    return references.outside_period(ledger.transactions, ledger.periods).select("tx", "period_key", "date")


@on_ledger("select fiscal_year, not (list_contains(regexp_extract_all(fiscal_year, '[0-9]{4}'), cast(year(start_date) as varchar))) mismatch from header")
def fiscal_year_mismatch(ledger: Ledger) -> DataFrame:
    years = F.regexp_extract_all("fiscal_year", F.lit("[0-9]{4}"), 0)
    return ledger.header.select("fiscal_year", (~F.array_contains(years, F.year("start_date").cast("string"))).alias("mismatch"))


@on_ledger("select tx, journal_id from transactions t where not exists (select 1 from lines l where l.tx = t.tx)")
def tx_without_lines(ledger: Ledger) -> DataFrame:
    # dealt alike to a fixed number of tasks: by their size on disk few would be left, and these sort all rows in memory
    dealt = lambda rows: uniqueness.dealt(rows, ["tx"])
    return dealt(ledger.transactions.select("tx", "journal_id")).join(dealt(ledger.lines.select("tx")), "tx", "left_anti")


@on_tables("select c_custkey, cast(c_acctbal as decimal(20,2)) amount from customer where c_acctbal < 0")
def negative_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", F.col("c_acctbal").cast(MONEY).alias("amount")).filter("amount < 0")


def signed_by(policy: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", F.col("c_acctbal").cast(MONEY).alias("amount"), F.when(F.col("c_nationkey") < 13, "d").otherwise("C").alias("side"))
        side, signed = values.sided(F.col("amount"), F.col("side"), policy)
        return rows.select("c_custkey", side.alias("side"), signed.cast(MONEY).alias("signed_amount"))

    return query


SIGNED = "select c_custkey, case when c_nationkey < 13 then 'D' else 'C' end side, (case when c_nationkey < 13 then 1 else -1 end * {}(cast(c_acctbal as decimal(20,2))))::decimal(20,2) signed_amount from customer"
QUERIES["sign_policy_flip"], ORACLES["sign_policy_flip"] = signed_by("flip"), SIGNED.format("")
QUERIES["sign_policy_abs"], ORACLES["sign_policy_abs"] = signed_by("abs"), SIGNED.format("abs")


@on_tables("select c_custkey, greatest(cast(c_acctbal as decimal(20,2)), 0)::decimal(20,2) debit, greatest(-cast(c_acctbal as decimal(20,2)), 0)::decimal(20,2) credit from customer")
def debit_credit_split(spark: SparkSession, folder: str) -> DataFrame:
    debit, credit = values.split(F.col("c_acctbal").cast(MONEY))
    return spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"))


@on_ledger("select id, relation_type from relations where upper(relation_type) not in ('B', 'C', 'S', 'O', 'D', 'F') and not regexp_matches(lower(relation_type), 'debiteur|klant|customer|afnemer|crediteur|leverancier|supplier|vendor|both|beide')")
def relation_type_unknown(ledger: Ledger) -> DataFrame:
    return tables.relations(ledger).filter("relation_kind = 'unknown'").select("id", "relation_type")


@on_ledger("select id, rgs_raw from accounts where not regexp_matches(rgs_raw, '^[BW]')")
def rgs_unrecognisable(ledger: Ledger) -> DataFrame:
    return tables.accounts(ledger).filter("rgs_code is null and not rgs_placeholder").select("id", "rgs_raw")


# ---- tables
@on_ledger("""select l.tx, l.number, account_id, amount, side, (case side when 'D' then amount else -amount end)::decimal(20,2) signed_amount, (case side when 'D' then greatest(amount, 0) else greatest(-amount, 0) end)::decimal(20,2) debit,
(case side when 'D' then greatest(-amount, 0) else greatest(amount, 0) end)::decimal(20,2) credit, effective_date, vat_code, journal_id, period_key, "date" transaction_date, relation_id from lines l join transactions using (tx)""")
def lines_table(ledger: Ledger) -> DataFrame:
    money = {c: F.col(c).cast(MONEY) for c in ("signed_amount", "debit", "credit")}
    return tables.lines(ledger).withColumns(money)


@on_ledger(f"""select t.tx, journal_id, number, period_key, try_cast(period_key as bigint) period_number, "date", coalesce(n, 0) line_count, coalesce(d, 0)::decimal(38,2) total_debit, coalesce(c, 0)::decimal(38,2) total_credit
from transactions t left join (select tx, count(*) n, {DEBIT} d, {CREDIT} c from lines group by 1) l using (tx)""")
def transactions_table(ledger: Ledger) -> DataFrame:
    return tables.transactions(ledger)


@on_ledger("""select tx, number, 0::bigint index, vat_code code, vat_percentage percentage, round(amount * vat_percentage * 0.01, 2)::decimal(20,2) amount, side,
((case side when 'D' then 1 else -1 end) * round(amount * vat_percentage * 0.01, 2))::decimal(20,2) signed_amount from lines""")
def line_vat_table(ledger: Ledger) -> DataFrame:
    return tables.line_vat(ledger).withColumn("signed_amount", F.col("signed_amount").cast(MONEY))


@on_ledger("""select id, description, account_type, 'unknown' account_kind, rgs_raw, case when regexp_matches(rgs_raw, '^[BW]') then regexp_extract(rgs_raw, '^([BW](?:[A-Z][A-Za-z0-9]{2})*)', 1) end rgs_code,
case when regexp_matches(rgs_raw, '^[BW]') then nullif(trim(regexp_replace(rgs_raw, '^([BW](?:[A-Z][A-Za-z0-9]{2})*)', ''), ' .-_'), '') end rgs_extension, false rgs_placeholder from accounts""")
def accounts_table(ledger: Ledger) -> DataFrame:
    return tables.accounts(ledger)


@on_ledger("select id, \"name\", relation_type, 'unknown' relation_kind, balance opening_balance from relations")
def relations_table(ledger: Ledger) -> DataFrame:
    return tables.relations(ledger)


@on_ledger("select id, journal_type, case journal_type when 'B' then 'bank' when 'S' then 'sales' when 'P' then 'purchases' when 'M' then 'memo' when 'O' then 'opening' end journal_kind, offset_account_id from journals")
def journals_table(ledger: Ledger) -> DataFrame:
    return tables.journals(ledger)


@on_ledger("select key, cast(key as bigint) number, start_date, end_date from periods")
def periods_table(ledger: Ledger) -> DataFrame:
    return tables.periods(ledger)


@on_ledger("select * from vat_codes")
def vat_codes_table(ledger: Ledger) -> DataFrame:
    return ledger.vat_codes


@on_ledger("select * from header")
def header_table(ledger: Ledger) -> DataFrame:
    return ledger.header


# ---- values, over literal texts
def over(texts: list[str], **columns: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = spark.createDataFrame([(t,) for t in texts], "text string")
        return rows.select("text", *[made(F.col("text")).alias(n) for n, made in columns.items()])

    return query


def answers(rows: list[tuple], *columns: str) -> str:
    """SQL of literal rows (text, answers...); columns: name and type."""
    quote = lambda x: "null" if x is None else f"'{x}'" if not isinstance(x, bool) else str(x).lower()
    made = ", ".join("(" + ", ".join(quote(x) for x in row) + ")" for row in rows)
    names = ["text", *(c.split()[0] for c in columns)]
    casts = ["text", *(f"cast({c.split()[0]} as {c.split(maxsplit=1)[1]}) {c.split()[0]}" for c in columns)]
    return f"select {', '.join(casts)} from (values {made}) v({', '.join(names)})"


# texts in every form that a value can be written in are made from the columns of orders, by the order's key
PRICE_SQL, DAY_SQL = "cast(cast(o_totalprice as decimal(20,2)) as varchar)", "strftime(cast(o_orderdate as date), '%Y-%m-%d')"


def written(spark: SparkSession, folder: str, value: Column, *forms: Callable[[Column], Column]) -> DataFrame:
    """o_orderkey and text: the value in the form that the key chooses."""
    k = F.col("o_orderkey") % len(forms)
    text = F.coalesce(*[F.when(k == n, form(value)) for n, form in enumerate(forms)])
    return spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", text.alias("text"))


def price() -> Column:
    return F.col("o_totalprice").cast("decimal(20,2)").cast("string")


def day() -> Column:
    return F.col("o_orderdate").cast("date").cast("string")


@on_tables(f"""select o_orderkey, text, case when k in (0, 1, 2) then cast(p as decimal(28,8)) when k = 5 then -cast(p as decimal(28,8)) end amount, false inexact from (select o_orderkey, o_orderkey % 6 k, {PRICE_SQL} p,
case o_orderkey % 6 when 0 then {PRICE_SQL} when 1 then '+' || {PRICE_SQL} when 2 then '  ' || {PRICE_SQL} || chr(9) when 3 then replace({PRICE_SQL}, '.', ',') when 4 then {PRICE_SQL} || 'e0' else '-' || {PRICE_SQL} || '0000' end text from orders)""")
def parse_amounts(spark: SparkSession, folder: str) -> DataFrame:
    forms = (lambda p: p, lambda p: F.concat(F.lit("+"), p), lambda p: F.concat(F.lit("  "), p, F.lit("\t")), lambda p: F.translate(p, ".", ","), lambda p: F.concat(p, F.lit("e0")), lambda p: F.concat(F.lit("-"), p, F.lit("0000")))
    return written(spark, folder, price(), *forms).select("o_orderkey", "text", values.parse_amount(F.col("text")).alias("amount"), F.coalesce(values.inexact(F.col("text")), F.lit(False)).alias("inexact"))


@on_tables(f"""select o_orderkey, text, case when k < 3 then cast(o_orderdate as date) end date, k in (1, 2) as zone from (select o_orderkey, o_orderdate, o_orderkey % 5 k,
case o_orderkey % 5 when 0 then {DAY_SQL} when 1 then {DAY_SQL} || 'Z' when 2 then {DAY_SQL} || '-02:30' when 3 then strftime(cast(o_orderdate as date), '%d-%m-%Y') else {DAY_SQL} || '+15:00' end text from orders)""")
def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    turned = lambda d: F.concat_ws("-", F.substring(d, 9, 2), F.substring(d, 6, 2), F.substring(d, 1, 4))
    forms = (lambda d: d, lambda d: F.concat(d, F.lit("Z")), lambda d: F.concat(d, F.lit("-02:30")), turned, lambda d: F.concat(d, F.lit("+15:00")))
    return written(spark, folder, day(), *forms).select("o_orderkey", "text", values.parse_date(F.col("text")).alias("date"), F.coalesce(values.had_zone(F.col("text")), F.lit(False)).alias("zone"))


@on_tables("""select o_orderkey, text, case when k < 3 then cast(o_orderkey as bigint) * case when k = 2 then -1 else 1 end end number from (select o_orderkey, o_orderkey % 4 k,
case o_orderkey % 4 when 0 then cast(o_orderkey as varchar) when 1 then '+00' || cast(o_orderkey as varchar) when 2 then ' -' || cast(o_orderkey as varchar) else cast(o_orderkey as varchar) || '.0' end text from orders)""")
def parse_ints(spark: SparkSession, folder: str) -> DataFrame:
    forms = (lambda n: n, lambda n: F.concat(F.lit("+00"), n), lambda n: F.concat(F.lit(" -"), n), lambda n: F.concat(n, F.lit(".0")))
    return written(spark, folder, F.col("o_orderkey").cast("string"), *forms).select("o_orderkey", "text", values.parse_int(F.col("text")).alias("number"))


@on_tables(f"""select o_orderkey, text, cast(case k when 0 then cast(p as decimal(20,2)) * 10 when 1 then cast(p as decimal(20,2)) end as decimal(38,18)) number, k < 3 as valid from (select o_orderkey, o_orderkey % 4 k, {PRICE_SQL} p,
case o_orderkey % 4 when 0 then {PRICE_SQL} || 'E1' when 1 then {PRICE_SQL} when 2 then '-INF' else {PRICE_SQL} || 'e' end text from orders)""")
def parse_doubles(spark: SparkSession, folder: str) -> DataFrame:
    forms = (lambda p: F.concat(p, F.lit("E1")), lambda p: p, lambda p: F.lit("-INF"), lambda p: F.concat(p, F.lit("e")))
    return written(spark, folder, price(), *forms).select("o_orderkey", "text", values.parse_double(F.col("text")).alias("number"), values.is_double(F.col("text")).alias("valid"))


@on_tables(f"""select o_orderkey, text, cast(case when k < 3 then cast(p as decimal(20,2)) when k = 3 then -cast(p as decimal(20,2)) end as decimal(28,2)) amount from (select o_orderkey, o_orderkey % 5 k, {PRICE_SQL} p,
case o_orderkey % 5 when 0 then {PRICE_SQL} when 1 then replace({PRICE_SQL}, '.', ',') when 2 then replace({PRICE_SQL}, '.', '') when 3 then {PRICE_SQL} || '-' else {PRICE_SQL} || '5' end text from orders)""")
def adf_amounts(spark: SparkSession, folder: str) -> DataFrame:
    forms = (lambda p: p, lambda p: F.translate(p, ".", ","), lambda p: F.translate(p, ".", ""), lambda p: F.concat(p, F.lit("-")), lambda p: F.concat(p, F.lit("5")))
    return written(spark, folder, price(), *forms).select("o_orderkey", "text", values.parse_adf_amount(F.col("text")).alias("amount"))


@on_tables(f"""select o_orderkey, text, case when k < 2 then cast(o_orderdate as date) end date from (select o_orderkey, o_orderdate, o_orderkey % 3 k,
case o_orderkey % 3 when 0 then strftime(cast(o_orderdate as date), '%d-%m-%Y') when 1 then strftime(cast(o_orderdate as date), '%d%m%Y') else {DAY_SQL} end text from orders)""")
def adf_dates(spark: SparkSession, folder: str) -> DataFrame:
    turned = lambda d, by: F.concat_ws(by, F.substring(d, 9, 2), F.substring(d, 6, 2), F.substring(d, 1, 4))
    return written(spark, folder, day(), lambda d: turned(d, "-"), lambda d: turned(d, ""), lambda d: d).select("o_orderkey", "text", values.parse_adf_date(F.col("text")).alias("date"))


@on_tables("""select c_custkey, case when c_custkey % 7 <> 0 then c_name end clean from customer""")
def strip_text(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.concat(F.lit("\u00a0 "), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")), F.lit("\t\n"))
    return spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", values.clean(padded).alias("clean"))


JOURNALS = [("S", "sales"), ("m", "memo"), ("Kas hoofdkantoor", "cash"), ("bank 2", "bank"), ("Loonjournaal", "payroll"), ("Productiehal", "production"), ("Goederen in", "goods"), ("T", "production"), ("onbekend", "unknown"), ("  ", "unknown")]
QUERIES["journal_kinds"] = over([j for j, _ in JOURNALS], kind=codes.journal_kind)
ORACLES["journal_kinds"] = answers(JOURNALS, "kind varchar")
ACCOUNTS = [("w", "profit_loss"), ("Balans", "balance"), ("gemengd", "mixed"), ("Opbrengsten 2020", "profit_loss"), ("passiva kort", "balance"), ("p&l", "profit_loss"), ("overig", "unknown")]
QUERIES["account_kinds"] = over([a for a, _ in ACCOUNTS], kind=codes.account_kind)
ORACLES["account_kinds"] = answers(ACCOUNTS, "kind varchar")
RELATIONS = [("c", "customer"), ("S", "supplier"), ("Leverancier hout", "supplier"), ("afnemer", "customer"), ("klant en leverancier", "both"), ("o", "other"), ("partner", "unknown")]
QUERIES["relation_kinds"] = over([r for r, _ in RELATIONS], kind=codes.relation_kind)
ORACLES["relation_kinds"] = answers(RELATIONS, "kind varchar")
RELEASES = [("release 3.6", "3.6"), ("versie 3,05", "3.5"), ("3.4.0.0", "3.4"), ("nog geen", None)]
QUERIES["rgs_releases"] = over([r for r, _ in RELEASES], release=codes.release)
ORACLES["rgs_releases"] = answers(RELEASES, "release varchar")
REFS = [("BVooGroMat", "BVooGroMat", None, False), ("WKosHui-07", "WKosHui", "07", False), ("nvt", None, None, True), ("77", None, None, False), (" WKos.A ", "WKos", "A", False)]
QUERIES["rgs_refs"] = over([r[0] for r in REFS], code=codes.rgs_code, extension=codes.rgs_extension, placeholder=codes.rgs_placeholder)
ORACLES["rgs_refs"] = answers(REFS, "code varchar", "extension varchar", "placeholder boolean")

# ---- reference chart, over invented codes
CHART = [("B", 1), ("BVoo", 2), ("BVooGro", 3), ("BVooGroMat", 4), ("BVooGroMatHou", 5), ("W", 1), ("WKos", 2), ("WKosHui", 3), ("WKosHuiHur", 4)]
RENAMES = [("WKosPan", "WKosHuiHur"), ("BVooHou", "BVooGroMatHou")]
CHART_SQL = "chart(code, level) as (values {}), renames(old, new) as (values {}), refs as (select distinct id, rgs_code code from ({}))".format(
    ", ".join(f"('{c}', {n})" for c, n in CHART), ", ".join(f"('{a}', '{b}')" for a, b in RENAMES),
    "select cast(p_partkey as varchar) id, case p_size % 5 when 0 then 'BVooGroMat' when 1 then 'WKosPan' when 2 then 'BVooNie' when 3 then 'WKos' else 'WKosHuiHur' end rgs_code from part",
)


def chart_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    size = F.col("p_size") % 5
    code = F.when(size == 0, "BVooGroMat").when(size == 1, "WKosPan").when(size == 2, "BVooNie").when(size == 3, "WKos").otherwise("WKosHuiHur")
    refs = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").cast("string").alias("id"), code.alias("code"))
    return refs, spark.createDataFrame(CHART, "code string, level int"), spark.createDataFrame(RENAMES, "old string, new string")


@on_tables(f"""with {CHART_SQL} select id, code, finding, hint from (select r.id, r.code, case when level not in (4, 5) then 'XAF8006' when level is null and new is not null then 'XAF8004' when level is null then 'XAF8003' end finding,
case when level is not null then cast(level as varchar) when new is not null then new else (select p.code from chart p where starts_with(r.code, p.code) and p.code <> r.code order by length(p.code) desc limit 1) end hint
from refs r left join chart c on c.code = r.code left join renames n on n.old = r.code) where finding is not null""")
def rgs_check(spark: SparkSession, folder: str) -> DataFrame:
    return rgs.checked(*chart_of(spark, folder))


@on_tables(f"with {CHART_SQL} select c.code, max_by(p.code, length(p.code)) parent from chart c join chart p on starts_with(c.code, p.code) and p.code <> c.code group by 1")
def rgs_parent(spark: SparkSession, folder: str) -> DataFrame:
    _, chart, _ = chart_of(spark, folder)
    return rgs.ancestors(chart, chart)


@on_tables(f"with {CHART_SQL} select parent, count(*) children from (select c.code, max_by(p.code, length(p.code)) parent from chart c join chart p on starts_with(c.code, p.code) and p.code <> c.code group by 1) group by 1")
def rgs_children(spark: SparkSession, folder: str) -> DataFrame:
    return rgs_parent(spark, folder).groupBy("parent").agg(F.count("*").alias("children"))


# ---- structure
@on_tables("select p_partkey, p_name from part where length(p_name) > 8")
def facet_length(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/part.parquet").filter(structure.too_long(F.col("p_name"), 8)).select("p_partkey", "p_name")


@on_tables("select c_custkey, c_mktsegment from customer where c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE')")
def facet_enum(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/customer.parquet").filter(structure.not_in_enum(F.col("c_mktsegment"), ["AUTOMOBILE", "BUILDING", "FURNITURE"])).select("c_custkey", "c_mktsegment")


@on_tables("select p_partkey, p_brand from part where not regexp_full_match(p_brand, 'Brand#[1-3][0-9]')")
def facet_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/part.parquet").filter(structure.not_like(F.col("p_brand"), "Brand#[1-3][0-9]")).select("p_partkey", "p_brand")


@on_tables("""select o_orderkey, v from (select o_orderkey, cast(cast(o_totalprice as decimal(20,2)) as varchar) v from orders)
where length(ltrim(replace(rtrim(rtrim(v, '0'), '.'), '.', ''), '0-')) > 6""")
def facet_digits(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast(MONEY).cast("string").alias("v"))
    return rows.filter(structure.too_many_digits(F.col("v"), 6, 2))


SPEC = [("A", 1, 2, 1), ("N", 0, 1, 2), ("R", 1, 1, 3)]
ELEMENTS = "select l_orderkey parent, l_returnflag \"name\", row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) ord from lineitem"


def elements_of(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    rows = lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_returnflag").alias("name"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return uniqueness.ranked(rows, ["parent"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).select("parent", "name", F.col("nth").alias("ord"))


def spec_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPEC, "name string, min int, max int, position int")


SPEC_SQL = "spec(\"name\", least, most, position) as (values {})".format(", ".join(str(x) for x in SPEC))


@on_tables(f"""with {SPEC_SQL} select o_orderkey parent, s."name", coalesce(n, 0) occurrences from orders cross join spec s left join (select l_orderkey, l_returnflag, count(*) n from lineitem group by 1, 2) e
on e.l_orderkey = o_orderkey and e.l_returnflag = s."name" where coalesce(n, 0) < least or coalesce(n, 0) > most""")
def cardinality(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.col("l_orderkey").alias("parent"), F.col("l_returnflag").alias("name"))
    parents = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("parent"))
    return structure.cardinality(parents, lineitem, spec_of(spark).drop("position"))


@on_tables(f"""with {SPEC_SQL} select distinct parent from (select parent, position, lag(position) over (partition by parent order by ord) before from ({ELEMENTS}) e join spec using ("name")) where before > position""")
def child_order(spark: SparkSession, folder: str) -> DataFrame:
    return structure.out_of_order(elements_of(spark, folder).join(F.broadcast(spec_of(spark).select("name", "position")), "name"))


# ---- findings
def all_findings(ledger: Ledger) -> DataFrame:
    """The distinct findings: each rule's rows are made distinct by the few columns that tell them apart, or are so by
    how they are made, as rows of whole findings are several times wider."""
    text = lambda *parts: F.concat_ws(" ", *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    accounts = uniqueness.distinct_keys(undefined_accounts(ledger), ["tx", "account_id"])
    relations = uniqueness.distinct_keys(undefined_relations(ledger), ["tx", "relation_id"])
    made = [
        findings.finding(accounts, "XAF4001", findings.ERROR, text("account is not defined", F.col("account_id")), value=F.col("account_id"), line=F.col("tx")),
        findings.finding(relations, "XAF4002", findings.ERROR, text("relation is not defined", F.col("relation_id")), value=F.col("relation_id"), line=F.col("tx")),
        findings.finding(unbalanced_tx(ledger), "XAF5010", findings.ERROR, text("transaction does not balance", F.col("tx").cast("string")), line=F.col("tx")),
        findings.finding(dup_line_numbers(ledger), "XAF6005", findings.ERROR, text("line number occurs again", F.col("number")), value=F.col("number"), line=F.col("tx")),
        findings.finding(tx_without_lines(ledger).select("tx").distinct(), "XAF7011", findings.WARNING, text("transaction without lines"), line=F.col("tx")),
        findings.finding(uniqueness.distinct_keys(tx_outside_fy(ledger), ["tx", "date"]), "XAF7002", findings.WARNING, text("date outside the fiscal year"), line=F.col("tx"), value=F.col("date")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


FINDINGS = f"""f as (select distinct * from (
select 'XAF4001' code, 30 severity, 'account is not defined ' || account_id message, tx line, account_id "value" from lines l where not exists (select 1 from accounts a where a.id = l.account_id)
union all select 'XAF4002', 30, 'relation is not defined ' || relation_id, tx, relation_id from transactions t where not exists (select 1 from relations r where r.id = t.relation_id)
union all select 'XAF5010', 30, 'transaction does not balance ' || tx, tx, null from ({UNBALANCED.format("lines")})
union all select 'XAF6005', 30, 'line number occurs again ' || number, tx, number from (select tx, number from lines group by 1, 2 having count(*) > 1)
union all select 'XAF7011', 20, 'transaction without lines', tx, null from transactions t where not exists (select 1 from lines l where l.tx = t.tx)
union all select 'XAF7002', 20, 'date outside the fiscal year', tx, cast("date" as varchar) from transactions, header where "date" < start_date or "date" > end_date))"""


@on_ledger(f", {FINDINGS} select code, count(*) findings from f group by 1")
def finding_counts(ledger: Ledger) -> DataFrame:
    return findings.by_code(all_findings(ledger))


@on_ledger(f", {FINDINGS} select severity, count(*) findings from f group by 1")
def severity_counts(ledger: Ledger) -> DataFrame:
    return findings.by_severity(all_findings(ledger))


@on_ledger(f", {FINDINGS} select code, severity, message, line::int line, \"value\" from (select *, row_number() over (partition by code order by line, message, \"value\" nulls first) n from f) where n <= 100")
def limited_findings(ledger: Ledger) -> DataFrame:
    return findings.limited(all_findings(ledger), 100, ["line", "message", "value"]).select("code", "severity", "message", "line", "value")


@on_ledger(f", {FINDINGS} select code, count(*) findings from f where code in ('XAF5010') group by 1")
def vts_findings(ledger: Ledger) -> DataFrame:
    rows = all_findings(ledger).withColumn("code", F.substring("code", 4, 4))
    return findings.by_code(findings.service_rules(rows).withColumn("code", F.concat(F.lit("XAF"), "code")))


@on_ledger(f", {FINDINGS} select severity, count(*) findings from (select case code when 'XAF7002' then 10 else severity end severity from f where code <> 'XAF4002') group by 1")
def overrides(ledger: Ledger) -> DataFrame:
    return findings.by_severity(findings.overridden(all_findings(ledger), {"XAF7002": findings.INFO, "XAF4002": None}))


@on_ledger(f", {FINDINGS} select count(*) findings, max(severity) max_severity, max(severity) < 30 ok from f")
def report_verdict(ledger: Ledger) -> DataFrame:
    return findings.verdict(all_findings(ledger))


# ---- sets of files
def files_of(ledger: Ledger) -> tuple[DataFrame, DataFrame]:
    """The transactions as files of a year each, numbered from 0 within each file; and the files' sizes."""
    rows = ledger.transactions.withColumn("file", F.year("date"))
    numbered = uniqueness.ranked(rows, ["file"], ["tx"]).withColumn("ord", F.col("nth") - 1)
    return numbered.select("file", "tx", "ord"), rows.groupBy("file").agg(F.count("*").alias("n"))


@on_ledger("""select year("date") file, tx, (row_number() over (order by year("date"), tx) - 1)::bigint seq from transactions""")
def cross_file_seq(ledger: Ledger) -> DataFrame:
    return uniqueness.running_numbers(*files_of(ledger)).select(F.col("file").cast("long").alias("file"), "tx", "seq")


@on_ledger("""select year("date") file, count(*) transactions from transactions group by 1""")
def multi_file_union(ledger: Ledger) -> DataFrame:
    years = ledger.transactions.withColumn("file", F.year("date").cast("long"))
    parts = [years.filter(F.col("journal_id") < "3"), years.filter(F.col("journal_id") >= "3")]
    return parts[0].unionByName(parts[1]).groupBy("file").agg(F.count("*").alias("transactions"))


# ---- values that don't fit
@on_ledger("select tx, number, case when vat_percentage * amount * 0.01 = round(vat_percentage * amount * 0.01, 2) then round(vat_percentage * amount * 0.01, 2) end::decimal(20,2) vat from lines")
def inexact_null(ledger: Ledger) -> DataFrame:
    vat = F.col("vat_percentage") * F.col("amount") * F.lit("0.01").cast("decimal(3,2)")
    return ledger.lines.select("tx", "number", tables.narrowed(vat, "null").alias("vat"))


@on_ledger("select tx, number, round_even(vat_percentage * amount * 0.01, 2)::decimal(20,2) vat from lines")
def inexact_round(ledger: Ledger) -> DataFrame:
    vat = F.col("vat_percentage") * F.col("amount") * F.lit("0.01").cast("decimal(3,2)")
    return ledger.lines.select("tx", "number", tables.narrowed(vat, "round").alias("vat"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
