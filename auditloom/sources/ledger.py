"""The ledger frames of parsed audit files; the rules and tables are those of any other source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.codes import concept_code
from auditloom.functions.values import clean, parse_adf_amount, parse_adf_date, parse_amount, parse_date, parse_int
from auditloom.operators.uniqueness import first_wins, islands
from auditloom.plans.frames import MONEY, Ledger
from auditloom.sources import records

#: lines of a fixed-width file that are numbered by one task
BLOCK = 100_000


def field(*names: str) -> Column:
    """The first of the named fields that isn't empty."""
    return F.coalesce(*[clean(F.try_element_at("fields", F.lit(n))) for n in names])


def money(*names: str) -> Column:
    return parse_amount(field(*names)).cast(MONEY)


class Files:
    """Parsed files; rows is written once by the caller (persisted or as a table), as every frame reads it."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def of(self, *kinds: str) -> DataFrame:
        return self.rows.filter(F.col("kind").isin(*kinds))

    @property
    def files(self) -> DataFrame:
        get = lambda n: F.try_element_at("fields", F.lit(n)).alias(n)
        return self.of(records.FILE).select("file", *[get(n) for n in ("family", "version", "namespace", "status", "encoding", "compression", "continuation")], F.try_element_at("fields", F.lit("confidence")).cast("double").alias("confidence"))

    @property
    def notes(self) -> DataFrame:
        """What was noted while reading, as (file, line, code, message)."""
        return self.of(records.NOTE).select("file", "line", F.try_element_at("fields", F.lit("code")).alias("code"), F.try_element_at("fields", F.lit("message")).alias("message"))

    @property
    def declared(self) -> DataFrame:
        """Declared totals of each file."""
        counts = parse_int(field("linesCount", "numberEntries"))
        return self.of("transactions").select("file", counts.alias("lines_count"), money("totalDebit").alias("total_debit"), money("totalCredit").alias("total_credit"))

    @property
    def opening_lines(self) -> DataFrame:
        return self.of("obLine").select("file", "ord", field("nr").alias("number"), field("accID").alias("account_id"), money("amnt").alias("amount"), F.upper(field("amntTp")).alias("side"))

    def key(self, ord_: str = "ord") -> Column:
        """A record's key among all files: unique without a global numbering."""
        return F.xxhash64("file", ord_)

    def ledger(self) -> Ledger:
        """The frames of XML files of all versions; the first definition of an id wins."""
        master = lambda kind, *columns: first_wins(self.of(kind).select("file", "ord", "line", *columns).filter("id is not null"), ["id"], ["file", "ord"])
        parts = self.of("taxonomy", "entryPoint").select("file", "up", field("conceptRef").alias("ref")).filter("ref is not null")
        direct = self.of("ledgerAccount").select("file", "ord", "line", field("accID", "accountID").alias("id"), field("accDesc", "accountDesc").alias("description"), field("accTp", "accountType").alias("account_type"), field("RGScode").alias("code"), field("leadReference", "leadCode", "leadCrossRef").alias("lead"))
        concept = self.of("entryPoint").select("file", F.col("ord").alias("e"), F.col("up").alias("t"), field("conceptRef").alias("ref")).join(self.of("taxonomy").select("file", F.col("ord").alias("t"), F.col("up").alias("a")), ["file", "t"]).groupBy("file", "a").agg(F.min_by("ref", "e").alias("ref"))
        concept = concept.unionByName(parts.join(self.of("ledgerAccount").select("file", F.col("ord").alias("up")), ["file", "up"]).select("file", F.col("up").alias("a"), "ref")).withColumnsRenamed({"file": "f"})
        lead = F.when(F.col("lead").rlike("^[BW].{3,}"), F.col("lead"))
        accounts = direct.join(concept, (F.col("file") == F.col("f")) & (F.col("ord") == F.col("a")), "left").select("file", "ord", "line", "id", "description", "account_type", F.coalesce("code", concept_code(F.col("ref")), lead).alias("rgs_raw"))
        journals = self.of("journal").select("file", F.col("ord").alias("j"), field("jrnID", "journalID").alias("journal_id"))
        tx = self.of("transaction").select("file", "ord", "line", F.col("up").alias("j"), self.key().alias("tx"), field("nr", "transactionID").alias("number"), field("periodNumber", "period").alias("period_key"), parse_date(field("trDt", "transactionDate")).alias("date"), field("custSupID").alias("relation_id"), F.lit(None).cast(MONEY).alias("declared"))
        vat = self.of("vat").groupBy("file", F.col("up").alias("ord")).agg(F.min_by(field("vatID", "vatCode"), "ord").alias("vat_code"), F.min_by(parse_amount(field("vatPerc", "vatPercentage")).cast("decimal(8,3)"), "ord").alias("vat_percentage"))
        debit, credit = (F.coalesce(money(n), F.lit(0).cast(MONEY)) for n in ("debitAmount", "creditAmount"))
        net = debit - credit
        two = field("debitAmount", "creditAmount").isNotNull()
        amount = F.when(two, F.abs(net).cast(MONEY)).otherwise(money("amnt"))
        side = F.when(two, F.when(net < 0, "C").otherwise("D")).otherwise(F.upper(field("amntTp")))
        lines = self.of("trLine", "line").select("file", "ord", F.col("line").alias("at_line"), self.key("up").alias("tx"), field("nr", "recordID").alias("number"), field("accID", "accountID").alias("account_id"), amount.alias("amount"), side.alias("side"), parse_date(field("effDate", "effectiveDate")).alias("effective_date"), field("custSupID").alias("relation_id"))
        return Ledger(
            header=self.of("header").select(field("fiscalYear").alias("fiscal_year"), parse_date(field("startDate")).alias("start_date"), parse_date(field("endDate")).alias("end_date"), "file", "ord"),
            accounts=first_wins(accounts.filter("id is not null"), ["id"], ["file", "ord"]).drop("ord"),
            relations=master("customerSupplier", field("custSupID").alias("id"), field("custSupName", "companyName").alias("name"), field("custSupTp", "type").alias("relation_type"), money("opBalDesc").alias("balance")).drop("ord"),
            vat_codes=master("vatCode", field("vatID").alias("id"), field("vatToPayAccID").alias("payable_account_id"), field("vatToClaimAccID").alias("receivable_account_id")).drop("ord"),
            periods=first_wins(self.of("period").select("file", "ord", field("periodNumber").alias("key"), parse_date(field("startDatePeriod")).alias("start_date"), parse_date(field("endDatePeriod")).alias("end_date")).filter("key is not null"), ["key"], ["file", "ord"]).drop("file", "ord"),
            journals=master("journal", field("jrnID", "journalID").alias("id"), field("jrnTp", "type").alias("journal_type"), field("offsetAccID").alias("offset_account_id")).drop("ord"),
            transactions=tx.join(journals, ["file", "j"], "left").select("tx", "journal_id", "number", "period_key", "date", "relation_id", "declared", "file", "ord", "line"),
            lines=lines.join(vat, ["file", "ord"], "left").withColumnRenamed("at_line", "line"),
        )

    def fixed_width(self) -> Ledger:
        """The frames of fixed-width files: runs of lines with one journal, period, number and identification are transactions."""
        lines = self.of("adfLine")
        keys = {"journal_id": "dagboekcode", "period_key": "periode", "sequence": "volgnummer", "mark": "identificatieJournaalpost"}
        rows = islands(lines.withColumns({k: field(v) for k, v in keys.items()}), list(keys), ["file"], ["ord"], F.floor(F.col("ord") / BLOCK)).withColumn("tx", F.xxhash64("file", "island"))
        amounts = (F.coalesce(parse_adf_amount(field(n)), F.lit(0)) for n in ("debet", "credit"))
        debit, credit = amounts
        net = (debit - credit).cast(MONEY)
        first = lambda *columns, key: first_wins(rows.select("file", "ord", "line", *columns).filter(f"{key} is not null"), [key], ["file", "ord"]).drop("ord")
        header = self.of("adfHeader")
        nothing = rows.sparkSession.createDataFrame([], "file string, line int, id string, payable_account_id string, receivable_account_id string")
        heads = rows.groupBy("tx").agg(F.first("journal_id").alias("journal_id"), F.coalesce(F.min_by("sequence", "ord"), F.min_by("mark", "ord")).alias("number"), F.first("period_key").alias("period_key"), F.min_by(parse_adf_date(field("verwerkingsdatum")), "ord").alias("date"), F.first("file").alias("file"), F.min("ord").alias("ord"), F.min("line").alias("line"))
        return Ledger(
            header=header.select(field("jaarPeriode").alias("fiscal_year"), F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), "file", "ord"),
            accounts=first(field("grootboekrekeningcode").alias("id"), field("grootboekrekeningnaam").alias("description"), field("soortGrootboekrekening").alias("account_type"), F.lit(None).cast("string").alias("rgs_raw"), key="id"),
            relations=first(field("debCredNummer").alias("id"), field("debCredNaam").alias("name"), field("debCredSoort").alias("relation_type"), F.lit(None).cast(MONEY).alias("balance"), key="id"),
            vat_codes=nothing,
            periods=rows.sparkSession.createDataFrame([], "key string, start_date date, end_date date"),
            journals=first(F.col("journal_id").alias("id"), field("dagboekomschrijving").alias("journal_type"), F.lit(None).cast("string").alias("offset_account_id"), key="id"),
            transactions=heads.withColumns({"relation_id": F.lit(None).cast("string"), "declared": F.lit(None).cast(MONEY)}),
            lines=rows.select("file", "ord", "line", "tx", field("regelnummer").alias("number"), field("grootboekrekeningcode").alias("account_id"), F.abs(net).alias("amount"), F.when(net < 0, "C").otherwise("D").alias("side"), parse_adf_date(field("mutatiedatum")).alias("effective_date"), field("debCredNummer").alias("relation_id"), field("btwCode").alias("vat_code"), F.lit(None).cast("decimal(8,3)").alias("vat_percentage")),
        )


def open_files(spark: SparkSession, paths: str | list[str], folder: str | None = None, **options) -> Files:
    """Parses files once: into Parquet below folder, or else kept by Spark on the executors' disks and memory."""
    rows = records.read(spark, paths, **options)
    if folder is None:
        return Files(rows.persist())
    rows.write.mode("overwrite").parquet(folder)
    return Files(spark.read.parquet(folder))
