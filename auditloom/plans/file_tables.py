"""The twelve fixed tables of parsed XML files, one schema for all versions.

seq columns number rows in document order across files: ranks within a file plus the sizes of the files before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.codes import account_kind, concept_code, journal_kind, relation_kind, rgs_code, rgs_extension, rgs_placeholder
from auditloom.functions.values import parse_amount, parse_date, parse_double, parse_int, sided, split
from auditloom.operators.uniqueness import first_wins
from auditloom.sources.ledger import Files, field

MONEY, RATE, PERCENT = "decimal(20,2)", "decimal(24,6)", "decimal(8,3)"
OPENING_PERIODS = ["0", "00", "000"]


def amount(*names: str, kind: str = MONEY) -> Column:
    return parse_amount(field(*names)).try_cast(kind)


def signed_of(name: str, side: str, policy: str) -> tuple[Column, Column, Column]:
    """(amount, side, signed) as written under a policy for negative amounts."""
    value = amount(name)
    s, signed = sided(value, field(side), policy)
    return value, s, signed.cast(MONEY)


class FileTables:
    """The tables, lazily; files.rows is read as often as tables are, so it should be persisted or written."""

    def __init__(self, files: Files, negative_amounts: str = "flip"):
        if negative_amounts not in ("flip", "abs"):
            raise ValueError(f"unknown policy {negative_amounts!r}")
        self.files, self.policy = files, negative_amounts
        names = files.files.select("file").distinct()
        # one row for each file
        self.index = names.withColumn("no", (F.row_number().over(W.orderBy("file")) - 1).cast("long"))

    def of(self, *kinds: str) -> DataFrame:
        return self.files.of(*kinds)

    def numbered(self, rows: DataFrame) -> DataFrame:
        """Adds seq to rows with (file, ord), and replaces file by its number."""
        rows = rows.withColumn("rank_", F.row_number().over(W.partitionBy("file").orderBy("ord")).cast("long"))
        sizes = self.index.join(rows.groupBy("file").agg(F.max("rank_").alias("n_")), "file", "left")
        before = F.coalesce(F.sum("n_").over(W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.withColumn("before_", before).drop("n_")
        return rows.join(sizes, "file").withColumns({"seq": F.col("before_") + F.col("rank_") - 1, "file": F.col("no")}).drop("rank_", "before_", "no")

    def masters(self, kind_: str, by_: str, **columns: Column) -> DataFrame:
        """First definitions of a kind, numbered."""
        rows = self.of(kind_).select("file", "ord", *[c.alias(n) for n, c in columns.items()]).filter(F.col(by_).isNotNull())
        return self.numbered(first_wins(rows, [by_], ["file", "ord"]))

    def header(self) -> DataFrame:
        kind = self.files.files.select("file", F.col("version").alias("format_version"), "family")
        rows = self.of("header").select(
            "file", field("fiscalYear").alias("fiscal_year"), parse_date(field("startDate")).alias("start_date"), parse_date(field("endDate")).alias("end_date"), field("curCode", "currencyCode").alias("currency"),
            parse_date(field("dateCreated")).alias("created"), field("softwareDesc", "productID").alias("software_name"), field("softwareVersion", "productVersion").alias("software_version"),
            field("RGSVersion").alias("rgs_version"), field("auditfileVersion").alias("declared_version"),
        )
        return rows.join(kind, "file").select("format_version", "family", *[c for c in rows.columns if c != "file"])

    def company(self) -> DataFrame:
        made = lambda df, ident, tax: df.select(field("companyName").alias("name"), field(ident).alias("identifier"), field("Commercenr", "commerceNr").alias("commerce_number"), field("taxRegistrationCountry").alias("tax_registration_country"), field(tax).alias("tax_registration_id"))
        older = self.of("header").filter(F.map_contains_key("fields", "companyName"))
        return made(self.of("company"), "companyIdent", "taxRegIdent").unionByName(made(older, "companyID", "taxRegistrationNr"))

    def addresses(self) -> DataFrame:
        owners = self.of("company").select("file", F.col("ord").alias("up"), F.lit("company").alias("owner_type"), field("companyName").alias("owner_id"))
        owners = owners.unionByName(self.of("customerSupplier").select("file", F.col("ord").alias("up"), F.lit("relation").alias("owner_type"), field("custSupID").alias("owner_id")))
        kind = F.when(F.col("kind") == "streetAddress", "street").otherwise("postal").alias("kind")
        names = {"street": ("streetname", "address"), "number": ("number",), "number_extension": ("numberExtension",), "property": ("property",), "city": ("city",), "postal_code": ("postalCode",), "region": ("region",), "country": ("country",)}
        rows = self.of("streetAddress", "postalAddress").select("file", "up", "ord", kind, *[field(*n).alias(k) for k, n in names.items()]).join(owners, ["file", "up"])
        place = F.row_number().over(W.partitionBy("file", "up").orderBy(F.desc("kind"), "ord")) - 1
        return rows.select("owner_type", "owner_id", place.cast("long").alias("seq"), "kind", *names)

    def accounts(self) -> DataFrame:
        taxonomy = self.of("taxonomy").select("file", F.col("ord").alias("t"), F.col("up").alias("ord"))
        concept = self.of("entryPoint").select("file", F.col("ord").alias("e"), F.col("up").alias("t"), field("conceptRef").alias("ref")).filter("ref is not null").join(taxonomy, ["file", "t"]).groupBy("file", "ord").agg(F.min_by("ref", "e").alias("ref"))
        older = self.of("taxoElement").select("file", "ord", field("accID", "accountID").alias("id"), field("conceptRef", "taxoRef", "txCd").alias("older")).filter("id is not null and older is not null")
        rows = self.of("ledgerAccount").select(
            "file", "ord", field("accID", "accountID").alias("id"), field("accDesc", "accountDesc").alias("description"), field("accTp", "accountType").alias("account_type"), field("leadCode").alias("lead_code"),
            field("leadDescription").alias("lead_description"), field("RGScode").alias("direct"), *[field(n).alias(n) for n in ("leadReference", "leadCrossRef")],
        )
        rows = self.numbered_first(rows.join(concept, ["file", "ord"], "left").join(first_wins(older, ["id"], ["file", "ord"]).select("id", "older"), "id", "left"))
        lead = [F.when(F.col(c).rlike("^[BW]") & (F.length(rgs_code(F.col(c))) >= 4), F.struct(F.col(c).alias("raw"), F.col(c).alias("text"), F.lit(n).alias("source"))) for c, n in (("leadReference", "leadReference"), ("lead_code", "leadCode"), ("leadCrossRef", "leadCrossRef"))]
        given = lambda c, text, source: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("raw"), text.alias("text"), F.lit(source).alias("source")))
        rows = rows.withColumn("rgs", F.coalesce(given("direct", F.col("direct"), "RGScode"), given("ref", concept_code(F.col("ref")), "taxonomy"), *lead, given("older", concept_code(F.col("older")), "taxonomies")))
        text = F.col("rgs.text")
        return rows.select(
            "seq", "file", "id", "description", "account_type", account_kind(F.col("account_type")).alias("account_kind"), "lead_code", "lead_description", F.col("rgs.raw").alias("rgs_raw"), rgs_code(text).alias("rgs_code"),
            rgs_extension(text).alias("rgs_extension"), F.col("rgs.source").alias("rgs_source"), F.when(F.col("rgs").isNotNull(), rgs_placeholder(text)).alias("rgs_placeholder"),
        )

    def numbered_first(self, rows: DataFrame) -> DataFrame:
        """Numbers all definitions, later ones of an id too, and keeps the first of each id."""
        return first_wins(self.numbered(rows.filter("id is not null")), ["id"], ["seq"])

    def relations(self) -> DataFrame:
        balance = lambda a, s: F.when(F.map_contains_key("fields", a) & F.map_contains_key("fields", s), signed_of(a, s, self.policy)[2])
        names = {"name": ("custSupName", "companyName"), "relation_type": ("custSupTp", "type"), "contact": ("contact",), "tax_registration_country": ("taxRegistrationCountry",), "tax_registration_id": ("taxRegIdent", "taxRegistrationNr"), "commerce_number": ("commerceNr",), "email": ("eMail",), "telephone": ("telephone",), "website": ("website",)}
        rows = self.of("customerSupplier").select("file", "ord", field("custSupID").alias("id"), *[field(*n).alias(k) for k, n in names.items()], balance("opBalDesc", "opBalTp").alias("opening_balance"), balance("clBalDesc", "clBalTp").alias("closing_balance"))
        rows = self.numbered_first(rows).withColumn("relation_kind", relation_kind(F.col("relation_type")))
        return rows.select("seq", "file", "id", "name", "relation_type", "relation_kind", *[n for n in names if n not in ("name", "relation_type")], "opening_balance", "closing_balance")

    def vat_codes(self) -> DataFrame:
        return self.masters("vatCode", "id", id=field("vatID"), description=field("vatDesc"), payable_account_id=field("vatToPayAccID"), receivable_account_id=field("vatToClaimAccID")).select("seq", "id", "description", "payable_account_id", "receivable_account_id")

    def periods(self) -> DataFrame:
        rows = self.masters("period", "key", key=field("periodNumber"), number=parse_int(field("periodNumber")), start_date=parse_date(field("startDatePeriod")), end_date=parse_date(field("endDatePeriod")), description=field("periodDesc"))
        return rows.select("seq", "key", "number", "start_date", "end_date", "description")

    def journals(self) -> DataFrame:
        rows = self.masters("journal", "id", id=field("jrnID", "journalID"), description=field("desc", "description"), journal_type=field("jrnTp", "type"), offset_account_id=field("offsetAccID"), bank_account=field("bankAccNr"))
        return rows.select("seq", "file", "id", "description", "journal_type", journal_kind(F.col("journal_type")).alias("journal_kind"), "offset_account_id", "bank_account")

    def heads(self) -> DataFrame:
        """Transactions, numbered, with their place in the file."""
        journals = self.of("journal").select("file", F.col("ord").alias("up"), field("jrnID", "journalID").alias("journal_id"), journal_kind(field("jrnTp", "type")).alias("journal_kind"))
        rows = self.of("transaction").select(
            "file", "up", "ord", field("nr", "transactionID").alias("number"), field("desc", "description").alias("description"), field("periodNumber", "period").alias("period_key"), parse_int(field("periodNumber", "period")).alias("period_number"),
            parse_date(field("trDt", "transactionDate")).alias("date"), field("Source", "sourceID").alias("source"), field("User", "userID").alias("user"),
        ).join(journals, ["file", "up"], "left")
        return self.numbered(rows.withColumn("name", F.col("file")))

    def lines(self) -> DataFrame:
        value, side, signed = signed_of("amnt", "amntTp", self.policy)
        # the older form has a debit and a credit; an absent one is 0, an invalid one leaves nothing
        given = F.map_contains_key("fields", "debitAmount") | F.map_contains_key("fields", "creditAmount")
        two = [F.when(F.map_contains_key("fields", n), amount(n)).otherwise(F.lit(0).cast(MONEY)) for n in ("debitAmount", "creditAmount")]
        net = (two[0] - two[1]).cast(MONEY)
        rows = self.of("trLine", "line").withColumns({"net": F.when(given, net), "given": given})
        first = F.when(two[0] != 0, two[0]).otherwise(two[1])
        rows = rows.withColumns({
            "amount": F.when(F.col("given"), F.when(F.col("net").isNotNull(), first)).otherwise(value),
            "side": F.when(F.col("given"), F.when(two[0] != 0, "D").when(two[1] != 0, "C")).otherwise(side),
            "signed_amount": F.when(F.col("given"), F.col("net")).otherwise(signed),
        })
        debit, credit = split(F.col("signed_amount"))
        names = {
            "number": ("nr", "recordID"), "account_id": ("accID", "accountID"), "description": ("desc", "description"), "document_ref": ("docRef", "documentID"), "relation_id": ("custSupID",), "invoice_ref": ("invRef",), "order_ref": ("orderRef",),
            "receiving_doc_ref": ("receivingDocRef",), "shipping_doc_ref": ("shipDocRef",), "cost_center": ("cost", "costID", "costDesc"), "product": ("product", "prodID", "productDesc"), "project": ("project", "projID", "projectDesc"),
            "work_cost_arrangement": ("workCostArrRef",), "bank_account": ("bankAccNr",), "offset_bank_account": ("offsetBankAccNr",),
        }
        rows = rows.select(
            "file", "ord", "up", "amount", "side", "signed_amount", debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"), *[field(*n).alias(k) for k, n in names.items()], F.lit(None).cast("string").alias("cost_unit"),
            parse_date(field("effDate", "effectiveDate")).alias("effective_date"), parse_date(field("settDate")).alias("settlement_date"), amount("qntity", kind=RATE).alias("quantity"),
        )
        foreign_net = amount("currencyDebitAmount") - amount("currencyCreditAmount")
        foreign = self.of("currency").select("file", F.col("up").alias("ord"), F.col("ord").alias("c"), field("curCode", "currencyCode").alias("foreign_currency"), F.coalesce(amount("curAmnt"), F.abs(foreign_net)).cast(MONEY).alias("foreign_amount"), foreign_net.cast(MONEY).alias("foreign_signed_amount"), parse_double(field("exchangeRate")).try_cast(RATE).alias("exchange_rate"))
        foreign = first_wins(foreign, ["file", "ord"], ["c"]).drop("c")
        vat = self.of("vat").groupBy("file", F.col("up").alias("ord")).agg(F.count("*").alias("vat_count"))
        heads = self.heads().select(F.col("name").alias("file_"), F.col("ord").alias("up_"), F.col("seq").alias("transaction_seq"), "journal_id", F.col("number").alias("transaction_number"), "period_key", F.col("date").alias("transaction_date"), "journal_kind")
        rows = rows.join(foreign, ["file", "ord"], "left").join(vat, ["file", "ord"], "left").withColumn("vat_count", F.coalesce("vat_count", F.lit(0).cast("long")))
        rows = rows.join(heads, (F.col("file") == F.col("file_")) & (F.col("up") == F.col("up_"))).withColumn("name", F.col("file"))
        return self.numbered(rows).select(
            "seq", "transaction_seq", "file", "journal_id", "transaction_number", "period_key", "transaction_date", "number", "account_id", "amount", "side", "signed_amount", "debit", "credit", "description", "document_ref", "effective_date",
            "settlement_date", "relation_id", "invoice_ref", "order_ref", "receiving_doc_ref", "shipping_doc_ref", "cost_center", "cost_unit", "product", "project", "work_cost_arrangement", "bank_account", "offset_bank_account", "quantity",
            "foreign_currency", "foreign_amount", "foreign_signed_amount", "exchange_rate", "vat_count", "name", "ord", "journal_kind",
        )

    def transactions(self) -> DataFrame:
        zero = F.lit(0)
        sums = self.lines().groupBy(F.col("transaction_seq").alias("seq")).agg(F.count("*").alias("line_count"), F.sum(F.coalesce("debit", zero)).cast(MONEY).alias("total_debit"), F.sum(F.coalesce("credit", zero)).cast(MONEY).alias("total_credit"))
        rows = self.heads().join(sums, "seq", "left").withColumns({"line_count": F.coalesce("line_count", zero.cast("long")), "total_debit": F.coalesce("total_debit", zero.cast(MONEY)), "total_credit": F.coalesce("total_credit", zero.cast(MONEY))})
        return rows.select("seq", "file", "journal_id", "number", "description", "period_key", "period_number", "date", "source", "user", "line_count", "total_debit", "total_credit")

    def line_vat(self) -> DataFrame:
        value, side, signed = signed_of("vatAmnt", "vatAmntTp", self.policy)
        rows = self.of("vat").select("file", "up", "ord", field("vatID", "vatCode").alias("code"), F.coalesce(parse_amount(field("vatPerc")), parse_double(field("vatPercentage"))).try_cast(PERCENT).alias("percentage"), F.coalesce(value, amount("vatAmount")).alias("amount"), side.alias("side"), signed.alias("signed_amount"))
        place = (F.row_number().over(W.partitionBy("file", "up").orderBy("ord")) - 1).cast("long")
        lines = self.lines().select(F.col("name").alias("n_"), F.col("ord").alias("o_"), F.col("seq").alias("line_seq"), "transaction_seq")
        return rows.withColumn("index", place).join(lines, (F.col("file") == F.col("n_")) & (F.col("up") == F.col("o_"))).select("line_seq", "transaction_seq", "index", "code", "percentage", "amount", "side", "signed_amount")

    def opening_balance(self) -> DataFrame:
        """The lines of the opening-balance element if a file of the set has one, else those of opening transactions."""
        value, side, signed = signed_of("amnt", "amntTp", self.policy)
        debit, credit = split(F.col("signed_amount"))
        own = self.of("obLine").select("file", "ord", field("nr").alias("number"), field("accID").alias("account_id"), value.alias("amount"), side.alias("side"), signed.alias("signed_amount"))
        own = self.numbered(own).select("seq", F.lit("element").alias("source"), "number", "account_id", "amount", "side", "signed_amount", debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"), F.lit(None).cast("long").alias("transaction_seq"), F.lit(None).cast("string").alias("journal_id"))
        there = self.of("openingBalance", "obLine").agg((F.count("*") > 0).alias("there"))
        booked = self.lines().filter(F.col("period_key").isin(OPENING_PERIODS) | (F.col("journal_kind") == "opening")).withColumn("source", F.lit("transactions"))
        booked = booked.crossJoin(F.broadcast(there)).filter("not there").select(*own.columns)
        return own.unionByName(booked)

    def all(self) -> dict[str, DataFrame]:
        made: dict[str, Callable[[], DataFrame]] = {n: getattr(self, n) for n in "header company addresses accounts relations vat_codes periods journals transactions lines line_vat opening_balance".split()}
        out = {n: make() for n, make in made.items()}
        out["lines"] = out["lines"].drop("name", "ord", "journal_kind")
        return out
