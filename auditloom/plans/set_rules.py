"""Rules over a set of files: what they must agree on, what they hold in which order, and how they give the opening balance.

The files that are read together form a set, whose first file is the first by name. Facts about the set (one row: the first
file, its version, which sections there are) are read once, before the rules are put together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.codes import journal_kind, release
from auditloom.functions.values import parse_adf_amount, parse_amount, parse_date
from auditloom.operators import findings as O
from auditloom.operators import references, uniqueness
from auditloom.plans.frames import Ledger
from auditloom.sources.ledger import Files, field
from auditloom.sources.trees import grown

# FIXED VALUES: sections that references point to, the records that they hold and what these are called
SECTIONS = {
    "generalLedger": ("ledgerAccount", "ledger accounts"),
    "customersSuppliers": ("customerSupplier", "customers/suppliers"),
    "vatCodes": ("vatCode", "VAT codes"),
    "periods": ("period", "periods"),
}
# FIXED VALUES: records that belong before the transactions, and period keys of the opening balance
BEFORE = "header customerSupplier ledgerAccount vatCode period obLine basic".split()
ZERO = ["0", "00", "000"]
# FIXED VALUES: masters whose definitions must agree between files
MASTERS = (("ledgerAccount", "account", ("accID", "accountID")), ("customerSupplier", "customer/supplier", ("custSupID",)), ("vatCode", "VAT code", ("vatID",)), ("period", "period", ("periodNumber",)))


@dataclass(frozen=True)
class Facts:
    """What is known of a set before its rules run."""

    first: str | None
    family: str | None
    version: str | None
    opening_element: bool
    checkable: dict[str, bool]


def facts(files: Files, ledger: Ledger) -> Facts:
    """A section that an XML file of the later family lacks can't be checked against; an empty one defines nothing.

    The older XML family must define accounts and relations in any case, and a fixed-width file defines what its lines name.
    """
    head = files.files.agg(F.min(F.struct("file", "family", "version")).alias("x")).select("x.*").first()
    has = lambda tag: F.coalesce(F.max((F.col("kind") == tag) | F.map_contains_key("fields", tag)), F.lit(False))
    seen = files.rows.filter("kind not like '#%'").agg(
        has("openingBalance").alias("openingBalance"),
        *[(has(s) | F.coalesce(F.max(F.col("kind") == record), F.lit(False))).alias(s) for s, (record, _) in SECTIONS.items()],
    ).first()
    family = head["family"]
    if family == "XAF":
        checkable = {s: seen[s] for s in SECTIONS}
    else:
        held = {"generalLedger": ledger.accounts, "customersSuppliers": ledger.relations, "vatCodes": ledger.vat_codes, "periods": ledger.periods}
        must = ("generalLedger", "customersSuppliers") if family == "CLAIR2" else ()
        checkable = {s: s in must or not rows.isEmpty() for s, rows in held.items()}
    return Facts(head["file"], family, head["version"], seen["openingBalance"], checkable)


def say(*parts: str | Column) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def of_agreement(files: Files, known: Facts) -> list[DataFrame]:
    """Versions, administrations and master data that differ from the first file's; whole trees are compared, by one digest each."""
    out, at = [], {"file": F.col("file")}
    others = files.files.filter(F.col("file") != F.lit(known.first))
    out.append(O.finding(others.filter(~F.col("version").eqNullSafe(F.lit(known.version))), "XAF3008", O.WARNING, say("the version is", F.col("version"), "but the first file's is", F.lit(known.version)), value=F.col("version"), **at))

    older = files.of("header").filter(F.map_contains_key("fields", "companyName"))
    company = lambda rows, ident, tax: rows.select("file", field(ident).alias("identifier"), field(tax).alias("tax_registration_id"), field("Commercenr", "commerceNr").alias("commerce_number"), field("companyName").alias("name"))
    companies = company(files.of("company"), "companyIdent", "taxRegIdent").unionByName(company(older, "companyID", "taxRegistrationNr"))
    ids = ["identifier", "tax_registration_id", "commerce_number"]
    # one row, that of the first file
    first = companies.filter(F.col("file") == F.lit(known.first)).limit(1).select(*[F.col(c).alias(f"first_{c}") for c in (*ids, "name")])
    both = companies.filter(F.col("file") != F.lit(known.first)).join(F.broadcast(first))
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"first_{c}"), F.lit(False))
    other = F.coalesce(*[F.when(differs(c), F.col(c)) for c in ids])
    folded = lambda c: F.upper(F.regexp_replace(c, r"\s+", " "))  # noqa: E731  capitals write ß as SS
    out.append(O.finding(both.filter(other.isNotNull()), "XAF6011", O.ERROR, say("another administration than the first file's:", other), value=other, **at))
    out.append(O.finding(both.filter(other.isNull() & (folded("name") != folded("first_name"))), "XAF6011", O.WARNING, say("the company name differs from the first file's:", F.col("name")), value=F.col("name"), **at))

    if others.isEmpty():
        return out
    trees = grown(files, *[kind for kind, *_ in MASTERS]).select("file", "ord", F.col("digest").alias("raw"))
    for kind, what, names in MASTERS:
        rows = files.of(kind).select("file", "line", "ord", field(*names).alias("id")).filter("id is not null").join(trees, ["file", "ord"])
        firsts = rows.groupBy("id").agg(F.min_by(F.struct("file", "raw"), F.struct("file", "ord")).alias("x")).select(F.col("id").alias("first_id"), F.col("x.file").alias("first_file"), F.col("x.raw").alias("first_raw"))
        changed = rows.join(firsts, F.col("id") == F.col("first_id")).filter((F.col("file") != F.col("first_file")) & (F.col("file") != F.lit(known.first)) & ~F.col("raw").eqNullSafe(F.col("first_raw")))
        out.append(O.finding(changed, "XAF6010", O.WARNING, say(f"{what} differs from its first definition:", F.col("id")), line=F.col("line"), value=F.col("id"), **at))
    return out


def of_order(files: Files) -> list[DataFrame]:
    """Records that belong before the transactions of their file, but follow one."""
    starts = files.of("transaction").groupBy(F.col("file").alias("of_file")).agg(F.min("ord").alias("start"))
    late = files.of(*BEFORE).join(starts, F.col("file") == F.col("of_file")).filter(F.col("ord") > F.col("start"))
    return [O.finding(late, "XAF3030", O.WARNING, say(F.col("kind"), "appears after the transactions"), file=F.col("file"), line=F.col("line"))]


def of_header(files: Files, known: Facts) -> list[DataFrame]:
    """The first file's fiscal year against its dates."""
    rows = files.of("header").filter(F.col("file") == F.lit(known.first)).select("file", "line", field("fiscalYear").alias("fy"), parse_date(field("startDate")).alias("a"), parse_date(field("endDate")).alias("b"))
    years = F.transform(F.regexp_extract_all("fy", F.lit("[0-9]{4}"), 0), lambda y: y.cast("int"))
    wrong = rows.filter((F.size(years) > 0) & ~F.arrays_overlap(years, F.array(F.year("a"), F.year("b"))))
    return [O.finding(wrong, "XAF7007", O.WARNING, say("fiscal year", F.col("fy"), "does not match its dates"), file=F.col("file"), line=F.col("line"), value=F.col("fy"))]


def of_sides(files: Files) -> list[DataFrame]:
    """Lines with both a debit and a credit amount, in the forms that have a field for either."""
    older = files.of("line").withColumns({"d": parse_amount(field("debitAmount")), "c": parse_amount(field("creditAmount"))})
    fixed = files.of("adfLine").withColumns({"d": parse_adf_amount(field("debet")), "c": parse_adf_amount(field("credit"))})
    return [O.finding(rows.filter("d <> 0 and c <> 0"), "XAF7013", O.WARNING, say("a line has both a debit and a credit amount"), file=F.col("file"), line=F.col("line"), path=F.col("path")) for rows in (older, fixed)]


def of_opening(files: Files, ledger: Ledger, known: Facts) -> list[DataFrame]:
    """The opening balance as an element, as transactions, as both, or not at all; the lines of the element."""
    out = []
    lines = files.of("obLine").select("file", "line", "ord", field("nr").alias("number"), field("accID").alias("account_id"))
    if known.checkable["generalLedger"]:
        out.append(O.finding(references.undefined(lines, "account_id", ledger.accounts), "XAF4007", O.ERROR, say("the opening balance refers to an undefined account:", F.col("account_id")), file=F.col("file"), line=F.col("line"), value=F.col("account_id")))
    again = uniqueness.later(lines.filter("number is not null"), ["file", "number"], ["ord"])
    out.append(O.finding(again, "XAF6006", O.ERROR, say("line number of the opening balance occurs again:", F.col("number")), file=F.col("file"), line=F.col("line"), value=F.col("number")))

    opening = ledger.journals.filter(journal_kind(F.col("journal_type")) == "opening").select(F.col("id").alias("journal_id"))
    zero = F.coalesce(F.col("period_key").isin(ZERO), F.lit(False))
    tx = ledger.transactions.filter(zero).select("tx").unionByName(ledger.transactions.filter(~zero).join(opening, "journal_id", "left_semi").select("tx"))
    n = ledger.lines.join(tx, "tx", "left_semi").agg(F.count("*").alias("n"))
    some = n.filter("n > 0")
    if known.opening_element:
        out.append(O.finding(some, "XAF7004", O.WARNING, say("the opening balance is given as an element and as", F.col("n").cast("string"), "lines of transactions")))
    else:
        out.append(O.finding(n.filter("n = 0"), "XAF7006", O.WARNING if known.version == "4.0" else O.INFO, say("no opening balance found")))
    if known.version == "4.0":
        out.append(O.finding(some, "XAF7005", O.ERROR, say("the opening balance must be an element in this version, not transactions")))
    return out


def of_unchecked(files: Files, ledger: Ledger, known: Facts) -> list[DataFrame]:
    """How many references point to each section that the set lacks; one finding for each section."""
    if known.family != "XAF":
        return []
    accounts = [ledger.lines.select("account_id"), files.of("obLine").select(field("accID")), ledger.journals.select("offset_account_id"), *[ledger.vat_codes.select(f"{w}_account_id") for w in ("payable", "receivable")]]
    pointing = {
        "generalLedger": accounts,
        "customersSuppliers": [ledger.lines.select("relation_id")],
        "vatCodes": [files.of("vat").select(field("vatID"))],
        "periods": [ledger.transactions.filter(~F.coalesce(F.col("period_key").isin(ZERO), F.lit(False)) | F.lit(known.version == "4.0")).select("period_key")],
    }
    out = []
    for section, frames in pointing.items():
        if known.checkable[section]:
            continue
        each = [df.toDF("id").agg(F.count("id").alias("n")) for df in frames]
        counts = each[0]
        for df in each[1:]:
            counts = counts.unionByName(df)
        counts = counts.agg(F.sum("n").alias("n")).filter("n > 0")
        out.append(O.finding(counts, "XAF4008", O.WARNING, say(F.col("n").cast("string"), f"references to {SECTIONS[section][1]} not checked: there is no {section}"), path=F.lit(section)))
    return out


def of_release(files: Files, known: Facts, chart_release: str) -> list[DataFrame]:
    """The reference chart's release that the first file declares, against that of the chart that is used."""
    rows = files.of("header").filter(F.col("file") == F.lit(known.first)).select("file", "line", field("RGSVersion").alias("said")).filter("said is not null")
    wrong = rows.filter(~release(F.col("said")).eqNullSafe(release(F.lit(chart_release))))
    return [O.finding(wrong, "XAF8005", O.INFO, say("the declared release of the reference chart is unknown or another:", F.col("said")), file=F.col("file"), line=F.col("line"), value=F.col("said"))]


def of_set(files: Files, ledger: Ledger, known: Facts, chart_release: str | None = None) -> list[DataFrame]:
    rules = [*of_agreement(files, known), *of_order(files), *of_header(files, known), *of_sides(files), *of_opening(files, ledger, known), *of_unchecked(files, ledger, known)]
    return rules + (of_release(files, known, chart_release) if chart_release else [])
