"""All rules over parsed files, as one plan: every rule is a DataFrame of findings, and the report aggregates their union."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.values import AMOUNT, clean, had_zone, inexact, parse_adf_amount, parse_amount, parse_date, parse_int
from auditloom.operators import findings as O
from auditloom.operators import references, rgs, tables, totals, uniqueness
from auditloom.plans import set_rules
from auditloom.plans.frames import Ledger
from auditloom.sources.ledger import Files, field
from auditloom.sources.records import LEAF

ERROR, WARNING, INFO = O.ERROR, O.WARNING, O.INFO
#: sums of amounts
WIDE = "decimal(38,8)"
# FIXED VALUES: severity of what is noted while reading
NOTED = {"XAF1001": INFO, "XAF1002": WARNING, "XAF1003": ERROR, "XAF1004": INFO, "XAF1005": WARNING, "XAF1006": WARNING, "XAF1010": WARNING, "XAF1011": WARNING, "XAF1012": WARNING, "XAF1013": WARNING, "XAF1020": INFO, "XAF1021": ERROR, "XAF2001": ERROR, "XAF2002": ERROR, "XAF2003": ERROR, "XAF3009": WARNING, "XAF3050": ERROR}
# FIXED VALUES: severity of what is found by a reference chart
CHART = {"XAF8003": WARNING, "XAF8004": WARNING, "XAF8006": WARNING}
# FIXED VALUES: fields of each lexical kind, and required fields by record
DATES = "startDate endDate dateCreated startDatePeriod endDatePeriod trDt effDate settDate transactionDate effectiveDate".split()
MONEY_FIELDS = "amnt vatAmnt curAmnt totalDebit totalCredit opBalDesc clBalDesc debitAmount creditAmount vatPerc".split()
COUNTS, SIDES = "linesCount numberEntries".split(), "amntTp vatAmntTp opBalTp clBalTp".split()
# FIXED VALUES: records that an id defines, the names of the id, and what a later definition is
MASTERS = [
    ("ledgerAccount", "accID accountID", "XAF6002", ERROR),
    ("customerSupplier", "custSupID", "XAF6001", ERROR),
    ("vatCode", "vatID", "XAF6008", ERROR),
    ("period", "periodNumber", "XAF6009", ERROR),
    ("journal", "jrnID journalID", "XAF6007", WARNING),
]
# FIXED VALUES: sections with declared totals, the records that they hold, and the codes of what is wrong with them
SECTIONS = {
    "transactions": (("trLine", "line"), ("XAF5007", "XAF5008", "XAF5009", "XAF5012", None)),
    "openingBalance": (("obLine",), ("XAF5004", "XAF5005", "XAF5006", "XAF5011", "XAF5013")),
}
#: notes of files that can't be read further
FATAL = ("XAF1021", "XAF2001", "XAF2002", "XAF2003")
#: lexical rules that no schema has
BESIDES = ("XAF7001", "XAF7008")
REQUIRED = {"ledgerAccount": ["accID accountID"], "customerSupplier": ["custSupID"], "transaction": ["nr transactionID"], "trLine": ["nr", "accID", "amnt", "amntTp"], "journal": ["jrnID journalID"]}


@dataclass(frozen=True)
class Report:
    """What a run found; counts are taken before any limit."""

    ok: bool
    max_severity: int | None
    counts: dict[str, int]
    stats: dict[str, int]
    findings: list[dict]
    #: the layers of rules that ran, and how many files left before the last of them
    checked: list[str]
    failed: int

    def to_json(self) -> str:
        return json.dumps({"schema_version": 1} | asdict(self), ensure_ascii=False)

    def to_text(self) -> str:
        """A line for each listed finding, and what there is in all."""
        words = {ERROR: "error", WARNING: "warning", INFO: "info"}
        said = [f"{f['file'] or '-'}:{f['line'] or 0}: {words.get(f['severity'], f['severity'])} {f['code']}: {f['message']}" for f in self.findings]
        total = sum(self.counts.values())
        more = [f"{total - len(said)} more findings are not listed"] if total > len(said) else []
        counts = ", ".join(f"{n} {name.replace('_', ' ')}" for name, n in self.stats.items() if n)
        return "\n".join([*said, *more, f"{'ok' if self.ok else 'not ok'}: {total} findings; {counts or 'no records'}", f"checked: {', '.join(self.checked)}" + f"; {self.failed} files could not be read to their end" * bool(self.failed)])


def say(*parts: str | Column) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def of_reading(files: Files) -> DataFrame:
    severity = F.create_map(*[F.lit(x) for kv in NOTED.items() for x in kv])
    rows = files.notes.withColumn("severity", F.coalesce(severity[F.col("code")], F.lit(WARNING)))
    nothing = F.lit(None).cast("string")
    return rows.select("code", "severity", "message", "file", "line", nothing.alias("path"), nothing.alias("value"))


def of_detection(files: Files) -> list[DataFrame]:
    status = lambda s: F.col("status") == s
    space, version = F.col("namespace"), F.col("version")
    rules = [
        (status("documented-variant"), "XAF3002", WARNING, say("a documented variant of the namespace"), space),
        (status("known-bogus"), "XAF3003", WARNING, say("a namespace that does not officially exist"), space),
        (status("unknown"), "XAF3004", WARNING, say("an unknown namespace"), space),
        (F.col("continuation").isNotNull(), "XAF3006", INFO, say("a continuation file", F.col("continuation")), None),
        (F.col("confidence") < 0.7, "XAF3007", WARNING, say("the version is uncertain:", version), None),
        ((F.col("confidence") >= 0.7) & (F.col("confidence") < 1), "XAF3001", INFO, say("detected as", version), None),
    ]
    return [O.several(files.files, rules, file=F.col("file"))]


def of_values(files: Files) -> list[DataFrame]:
    """Lexical rules: each (field, text) is judged in place, by built-in expressions over the exploded fields."""
    each = files.rows.filter("kind not like '#%' and kind not like 'adf%'").select("file", "line", "path", F.explode("fields").alias("name", "text"))
    each = each.filter(F.col("name").isin(DATES + MONEY_FIELDS + COUNTS + SIDES))
    s, name = F.col("text"), F.col("name")
    among = lambda names: name.isin(names)
    rules = [
        (among(DATES) & parse_date(s).isNull(), "XAF3017", ERROR, say("not a date:", name), s),
        (among(MONEY_FIELDS) & ~F.coalesce(clean(s).rlike(AMOUNT), F.lit(False)), "XAF3018", ERROR, say("not a decimal:", name), s),
        (among(COUNTS) & parse_int(s).isNull(), "XAF3019", ERROR, say("not an integer:", name), s),
        (among(SIDES) & ~F.coalesce(F.upper(clean(s)).isin("D", "C"), F.lit(False)), "XAF3015", ERROR, say("neither D nor C:", name), s),
        (among(DATES) & had_zone(s), "XAF7008", INFO, say("the time zone of a date was dropped"), s),
        (among([n for n in MONEY_FIELDS if n != "vatPerc"]) & s.rlike(r"^\s*-") & ~s.rlike(r"^\s*-[0.]*\s*$"), "XAF7001", INFO, say("negative amount:", name), s),
    ]
    return [O.several(each, rules, file=F.col("file"), line=F.col("line"), path=F.concat_ws("/", "path", "name"))]


def of_required(files: Files) -> list[DataFrame]:
    rules = [((F.col("kind") == kind) & field(*names.split()).isNull(), "XAF3010", ERROR, say(f"{kind} without {names.split()[0]}"), None) for kind, wanted in REQUIRED.items() for names in wanted]
    return [O.several(files.of(*REQUIRED), rules, file=F.col("file"), line=F.col("line"), path=F.col("path"))]


def of_masters(files: Files) -> list[DataFrame]:
    """Later definitions of an id in a file."""
    out = []
    for kind, names, code, severity in MASTERS:
        rows = files.of(kind).select("file", "line", "path", "ord", field(*names.split()).alias("id"))
        later = uniqueness.later(rows.filter("id is not null"), ["file", "id"], ["ord"])
        out.append(O.finding(later, code, severity, say(f"{kind} defined again:", F.col("id")), file=F.col("file"), line=F.col("line"), path=F.col("path"), value=F.col("id")))
    rows = files.of("ledgerAccount").select("file", "line", "path", "ord", field("RGScode").alias("code"))
    out.append(O.finding(uniqueness.later(rows.filter("code is not null"), ["file", "code"], ["ord"]), "XAF6003", WARNING, say("reference code used again:", F.col("code")), file=F.col("file"), line=F.col("line"), value=F.col("code")))
    return out


def written(files: Files) -> DataFrame:
    """(file, ord, up, kind, side, text) of every amount of a line as it is written: by its side, or in a debit and a credit field."""
    text = lambda name: clean(F.try_element_at("fields", F.lit(name)))
    each = F.array(
        F.struct(F.upper(text("amntTp")).alias("side"), text("amnt").alias("text")),
        F.struct(F.lit("D").alias("side"), text("debitAmount").alias("text")),
        F.struct(F.lit("C").alias("side"), text("creditAmount").alias("text")),
    )
    return files.of("trLine", "line", "obLine").select("file", "ord", "up", "kind", F.explode(each).alias("x")).select("file", "ord", "up", "kind", "x.*").filter("side in ('D', 'C')").filter(clean(F.col("text")).rlike(AMOUNT))


def both_sums(by: str = "text") -> list[Column]:
    """The sums of either side of written amounts, exact to eight decimals."""
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, parse_amount(F.col(by)))), F.lit(0)).cast(WIDE)
    return [of("D").alias("written_debit"), of("C").alias("written_credit")]


def plain(number: Column) -> Column:
    """A decimal without the zeros that end its fraction, but for two."""
    return F.regexp_replace(number.cast("string"), r"(\.[0-9]{2}[0-9]*?)0+$", "$1")


def unbalanced_files(files: Files, ledger: Ledger, fixed_width: bool) -> DataFrame:
    """(tx, written_debit, written_credit) of unbalanced transactions, however many digits their amounts have.

    Amounts that a decimal column holds are summed by Spark; only transactions with others go to the exact adder.
    """
    if fixed_width:
        return totals.unbalanced(ledger.lines).select("tx", *[plain(F.col(c)).alias(c) for c in ("written_debit", "written_credit")])
    rows = written(files).filter("kind <> 'obLine'").select(files.key("up").alias("tx"), "side", "text", inexact(F.col("text")).alias("odd"))
    odd = rows.filter("odd").select("tx").distinct()
    usual = rows.groupBy("tx").agg(*both_sums(), F.max("odd").alias("odd")).filter("not odd and written_debit <> written_credit")
    exact = totals.exact_unbalanced(rows.join(odd, "tx", "left_semi").select("tx", "side", F.col("text").alias("amount_text")))
    return usual.select("tx", *[plain(F.col(c)).alias(c) for c in ("written_debit", "written_credit")]).unionByName(exact)


def of_ledger(files: Files, ledger: Ledger, known: set_rules.Facts, fixed_width: bool = False) -> list[DataFrame]:
    """Rules over the frames; references to a section that can't be checked against are left to set_rules.of_unchecked."""
    heads = ledger.transactions.select("tx", F.col("number").alias("tx_number"))
    tx = lambda df: df.join(heads, "tx", "left")
    whole = lambda df: df.join(ledger.transactions.select("tx", F.col("number").alias("tx_number"), "file", "line"), "tx", "left")
    at = {"file": F.col("file"), "line": F.col("line")}
    lines, made = ledger.lines, []
    # one row: the year of the set is that of the first header by file, as the first file may have none
    year = F.broadcast(ledger.header.orderBy("file", "ord").limit(1).select("start_date", "end_date"))
    for column, master, code, section in (("account_id", ledger.accounts, "XAF4001", "generalLedger"), ("relation_id", ledger.relations, "XAF4002", "customersSuppliers"), ("vat_code", ledger.vat_codes, "XAF4003", "vatCodes")):
        if column in lines.columns and known.checkable[section]:
            rows = references.undefined(lines.select("tx", "number", "file", "line", column), column, master)
            made.append(O.finding(tx(rows), code, ERROR, say("transaction", F.col("tx_number"), f"refers to an undefined {column}:", F.col(column)), value=F.col(column), **at))
    if known.checkable["periods"]:
        made.append(O.finding(references.undefined_periods(ledger.transactions.select("tx", "number", "period_key", "file", "line"), ledger.periods, known.version == "4.0"), "XAF4004", ERROR, say("undefined period:", F.col("period_key")), value=F.col("period_key"), **at))
    if known.checkable["generalLedger"]:
        made.append(O.finding(references.undefined(ledger.journals.select("id", "offset_account_id", "file", "line"), "offset_account_id", ledger.accounts), "XAF4005", WARNING, say("journal", F.col("id"), "has an undefined offset account"), value=F.col("offset_account_id"), **at))
        vat = references.undefined_vat_accounts(ledger.vat_codes, ledger.accounts).join(ledger.vat_codes.select("id", "file", "line"), "id")
        made.append(O.finding(vat, "XAF4006", WARNING, say("VAT code", F.col("id"), "has an undefined account"), value=F.col("account_id"), **at))
    of_master = lambda rows, master: rows.join(master.select("id", "file", "line"), "id")
    # in the older XML family numbers are keys of the file
    older = known.family == "CLAIR2"
    again = uniqueness.later(ledger.transactions.filter("number is not null"), ["file", "number"] if older else ["file", "journal_id", "number"], ["ord"])
    line_again = uniqueness.later(lines.filter("number is not null"), ["file" if older else "tx", "number"], ["ord"])
    made += [
        O.finding(whole(unbalanced_files(files, ledger, fixed_width)), "XAF5010", ERROR, say("transaction", F.col("tx_number"), "does not balance: debit", F.col("written_debit"), "credit", F.col("written_credit")), **at),
        O.finding(again, "XAF6004", ERROR, say("transaction number occurs again:", F.col("number")), value=F.col("number"), **at),
        O.finding(line_again, "XAF6005", ERROR, say("line number occurs again:", F.col("number")), value=F.col("number"), **at),
        O.finding(ledger.transactions.crossJoin(year).filter("date < start_date or date > end_date"), "XAF7002", WARNING, say("transaction", F.col("number"), "is outside the fiscal year"), value=F.col("date"), **at),
        O.finding(references.outside_period(ledger.transactions, ledger.periods.select("key", "start_date", "end_date")), "XAF7003", WARNING, say("transaction", F.col("number"), "is outside its period"), value=F.col("date"), **at),
        O.finding(ledger.transactions.join(lines.select("tx"), "tx", "left_anti"), "XAF7011", WARNING, say("transaction without lines:", F.col("number")), **at),
        O.finding(of_master(tables.relations(ledger).filter("relation_kind = 'unknown' and relation_type is not null"), ledger.relations), "XAF7012", WARNING, say("unknown relation type:", F.col("relation_type")), value=F.col("relation_type"), **at),
        O.several(
            of_master(tables.accounts(ledger).filter("rgs_raw is not null"), ledger.accounts),
            [
                (F.col("rgs_placeholder"), "XAF8001", WARNING, say("placeholder instead of a reference code:", F.col("rgs_raw")), F.col("rgs_raw")),
                (F.col("rgs_code").isNull() & ~F.col("rgs_placeholder"), "XAF8002", WARNING, say("unrecognisable reference code:", F.col("rgs_raw")), F.col("rgs_raw")),
            ],
            **at,
        ),
    ]
    outside = lines.crossJoin(year).filter("effective_date < start_date or effective_date > end_date").agg(F.count("*").alias("n")).filter("n > 0")
    return made + [O.finding(outside, "XAF7010", INFO, say(F.col("n").cast("string"), "effective dates are outside the fiscal year"))]


def of_declared(both: DataFrame, what: str, codes: tuple[str, str, str | None, str, str | None]) -> DataFrame:
    """Declared debit, credit and count (rows with file and line) against the sums d and c and the number n."""
    text = lambda c: plain(F.col(c))
    rules = [
        (F.col("debit") != F.col("d"), codes[0], ERROR, say(f"{what}: declared debit", text("debit"), "is not the sum", text("d")), text("debit")),
        (F.col("credit") != F.col("c"), codes[1], ERROR, say(f"{what}: declared credit", text("credit"), "is not the sum", text("c")), text("credit")),
        (F.col("count") != F.col("n"), codes[3], ERROR, say(f"{what}: declared lines", F.col("count").cast("string"), "are not", F.col("n").cast("string")), F.col("count")),
    ]
    if codes[2]:
        rules.append((F.col("debit") != F.col("credit"), codes[2], ERROR, say(f"{what}: declared debit and credit differ"), None))
    if codes[4]:
        rules.append((F.col("d") != F.col("c"), codes[4], WARNING, say(f"{what}: its lines do not balance"), None))
    return O.several(both, rules, file=F.col("file"), line=F.col("line"))


def against(heads: DataFrame, counts: DataFrame, sums: DataFrame) -> DataFrame:
    """heads with n, d and c of their file, 0 where it holds nothing."""
    both = heads.join(counts, "file", "left").join(sums.withColumnsRenamed({"written_debit": "d", "written_credit": "c"}), "file", "left")
    return both.fillna(0, ["n"]).withColumns({x: F.coalesce(x, F.lit(0).cast(WIDE)) for x in ("d", "c")})


def of_totals(files: Files) -> list[DataFrame]:
    """Declared totals of files and opening balances against the sums of what they hold, as written."""
    out, amounts = [], written(files)
    for section, (kinds, codes) in SECTIONS.items():
        count = parse_int(field("linesCount", "numberEntries"))
        heads = files.of(section).select("file", "line", count.alias("count"), *[parse_amount(field(n)).alias(a) for n, a in (("totalDebit", "debit"), ("totalCredit", "credit"))])
        both = against(heads, files.of(*kinds).groupBy("file").agg(F.count("*").alias("n")), amounts.filter(F.col("kind").isin(*kinds)).groupBy("file").agg(*both_sums()))
        out.append(of_declared(both, section, codes))
    return out


def of_fixed_totals(files: Files) -> list[DataFrame]:
    """The totals that the header of a fixed-width file declares against the columns of its lines."""
    sums = [F.coalesce(F.sum(parse_adf_amount(field(n))), F.lit(0)).cast(WIDE).alias(a) for n, a in (("debet", "written_debit"), ("credit", "written_credit"))]
    heads = files.of("adfHeader").select("file", "line", parse_int(field("aantalMutaties")).alias("count"), parse_adf_amount(field("tellingDebet")).alias("debit"), parse_adf_amount(field("tellingCredit")).alias("credit"))
    lines = files.of("adfLine").groupBy("file")
    return [of_declared(against(heads, lines.agg(F.count("*").alias("n")), lines.agg(*sums)), "header", ("XAF5007", "XAF5008", None, "XAF5012", None))]


def of_structure(files: Files, schemas: dict[str, DataFrame]) -> list[DataFrame]:
    """Structure and values by the catalogue of each file's version; by the fields that any version has where none is given."""
    from auditloom.plans.structure_rules import structure

    version = files.files.select("file", "version")
    rows = files.rows
    out: list[DataFrame] = []
    for v, spec in schemas.items():
        own = Files(rows.join(version.filter(F.col("version") == v).select("file"), "file", "left_semi"))
        out += [structure(own, spec), *[found.filter(F.col("code").isin(*BESIDES)) for found in of_values(own)]]
    other = files if not schemas else Files(rows.join(version.filter(F.coalesce(F.col("version").isin(*schemas), F.lit(False))).select("file"), "file", "left_anti"))
    return [*out, *of_values(other), *of_required(other)]


def of_chart(ledger: Ledger, chart: DataFrame, renames: DataFrame | None) -> list[DataFrame]:
    """Reference codes of accounts against a chart (code, level) and its renamed codes (old, new)."""
    renames = renames if renames is not None else chart.sparkSession.createDataFrame([], "old string, new string")
    accounts = tables.accounts(ledger).filter("rgs_code is not null").select("id", F.col("rgs_code").alias("code"))
    wrong = rgs.checked(accounts, chart, renames).join(ledger.accounts.select("id", "file", "line"), "id")
    known = F.col("finding")
    message = (
        F.when(known == "XAF8006", say("account", F.col("id"), "has a reference code of level", F.col("hint"), "which is no account:", F.col("code")))
        .when(known == "XAF8004", say("account", F.col("id"), "has an old reference code, now", F.col("hint"), ":", F.col("code")))
        .otherwise(say("account", F.col("id"), "has a reference code that the chart lacks:", F.col("code")))
    )
    return [O.finding(wrong.filter(known == code), code, severity, message, file=F.col("file"), line=F.col("line"), value=F.col("code")) for code, severity in CHART.items()]


def failed_files(files: Files) -> DataFrame:
    """The files that could not be read to their end."""
    return files.notes.filter(F.col("code").isin(*FATAL)).select("file").distinct()


def all_findings(
    files: Files, fixed_width: bool = False, chart_release: str | None = None, *, schemas: dict[str, DataFrame] | None = None, chart: DataFrame | None = None, renames: DataFrame | None = None, failed: DataFrame | None = None
) -> DataFrame:
    """Every finding. Rules of content (references, totals, uniqueness, quality, the chart) leave out the files that failed."""
    failed = failed_files(files) if failed is None else failed
    parts = [of_reading(files), *of_detection(files)]
    if not fixed_width:
        parts += of_structure(files, schemas or {})
    sound = files if failed.isEmpty() else Files(files.rows.join(failed, "file", "left_anti"))
    if sound is files or not sound.files.isEmpty():
        ledger = sound.fixed_width() if fixed_width else sound.ledger()
        known = set_rules.facts(sound, ledger)
        parts += [*of_ledger(sound, ledger, known, fixed_width), *set_rules.of_set(sound, ledger, known, chart_release)]
        parts += of_fixed_totals(sound) if fixed_width else [*of_masters(sound), *of_totals(sound)]
        if chart is not None:
            parts += of_chart(ledger, chart, renames)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return O.distinct(out)


def layers(files: Files, failed: int, rules: str | None, schemas: dict[str, DataFrame], chart: bool) -> list[str]:
    """What runs: content is checked if a file at least can be read to its end."""
    ran = ["L1 encoding", "L2 xml", "L3 version", *["L4 structure"] * bool(schemas)]
    if files.files.count() <= failed:
        return ran
    if rules == "vts":
        return [*ran, "L6 totals (4.0 rules)", "L7 uniqueness (4.0 rules)"]
    return [*ran, "L5 references", "L6 totals", "L7 uniqueness", "L8 data quality", *["L8 RGS"] * chart]


def validate(
    files: Files, *, rules: str | None = None, severities: dict[str, int | None] | None = None, per_code: int = 100, total: int = 10_000, fixed_width: bool = False, chart_release: str | None = None,
    schemas: dict[str, DataFrame] | None = None, chart: DataFrame | None = None, renames: DataFrame | None = None,
) -> Report:
    """A bounded report; counts and verdict cover all findings, the listed ones are the first of each code.

    schemas: the catalogue (sources.catalogue) of each version that is to be checked by its schema; the files must have been read with
    elements=True. chart (code, level) and renames (old, new): a release of the reference chart. A file that can't be read to its
    end is left out of the rules of content, and the others are not.
    """
    if schemas and files.of(LEAF).isEmpty() and not files.of("auditfile").isEmpty():
        raise ValueError("schemas need files that were read with elements=True")
    failed = failed_files(files)
    n_failed = failed.count()
    found = O.overridden(all_findings(files, fixed_width, chart_release, schemas=schemas, chart=chart, renames=renames, failed=failed), severities or {})
    found = (O.service_rules(found.withColumn("code", F.substring("code", 4, 4))).withColumn("code", F.concat(F.lit("XAF"), "code")) if rules == "vts" else found).persist()
    try:
        counts = {r.code: r.findings for r in O.by_code(found).collect()}
        verdict = O.verdict(found).first()
        listed = O.limited(found, per_code, ["file", "line", "message", "value"], total).orderBy(F.desc("severity"), "file", F.coalesce("line", F.lit(0)), "code", "nth")
        rows = [r.asDict() for r in listed.drop("nth").collect()]
        kinds = {"transaction": "transactions", "trLine": "lines", "line": "lines", "ledgerAccount": "accounts", "customerSupplier": "relations", "vatCode": "vat_codes", "period": "periods", "journal": "journals", "obLine": "opening_balance_lines"}
        stats: dict[str, int] = dict.fromkeys(kinds.values(), 0)
        for r in files.of(*kinds).groupBy("kind").count().collect():
            stats[kinds[r["kind"]]] += r["count"]
        return Report(verdict["ok"], verdict["max_severity"], counts, stats, rows, layers(files, n_failed, rules, schemas or {}, chart is not None), n_failed)
    finally:
        found.unpersist()
