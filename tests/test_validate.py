"""One defect, one code: each change to a clean file must bring up the code that it is named for, and the clean file none."""

from __future__ import annotations

import json

import pytest

from auditloom.__main__ import main
from auditloom.operators.export import export
from auditloom.operators.findings import by_code
from auditloom.operators.totals import trial_balance
from auditloom.plans.file_tables import FileTables
from auditloom.plans.validate import all_findings, validate
from auditloom.sources import records
from auditloom.sources.ledger import open_files
from auditloom.streaming.arrivals import each_batch, running_balances
from tests.test_sources import GOOD, audit_file

OPENING = "<openingBalance><obLine><nr>1</nr><accID>1300</accID><amnt>5.00</amnt><amntTp>D</amntTp></obLine><obLine><nr>2</nr><accID>8000</accID><amnt>5.00</amnt><amntTp>C</amntTp></obLine></openingBalance>"

DEFECTS = [
    ("<accID>1300</accID><effDate>", "<accID>9999</accID><effDate>", "XAF4001"),
    ("<amnt>10.00</amnt><amntTp>D", "<amnt>11.00</amnt><amntTp>D", "XAF5010"),
    ("<totalDebit>10.00", "<totalDebit>12.00", "XAF5007"),
    ("<totalCredit>10.00", "<totalCredit>12.00", "XAF5008"),
    ("<totalCredit>10.00", "<totalCredit>12.00", "XAF5009"),
    ("<linesCount>2", "<linesCount>3", "XAF5012"),
    ("<accID>8000</accID><accDesc>", "<accID>1300</accID><accDesc>", "XAF6002"),
    ("<trLine><nr>2<", "<trLine><nr>1<", "XAF6005"),
    ("<periodNumber>3</periodNumber><trDt>", "<periodNumber>9</periodNumber><trDt>", "XAF4004"),
    ("<trDt>2024-03-01", "<trDt>2023-03-01", "XAF7002"),
    ("<trDt>2024-03-01", "<trDt>2024-04-01", "XAF7003"),
    ("<effDate>2024-03-01", "<effDate>2025-03-01", "XAF7010"),
    ("<trDt>2024-03-01", "<trDt>2024-03-01Z", "XAF7008"),
    ("<trDt>2024-03-01", "<trDt>2024-02-30", "XAF3017"),
    ("<amnt>10.00</amnt><amntTp>D", "<amnt>1e1</amnt><amntTp>D", "XAF3018"),
    ("<linesCount>2", "<linesCount>two", "XAF3019"),
    ("<amntTp>D", "<amntTp>X", "XAF3015"),
    ("<amnt>10.00</amnt><amntTp>D", "<amnt>-10.00</amnt><amntTp>C", "XAF7001"),
    ("<nr>1</nr><periodNumber>", "<periodNumber>", "XAF3010"),
    ("<RGScode>BVor", "<RGScode>0000", "XAF8001"),
    ("<RGScode>BVor", "<RGScode>1234", "XAF8002"),
    ("Belastingdienst/BCPP/1.1/structures/XmlauditfileXAF_4.0", "xaf/4.0", "XAF3002"),
    ("</company>", "", "XAF2001"),
]


@pytest.fixture(scope="module")
def codes_of(spark, tmp_path_factory):
    """The codes that each defect brings up, from one plan over a file for each."""
    folder = tmp_path_factory.mktemp("files")
    clean = audit_file(GOOD).replace("<transactions>", OPENING + "<transactions>")  # which version 4.0 asks for
    out = {}
    for k, (old, new, code) in enumerate([("", "", "clean"), *DEFECTS]):
        text = clean.replace(old, new, 1) if old else clean
        assert not old or text != clean, code
        (folder / f"{k}.xaf").write_text(text)
        out[k] = str(folder / f"{k}.xaf")
    return out


def test_a_clean_file_has_no_findings(spark, codes_of):
    report = validate(open_files(spark, codes_of[0]))
    assert report.ok and report.counts == {} and report.stats["lines"] == 2 and report.stats["accounts"] == 2


@pytest.mark.parametrize("k", range(1, len(DEFECTS) + 1), ids=[d[2] for d in DEFECTS])
def test_a_defect_is_found(spark, codes_of, k):
    files = open_files(spark, codes_of[k])
    found = {r.code for r in by_code(all_findings(files)).collect()}
    files.rows.unpersist()
    assert DEFECTS[k - 1][2] in found


def test_service_rules_and_overrides(spark, codes_of):
    files = open_files(spark, codes_of[1])
    assert set(validate(files).counts) == {"XAF4001"}
    assert validate(files, rules="vts").counts == {}
    assert validate(files, severities={"XAF4001": None}).ok and validate(files, severities={"XAF4001": 10}).max_severity == 10
    assert json.loads(validate(files).to_json())["schema_version"] == 1


def test_export_and_command_line(spark, codes_of, tmp_path, capsys):
    ledger = open_files(spark, codes_of[0]).ledger()
    for kind in ("csv", "jsonl", "parquet"):
        assert "lines" in export(ledger, str(tmp_path / kind), kind, ["lines", "header"])
    text = next((tmp_path / "csv" / "lines").glob("part-*")).read_bytes()
    assert text.count(b"\r\n") == 3 and b"10.00" in text
    assert '"amount":"10.00"' in next((tmp_path / "jsonl" / "lines").glob("part-*")).read_text()
    with pytest.raises(KeyError):
        export(ledger, str(tmp_path), "csv", ["nothing"])
    with pytest.raises(ValueError):
        export(ledger, str(tmp_path), "xml")
    assert main(["validate", codes_of[0]]) == 0 and main(["validate", codes_of[1]]) == 1
    assert main(["detect", codes_of[0]]) == 0 and main(["info", codes_of[0]]) == 0
    assert '"version": "4.0"' in capsys.readouterr().out


def test_streams_follow_the_same_rules(spark, codes_of, tmp_path):
    lines = open_files(spark, codes_of[0]).ledger().lines
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    each_batch(stream, trial_balance, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    query = running_balances(stream).writeStream.format("memory").queryName("balances").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {str(r.balance) for r in spark.table("balances").collect()} == {"10.00", "-10.00"}


CLAIR2 = (
    '<?xml version="1.0" encoding="UTF-8"?><auditfile><header><auditfileVersion>CLAIR2.00.00</auditfileVersion><companyName>C</companyName><fiscalYear>2003</fiscalYear><startDate>2003-01-01</startDate><endDate>2003-12-31</endDate></header>'
    "<generalLedger><ledgerAccount><accountID>1</accountID><accountDesc>Kas</accountDesc></ledgerAccount><ledgerAccount><accountID>2</accountID><accountDesc>Omzet</accountDesc></ledgerAccount></generalLedger><customersSuppliers></customersSuppliers>"
    "<transactions><numberEntries>4</numberEntries><totalDebit>8.50</totalDebit><totalCredit>8.50</totalCredit><journal><journalID>M</journalID><description>Memo</description><type>Memo</type>"
    "<transaction><transactionID>1</transactionID><period>0</period><transactionDate>2003-01-02</transactionDate>"
    "<line><recordID>1</recordID><accountID>1</accountID><debitAmount>5.00</debitAmount></line><line><recordID>2</recordID><accountID>2</accountID><creditAmount>5.00</creditAmount></line></transaction>"
    "<transaction><transactionID>2</transactionID><period>0</period><transactionDate>2003-02-02</transactionDate>"
    "<line><recordID>3</recordID><accountID>2</accountID><debitAmount>3.50</debitAmount></line><line><recordID>4</recordID><accountID>1</accountID><creditAmount>3.50</creditAmount></line></transaction></journal></transactions></auditfile>"
)


def found(spark, path) -> list:
    files = open_files(spark, str(path))
    try:
        return all_findings(files, files.files.first()["family"] == "ADF").collect()
    finally:
        files.rows.unpersist()


def test_the_older_form(spark, tmp_path):
    (tmp_path / "a.xml").write_text(CLAIR2)
    assert {r.code for r in found(spark, tmp_path / "a.xml") if r.severity >= 20} == set()
    # a debit that is not declared, a record number of another transaction, and a transaction that no longer balances
    bad = CLAIR2.replace("<debitAmount>3.50", "<debitAmount>3.75").replace("<recordID>3<", "<recordID>1<").replace("<numberEntries>4", "<numberEntries>2")
    (tmp_path / "b.xml").write_text(bad)
    codes = {r.code for r in found(spark, tmp_path / "b.xml")}
    assert {"XAF5007", "XAF5010", "XAF5012", "XAF6005"} <= codes and "XAF5008" not in codes


def test_fixed_width_totals(spark, tmp_path):
    def row(spec: str, **values: str) -> str:
        return "".join(values.get(n, "").ljust(b - a)[: b - a] for n, a, b in records.layout(spec))

    lines = [row(records.ADF_LINE, dagboekcode="M", periode="1", volgnummer="1", regelnummer=str(k), grootboekrekeningcode="1300", mutatiedatum="01-01-1999", **{side: "10,00"}) for k, side in enumerate(("debet", "credit"))]
    for name, count, debit in (("good", "2", "10,00"), ("bad", "3", "11,00")):
        head = row(records.ADF_HEADER, versie="CLAIR1.00.00", jaarPeriode="1999", aantalMutaties=count, tellingDebet=debit, tellingCredit="10,00")
        (tmp_path / f"{name}.adf").write_bytes("\r\n".join([head, *lines]).encode("cp1252"))
    assert not {r.code for r in found(spark, tmp_path / "good.adf")} & {"XAF5007", "XAF5008", "XAF5010", "XAF5012"}
    assert {r.code for r in found(spark, tmp_path / "bad.adf")} >= {"XAF5007", "XAF5012"}


def test_digits_beyond_cents_and_places_of_findings(spark, tmp_path):
    text = audit_file(GOOD).replace("<transactions>", OPENING + "<transactions>").replace("><", ">\n<")
    long = text.replace("<amnt>10.00</amnt>", "<amnt>10.00" + "0" * 30 + "1</amnt>", 1)
    cents = text.replace("<amnt>10.00</amnt>", "<amnt>10.004</amnt>", 1)
    twice = text.replace("</transaction>", "</transaction>\n" + text[text.index("<transaction>\n") : text.index("</transaction>")] + "</transaction>" * 1, 1)
    at = text[: text.index("<transaction>\n")].count("\n") + 1
    for name, changed, code in (("long", long, "XAF5010"), ("cents", cents, "XAF5010"), ("twice", twice, "XAF6004")):
        (tmp_path / f"{name}.xaf").write_text(changed)
        places = [(r.file.rpartition("/")[2], r.line) for r in found(spark, tmp_path / f"{name}.xaf") if r.code == code]
        assert places == [(f"{name}.xaf", at if code == "XAF5010" else twice[: twice.rindex("<transaction>\n")].count("\n") + 1)], (name, places)


def test_the_twelve_tables_are_written_in_order(spark, codes_of, tmp_path):
    made = FileTables(open_files(spark, codes_of[0])).all()
    assert len(export(made, str(tmp_path / "p"), "parquet")) == 12
    back = spark.read.parquet(str(tmp_path / "p" / "lines"))
    assert back.columns == made["lines"].columns and [r.seq for r in back.collect()] == [0, 1]
    assert spark.read.parquet(str(tmp_path / "p" / "opening_balance")).count() == 2 and spark.read.parquet(str(tmp_path / "p" / "company")).first()["name"] == "A & Zoon"
    assert main(["export", codes_of[0], "-o", str(tmp_path / "c"), "-f", "csv", "--one-file"]) == 0
    assert len(list((tmp_path / "c" / "lines").glob("part-*"))) == 1
    assert main(["validate", codes_of[0], "-o", str(tmp_path / "report.json")]) == 0 and json.loads((tmp_path / "report.json").read_text())["ok"]
