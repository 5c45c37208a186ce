"""Rules over sets of files: each change brings up the code that it is named for."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.findings import by_code
from auditloom.plans import set_rules
from auditloom.plans.validate import of_ledger, of_reading, validate
from auditloom.sources.formats import misnumbered
from auditloom.sources.ledger import open_files
from tests.test_sources import GOOD, audit_file
from tests.test_validate import OPENING

CLEAN = audit_file(GOOD).replace("<transactions>", OPENING + "<transactions>")
START = CLEAN[: CLEAN.index("<generalLedger>")]
MASTERS = CLEAN[len(START) : CLEAN.index("<openingBalance>")]
ALONE = {
    "XAF1002": CLEAN.split("\n", 1)[1],
    "XAF1013": CLEAN + "<!-- fine -->\nrubbish",
    "XAF3030": CLEAN.replace("</transactions>", "</transactions><vatCodes><vatCode><vatID>H</vatID><vatDesc>High</vatDesc></vatCode></vatCodes>"),
    "XAF4007": CLEAN.replace("<nr>1</nr><accID>1300</accID><amnt>", "<nr>1</nr><accID>77</accID><amnt>"),
    "XAF4008": START + CLEAN[CLEAN.index("<periods>") :],
    "XAF6006": CLEAN.replace("<nr>2</nr><accID>8000</accID><amnt>", "<nr>1</nr><accID>8000</accID><amnt>"),
    "XAF7004": CLEAN.replace("<periodNumber>3</periodNumber><trDt>", "<periodNumber>0</periodNumber><trDt>"),
    "XAF7005": CLEAN.replace("<jrnTp>S", "<jrnTp>O"),
    "XAF7006": audit_file(GOOD),
    "XAF7007": CLEAN.replace("<fiscalYear>2024", "<fiscalYear>2019-2020"),
    "XAF7013": CLEAN.replace("</transactions>", "<line><debitAmount>3.00</debitAmount><creditAmount>1.00</creditAmount></line></transactions>"),
}
IDENT = "<companyIdent>1</companyIdent><companyName>"
PAIRS = {
    "XAF3008": (CLEAN, CLEAN.replace("http://www.odb.belastingdienst.nl/Belastingdienst/BCPP/1.1/structures/XmlauditfileXAF_4.0", "http://www.auditfiles.nl/XAF/3.2")),
    "XAF6010": (CLEAN, CLEAN.replace("Omzet", "Turnover")),
    "XAF6011": (CLEAN.replace("<companyName>", IDENT), CLEAN.replace("<companyName>", IDENT.replace(">1<", ">2<"))),
}


def codes(files, chart_release: str | None = None) -> dict[str, int]:
    """What reading and the rules over sets bring up: the other rules have their own tests."""
    ledger = files.ledger()
    parts = [of_reading(files), *set_rules.of_set(files, ledger, set_rules.facts(files, ledger), chart_release)]
    found = {r.code: r.findings for r in by_code(reduce(DataFrame.unionByName, parts)).collect()}
    files.rows.unpersist()
    return found


@pytest.mark.parametrize("code", sorted(ALONE))
def test_alone(spark, tmp_path, code):
    (tmp_path / "a.xaf").write_text(ALONE[code])
    found = codes(open_files(spark, str(tmp_path / "a.xaf")))
    assert found[code] == 1
    if code in ("XAF1013", "XAF1002", "XAF7006", "XAF7007"):
        assert set(found) == {code}


def test_missing_sections_are_not_checked_against(spark, tmp_path):
    (tmp_path / "a.xaf").write_text(ALONE["XAF4008"])
    report = validate(open_files(spark, str(tmp_path / "a.xaf")))
    assert report.counts == {"XAF4008": 1} and report.ok and report.findings[0]["message"].startswith("4 references")


@pytest.mark.parametrize("code", sorted(PAIRS))
def test_pairs(spark, tmp_path, code):
    for name, text in zip("ab", PAIRS[code], strict=True):
        (tmp_path / f"{name}.xaf").write_text(text)
    found = codes(open_files(spark, str(tmp_path)))
    assert found[code] == 1
    assert {"XAF3008", "XAF6010", "XAF6011"} & set(found) == {code}


def test_company_names_alone_only_warn(spark, tmp_path):
    (tmp_path / "a.xaf").write_text(CLEAN)
    (tmp_path / "b.xaf").write_text(CLEAN.replace("A &amp; Zoon", "B &amp; Zoon"))
    files = open_files(spark, str(tmp_path))
    rules = set_rules.of_agreement(files, set_rules.facts(files, files.ledger()))
    found = reduce(DataFrame.unionByName, rules).collect()
    assert [(r.code, r.severity) for r in found] == [("XAF6011", 20)]


def test_release_of_the_reference_chart(spark, tmp_path):
    (tmp_path / "a.xaf").write_text(CLEAN.replace("<fiscalYear>", "<RGSVersion>RGS 3.70</RGSVersion><fiscalYear>"))
    files = open_files(spark, str(tmp_path))
    assert [codes(files, r) for r in ("3.70", "3.8", None)] == [{}, {"XAF8005": 1}, {}]


def test_numbers_of_continuations():
    part = lambda x, y: f"<!-- Vervolgbestand {x} van {y} --><trLine/>".encode()
    assert misnumbered([b"<a>", part(2, 3), part(3, 3)]) == "" and misnumbered([b"<a>", b"</a>"]) == ""
    assert misnumbered([b"<a>", part(3, 3), part(2, 3)]) and misnumbered([b"<a>", part(2, 9)])


def test_wrong_numbers_are_noted(spark, tmp_path):
    head, tail = CLEAN.split("<transactions>")
    (tmp_path / "a1.xaf").write_text(head)
    (tmp_path / "a2.xaf").write_text("<!-- Vervolgbestand 4 van 4 --><transactions>" + tail)
    files = open_files(spark, str(tmp_path), documents={"a1.xaf": "a", "a2.xaf": "a"})
    assert {r.code for r in files.notes.collect()} == {"XAF3009"} and files.of("trLine").count() == 2


def test_the_year_is_that_of_the_first_file(spark, tmp_path):
    """The second file is of the year before and the larger one, so it is scanned first."""
    old = CLEAN.replace("2024-", "2023-").replace("<fiscalYear>2024", "<fiscalYear>2023")
    (tmp_path / "a.xaf").write_text(CLEAN)
    (tmp_path / "b.xaf").write_text(old.replace("</auditfile>", f"<!-- {'x' * 100_000} --></auditfile>"))
    files = open_files(spark, str(tmp_path))
    ledger = files.ledger()
    known = set_rules.facts(files, ledger)
    for first in ledger.header.orderBy(F.desc("start_date")), ledger.header.orderBy("start_date"):
        found = reduce(DataFrame.unionByName, of_ledger(files, replace(ledger, header=first), known)).filter("code in ('XAF7002', 'XAF7010')")
        assert {(r.code, r.value or r.message.split()[0]) for r in found.collect()} == {("XAF7002", "2023-03-01"), ("XAF7010", "2")}
    files.rows.unpersist()
