from __future__ import annotations

import gzip
import io
import zipfile

import pytest

from auditloom.operators import references, totals
from auditloom.sources import formats, records
from auditloom.sources.ledger import open_files

SPACE = "http://www.odb.belastingdienst.nl/Belastingdienst/BCPP/1.1/structures/XmlauditfileXAF_4.0"


def audit_file(lines: list[tuple[str, str, str]], tail: str = "</auditfile>") -> str:
    body = "".join(f"<trLine><nr>{k}</nr><accID>{a}</accID><effDate>2024-03-01</effDate><amnt>{v}</amnt><amntTp>{s}</amntTp></trLine>" for k, (a, v, s) in enumerate(lines, 1))
    return (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<auditfile xmlns="{SPACE}"><header><fiscalYear>2024</fiscalYear><startDate>2024-01-01</startDate><endDate>2024-12-31</endDate></header>'
        "<company><companyName>A &amp; Zoon</companyName><generalLedger><ledgerAccount><accID>1300</accID><accDesc>Débiteuren</accDesc><accTp>B</accTp><RGScode>BVor</RGScode></ledgerAccount>"
        "<ledgerAccount><accID>8000</accID><accDesc>Omzet</accDesc><accTp>P</accTp></ledgerAccount></generalLedger>"
        "<periods><period><periodNumber>3</periodNumber><startDatePeriod>2024-03-01</startDatePeriod><endDatePeriod>2024-03-31</endDatePeriod></period></periods>"
        "<transactions><linesCount>2</linesCount><totalDebit>10.00</totalDebit><totalCredit>10.00</totalCredit>"
        f"<journal><jrnID>VRK</jrnID><desc>Verkoop</desc><jrnTp>S</jrnTp><transaction><nr>1</nr><periodNumber>3</periodNumber><trDt>2024-03-01</trDt>{body}</transaction></journal></transactions></company>{tail}"
    )


GOOD = [("1300", "10.00", "D"), ("8000", "10.00", "C")]


def notes(files) -> set[str]:
    return {r.code for r in files.notes.collect()}


def test_a_file_becomes_a_ledger(spark, tmp_path):
    (tmp_path / "a.xaf").write_text(audit_file(GOOD), encoding="utf-8")
    files = open_files(spark, str(tmp_path), str(tmp_path / "rows"))
    ledger = files.ledger()
    assert files.files.first()["version"] == "4.0" and notes(files) == set()
    assert {(r.account_id, str(r.balance)) for r in totals.trial_balance(ledger.lines).collect()} == {("1300", "10.00"), ("8000", "-10.00")}
    assert totals.unbalanced(ledger.lines).count() == 0
    assert references.undefined(ledger.lines, "account_id", ledger.accounts).count() == 0
    assert ledger.transactions.first()["journal_id"] == "VRK"
    assert {r.rgs_raw for r in ledger.accounts.collect()} == {"BVor", None}
    assert files.declared.first()["lines_count"] == 2


@pytest.mark.parametrize("pack", ["gzip", "zip", "latin1", "utf16", "mark"])
def test_containers_and_encodings_read_alike(spark, tmp_path, pack):
    text = audit_file(GOOD)
    data = text.encode()
    if pack == "gzip":
        data = gzip.compress(data)
    elif pack == "zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.xaf", data)
        data = out.getvalue()
    elif pack == "latin1":
        data = text.replace("UTF-8", "ISO-8859-1").encode("latin-1")
    elif pack == "utf16":
        data = text.replace("UTF-8", "UTF-16").encode("utf-16")
    else:
        data = b"\xef\xbb\xbf" + data
    (tmp_path / "a.xaf").write_bytes(data)
    files = open_files(spark, str(tmp_path / "a.xaf"))
    assert {r.description for r in files.ledger().accounts.collect()} == {"Débiteuren", "Omzet"}
    assert notes(files) == {"gzip": {"XAF1020"}, "zip": {"XAF1020"}, "latin1": set(), "utf16": {"XAF1001", "XAF1003"}, "mark": {"XAF1001"}}[pack]


@pytest.mark.parametrize(
    "data,code",
    [
        (b'<?xml version="1.0"?><!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', "XAF2002"),
        (b"<a><b>" * 40, "XAF2003"),
        (b"<a><b></a>", "XAF2001"),
        (gzip.compress(b"<a>" + b" " * 50_000_000), "XAF2003"),
        (gzip.compress(b"<a></a>")[:-9], "XAF1021"),
        (b"MSCF....", "XAF1021"),
    ],
)
def test_bad_files_end_in_a_note(spark, tmp_path, data, code):
    (tmp_path / "bad.xaf").write_bytes(data)
    assert code in notes(open_files(spark, str(tmp_path / "bad.xaf")))


def test_a_cut_file_yields_what_came_before(spark, tmp_path):
    (tmp_path / "cut.xaf").write_text(audit_file(GOOD, tail=""))
    files = open_files(spark, str(tmp_path / "cut.xaf"))
    assert notes(files) == {"XAF2001"} and files.ledger().lines.count() == 2


def test_repairs_are_noted(spark, tmp_path):
    (tmp_path / "r.xaf").write_text(audit_file(GOOD).replace("&amp;", "&").replace("Omzet", "Om\x01zet"))
    assert "XAF2001" in notes(open_files(spark, str(tmp_path / "r.xaf")))
    assert notes(open_files(spark, str(tmp_path / "r.xaf"), repair=frozenset({"bare-ampersand", "control-chars"}))) == {"XAF1010", "XAF1012"}
    with pytest.raises(ValueError):
        records.read(spark, str(tmp_path), repair=frozenset({"magic"}))


def test_continuation_files_are_one_document(spark, tmp_path):
    text = audit_file(GOOD)
    cut = text.index("<trLine><nr>2")
    (tmp_path / "p1.xaf").write_text(text[:cut])
    (tmp_path / "p2.xaf").write_text('<?xml version="1.0"?><!-- Vervolgbestand 2 van 2 -->' + text[cut:])
    files = open_files(spark, str(tmp_path), documents={"p1.xaf": "set", "p2.xaf": "set"})
    assert notes(files) == set() and totals.unbalanced(files.ledger().lines).count() == 0 and files.ledger().lines.count() == 2


def test_fixed_width_lines_form_transactions(spark, tmp_path):
    def row(spec: str, **values: str) -> str:
        return "".join(values.get(n, "").ljust(b - a)[: b - a] for n, a, b in records.layout(spec))

    lines = [row(records.ADF_HEADER, versie="CLAIR1.00.00", jaarPeriode="1999")]
    for number, side, amount in (("1", "debet", "10.239,87"), ("1", "credit", "1023987"), ("2", "debet", "5,00"), ("2", "credit", "4,00")):
        lines.append(row(records.ADF_LINE, dagboekcode="M", periode="1", volgnummer=number, grootboekrekeningcode="1300", mutatiedatum="01-01-1999", **{side: amount}))
    (tmp_path / "old.adf").write_bytes("\r\n".join(lines).encode("cp1252") + b"\x1a")
    ledger = open_files(spark, str(tmp_path / "old.adf")).fixed_width()
    assert ledger.transactions.count() == 2
    assert [(str(r.written_debit), str(r.written_credit)) for r in totals.unbalanced(ledger.lines).collect()] == [("5.00", "4.00")]


def test_versions_are_told_by_their_vocabulary():
    names = {"3.1": frozenset("auditfile header company trLine nr".split()), "4.0": frozenset("auditfile header company trLine nr RGScode Commercenr".split()), "CLAIR2": frozenset("auditfile header line recordID".split())}
    say = lambda root, *inside: f"<auditfile{root}><header/><company><{'/><'.join(inside)}/></company></auditfile>".encode()
    told = lambda *args: (lambda d: (d["version"], d["confidence"], d["status"]))(formats.detect(say(*args), "utf-8", names))
    assert told("", "RGScode") == ("4.0", "0.5", "none") and told("", "trLine") == ("3.1", "0.5", "none")
    assert told(' xmlns="urn:x"', "RGScode", "other") == ("4.0", "0.3", "unknown")
    official, bogus = ' xmlns="http://www.auditfiles.nl/XAF/3.1"', ' xmlns="HTTP://www.auditfiles.nl/XAF/4.0/"'
    assert told(official, "trLine") == ("3.1", "1.0", "official") and told(official, "RGScode") == ("3.1", "0.6", "official")
    assert told(bogus, "RGScode") == ("4.0", "0.7", "known-bogus") and told(bogus, "recordID")[0] == "4.0"
    assert formats.detect(say("", "trLine"), "utf-8")["version"] == "3.2"


def test_encodings_that_a_version_forbids(spark, tmp_path):
    text = audit_file(GOOD)
    (tmp_path / "w.xaf").write_bytes(text.replace('encoding="UTF-8"', 'encoding="windows-1252"').encode("cp1252"))
    (tmp_path / "l.xaf").write_bytes(text.replace('encoding="UTF-8"', 'encoding="ISO-8859-1"').encode("latin-1"))
    assert notes(open_files(spark, str(tmp_path / "w.xaf"))) == {"XAF1003"} and notes(open_files(spark, str(tmp_path / "l.xaf"))) == set()
    assert notes(open_files(spark, str(tmp_path / "w.xaf"), encoding="cp1252")) == {"XAF1004"}
