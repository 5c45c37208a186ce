"""Layers of rules by file, schemas and charts inside validate, and reports as text."""

from __future__ import annotations

import pytest

from auditloom.__main__ import main
from auditloom.plans.validate import validate
from auditloom.sources.catalogue import catalogue
from auditloom.sources.ledger import open_files

from .test_sources import GOOD, audit_file
from .test_structure import DEFECTS, SCHEMA
from .test_structure import GOOD as PLAIN
from .test_validate import OPENING


def test_a_broken_file_leaves_the_rules_of_content(spark, tmp_path):
    clean = audit_file(GOOD).replace("<transactions>", OPENING + "<transactions>")
    odd = clean.replace("<amnt>10.00</amnt><amntTp>C", "<amnt>11.00</amnt><amntTp>C")
    assert odd != clean
    (tmp_path / "a.xaf").write_text(odd)
    (tmp_path / "b.xaf").write_text(odd.replace("</company>", "").replace("<accID>1300</accID><effDate>", "<accID>9999</accID><effDate>"))
    both = validate(open_files(spark, str(tmp_path)))
    of = lambda report, name: {f["code"] for f in report.findings if (f["file"] or "").endswith(name)}
    assert "XAF5010" in of(both, "a.xaf") and "XAF2001" in of(both, "b.xaf") and not {"XAF5010", "XAF4001"} & of(both, "b.xaf")
    assert "L5 references" in both.checked and "L6 totals" in both.checked and both.failed == 1
    alone = validate(open_files(spark, str(tmp_path / "b.xaf")))
    assert alone.checked == ["L1 encoding", "L2 xml", "L3 version"] and alone.failed == 1 and not alone.ok
    assert not {"XAF5010", "XAF4001"} & set(alone.counts)
    service = validate(open_files(spark, str(tmp_path / "a.xaf")), rules="vts")
    assert "L5 references" not in service.checked and "L6 totals (4.0 rules)" in service.checked
    said = both.to_text().split("\n")
    assert any("b.xaf" in x and "error XAF2001" in x for x in said) and said[-1].endswith("1 files could not be read to their end") and said[-2].startswith("not ok: ")


def test_schemas_inside_validate(spark, tmp_path):
    (tmp_path / "s.xsd").write_text(SCHEMA)
    folder = tmp_path / "files"
    folder.mkdir()
    for k, (old, new, _) in enumerate([("", "", set()), *DEFECTS]):
        text = PLAIN.replace(old, new, 1) if old else PLAIN
        (folder / f"{k:02}.xml").write_text(text.replace("<auditfile>", "<auditfile xmlns='http://www.auditfiles.nl/XAF/3.1'>"))
    files = open_files(spark, str(folder), elements=True)
    report = validate(files, schemas={"3.1": catalogue(spark, str(tmp_path / "s.xsd"))})
    layer4 = {f"XAF30{n}" for n in range(10, 22)}
    got: dict[str, set] = {}
    for f in report.findings:
        if f["code"] in layer4:
            got.setdefault(f["file"][-6:-4], set()).add(f["code"])
    assert got == {f"{k:02}": codes for k, (_, _, codes) in enumerate(DEFECTS, 1)} and "L4 structure" in report.checked
    with pytest.raises(ValueError, match="elements"):
        validate(open_files(spark, str(folder / "00.xml")), schemas={"3.1": catalogue(spark, str(tmp_path / "s.xsd"))})


def test_a_chart_inside_validate(spark, tmp_path, capsys):
    clean = audit_file(GOOD).replace("<transactions>", OPENING + "<transactions>")
    more = "".join(f"<ledgerAccount><accID>9{k}</accID><accDesc>x</accDesc><accTp>B</accTp><RGScode>{c}</RGScode></ledgerAccount>" for k, c in enumerate(["BVorDeb", "BOld", "BVorXyz"]))
    (tmp_path / "a.xaf").write_text(clean.replace("</generalLedger>", more + "</generalLedger>"))
    chart = spark.createDataFrame([("BVor", 2), ("BVorDeb", 4), ("BNew", 4)], "code string, level int")
    renames = spark.createDataFrame([("BOld", "BNew")], "old string, new string")
    report = validate(open_files(spark, str(tmp_path / "a.xaf")), chart=chart, renames=renames)
    assert {(f["code"], f["value"]) for f in report.findings if f["code"].startswith("XAF80")} == {("XAF8006", "BVor"), ("XAF8004", "BOld"), ("XAF8003", "BVorXyz")}
    assert report.checked[-1] == "L8 RGS"
    assert main(["validate", "--text", str(tmp_path / "a.xaf")]) == 0
    assert "checked: L1 encoding, L2 xml, L3 version, L5 references" in capsys.readouterr().out
