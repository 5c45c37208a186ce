from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

import pytest

from auditloom.operators import rgs
from auditloom.sources.workbook import column_number, load_chart

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets: dict[str, list[list[str | None]]], extra: str = "") -> None:
    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f"{extra}<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(names))) + "</Relationships>")
        shared: list[str] = []
        for k, rows in enumerate(sheets.values()):
            out = ""
            for n, row in enumerate(rows, 1):
                cells = ""
                for c, text in enumerate(row):
                    if text is not None:
                        cells += f'<c r="{chr(65 + c)}{n}" t="s"><v>{len(shared)}</v></c>'
                        shared.append(text)
                out += f'<row r="{n}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {NS}><sheetData>{out}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")


MAIN = [["Chart", None], ["Referentiecode", "Omschrijving", "Nivo", "Basis", "ZZP"], ["B", "Balans", "1", "1", None], ["BVoo", "Voorraden", "2", "1", "nee"], ["BVooGro", "Grondstoffen", "3", None, "1"], ["BVooGroMat", "Waarde", "4", None, None], ["BVoo", "again", "2", None, None], [None, "Totaal", None, None, None]]
COMPARED = [["Referentiecode", "Referentiecode", "Referentiecode"], ["BVooHou", "BVooGroMat", "BVooGroMat"], ["BVoo", "BVoo", "BVoo"]]


def test_chart_renames_and_checks(spark, tmp_path):
    path = tmp_path / "chart.xlsx"
    workbook(path, {"Uitleg": [["text"]], "Totaal": MAIN, "Vergelijking": COMPARED})
    chart, renames = load_chart(spark, str(path))
    assert {(r.code, r.level, tuple(r.entities)) for r in chart.collect()} == {("B", 1, ("Basis",)), ("BVoo", 2, ("Basis",)), ("BVooGro", 3, ("ZZP",)), ("BVooGroMat", 4, ())}
    assert [(r.old, r.new) for r in renames.collect()] == [("BVooHou", "BVooGroMat")]
    refs = spark.createDataFrame([("1", "BVooGroMat"), ("2", "BVooHou"), ("3", "BVooNie"), ("4", "BVoo"), ("5", None)], "id string, code string")
    assert {(r.id, r.finding, r.hint) for r in rgs.checked(refs, chart, renames).collect()} == {("2", "XAF8004", "BVooGroMat"), ("3", "XAF8003", "BVoo"), ("4", "XAF8006", "2")}


def test_declarations_are_refused(spark, tmp_path):
    workbook(tmp_path / "bad.xlsx", {"a": MAIN}, extra="<!DOCTYPE x>")
    with pytest.raises(ValueError):
        load_chart(spark, str(tmp_path / "bad.xlsx"))


def test_cell_addresses():
    assert [column_number(a) for a in ("A1", "Z1", "AB12", "XFD1")] == [0, 25, 27, 16_383]
    with pytest.raises(ValueError):
        column_number("XFE1")
