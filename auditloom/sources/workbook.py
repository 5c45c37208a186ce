"""The reference chart of accounts from a workbook: tens of thousands of rows at most, so it is read on the driver.

Spark fetches the bytes, so the workbook may lie in any file system; what comes out are two small tables.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

# FIXED VALUES: bounds on hostile workbooks, namespaces of the format, header texts by field
MOST, COLUMNS, ROWS = 200 << 20, 16_384, 1_048_576
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
HEADERS = {
    "referentiecode": "code", "rgscode": "code", "referentieomslagcode": "opposite_code", "omslagcode": "opposite_code", "sortering": "sort_key", "referentienummer": "reference_number",
    "omschrijvingverkort": "short_description", "verkorteomschrijving": "short_description", "omschrijving": "description", "dc": "debit_credit", "debetcredit": "debit_credit", "debitcredit": "debit_credit",
    "nivo": "level", "niveau": "level", "level": "level",
}
CHART = "code string, level int, description string, short_description string, debit_credit string, sort_key string, reference_number string, opposite_code string, entities array<string>"
UNSET = {"", "0", "false", "nee", "n", "no"}


def column_number(address: str) -> int:
    """0-based column of a cell address; beyond XFD is an error."""
    n = 0
    for c in re.match("[A-Z]*", address)[0]:
        n = 26 * n + ord(c) - 64
    if not 1 <= n <= COLUMNS:
        raise ValueError(f"no such cell: {address!r}")
    return n - 1


class Workbook:
    def __init__(self, data: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(data))
        rels = {r.get("Id"): r.get("Target", "") for r in self._tree("xl/_rels/workbook.xml.rels")}
        sheets = self._tree("xl/workbook.xml").iter(f"{MAIN}sheet")
        self.sheets = {s.get("name", ""): "xl/" + rels[s.get(LINK)].removeprefix("/xl/") for s in sheets}
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.archive.namelist():
            self.shared = ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in self._tree("xl/sharedStrings.xml").iter(f"{MAIN}si")]

    def _member(self, name: str) -> bytes:
        if self.archive.getinfo(name).file_size > MOST:
            raise ValueError(f"{name} is larger than {MOST} bytes")
        data = self.archive.read(name)
        if re.search(rb"<!(DOCTYPE|ENTITY)", data):
            raise ValueError(f"{name} has a DOCTYPE or ENTITY declaration, which is refused")
        return data

    def _tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self._member(name))

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, str]]]:
        """(row number, cells by column) of the rows that are there; gaps take no memory."""
        number = 0
        for row in self._tree(self.sheets[sheet]).iter(f"{MAIN}row"):
            new = int(row.get("r") or number + 1)
            if new < number or new > ROWS:
                raise ValueError(f"row {new} is out of order or beyond {ROWS}")
            number, cells, at = new, {}, -1
            for cell in row.iter(f"{MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else at + 1
                value, kind = cell.find(f"{MAIN}v"), cell.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    text = self.shared[int(value.text)]
                else:
                    text = {"0": "FALSE", "1": "TRUE"}.get(value.text, value.text) if kind == "b" else value.text
                if text.strip():
                    cells[at] = text.strip()
            yield number, cells


def plain(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalnum())


def header_of(book: Workbook, sheet: str) -> tuple[int, dict[int, str]] | None:
    """The first of ten rows with a column of reference codes."""
    for number, cells in book.rows(sheet):
        if number > 10:
            return None
        if any(HEADERS.get(plain(t)) == "code" for t in cells.values()):
            return number, cells
    return None


def load_chart(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chart, renames (old, new)): the sheet with one column of codes, preferably a total, and the sheet that compares releases."""
    book = Workbook(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    heads = {s: h for s in book.sheets if (h := header_of(book, s))}
    codes = lambda h: [c for c, t in sorted(h[1].items()) if HEADERS.get(plain(t)) == "code"]
    single = [s for s, h in heads.items() if len(codes(h)) == 1]
    if not single:
        raise ValueError("no sheet with a column of reference codes")
    main = max(single, key=lambda s: (s.casefold().startswith("totaal"), sum(1 for _ in book.rows(s))))
    start, names = heads[main]
    fields = {c: HEADERS[plain(t)] for c, t in names.items() if plain(t) in HEADERS}
    chart: dict[str, tuple] = {}
    for number, cells in book.rows(main):
        if number <= start:
            continue
        got = {f: cells[c] for c, f in fields.items() if c in cells}
        code = got.get("code", "")
        if not re.fullmatch(r"[BW][A-Za-z0-9]*", code) or code in chart:
            continue  # empty rows, totals, and later definitions of a code
        level = got.get("level", "")
        marks = sorted(t for c, t in names.items() if c not in fields and cells.get(c, "").casefold() not in UNSET)
        chart[code] = (code, int(float(level)) if re.fullmatch(r"[0-9]+(\.0*)?", level) else None, *(got.get(f) for f in "description short_description debit_credit sort_key reference_number opposite_code".split()), marks)
    renames: dict[str, str] = {}
    for sheet, (start, _) in ((s, h) for s, h in heads.items() if len(codes(h)) > 1):
        columns = codes(heads[sheet])
        for number, cells in book.rows(sheet):
            row = [cells.get(c) for c in columns]
            if number > start and row[-1]:
                renames |= {old: row[-1] for old in row[:-1] if old and old != row[-1] and old not in chart}
    return spark.createDataFrame(list(chart.values()), CHART), spark.createDataFrame(list(renames.items()), "old string, new string")
