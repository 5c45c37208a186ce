from __future__ import annotations

import pytest

from auditloom.plans.file_tables import FileTables
from auditloom.sources.ledger import open_files
from tests.test_sources import GOOD, audit_file

WIDTHS = {"header": 11, "company": 5, "addresses": 12, "accounts": 13, "relations": 15, "vat_codes": 5, "periods": 6, "journals": 8, "transactions": 13, "lines": 36, "line_vat": 8, "opening_balance": 11}
EXTRA = (
    "<streetAddress><streetname>Hoofdstraat</streetname><city>Utrecht</city></streetAddress><postalAddress><city>Delft</city></postalAddress><customersSuppliers><customerSupplier><custSupID>D1</custSupID><custSupName>Klant</custSupName>"
    "<custSupTp>C</custSupTp><opBalDesc>100.00</opBalDesc><opBalTp>C</opBalTp><streetAddress><city>Breda</city></streetAddress></customerSupplier></customersSuppliers><generalLedger>"
)
VAT = "<vat><vatID>H</vatID><vatPerc>21.000</vatPerc><vatAmnt>2.10</vatAmnt><vatAmntTp>C</vatAmntTp></vat><currency><curCode>USD</curCode><curAmnt>11.00</curAmnt></currency></trLine>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sets")
    text = audit_file(GOOD).replace("<generalLedger>", EXTRA, 1).replace("</trLine>", VAT, 1)
    (folder / "a.xaf").write_text(text)
    (folder / "b.xaf").write_text(text.replace("<nr>1</nr><periodNumber>3", "<nr>2</nr><periodNumber>0").replace("Débiteuren", "Anders"))
    return FileTables(open_files(spark, str(folder))).all()


def test_widths(tables):
    assert {n: len(df.columns) for n, df in tables.items()} == WIDTHS


def test_numbers_go_on_across_files(tables):
    lines = sorted(tables["lines"].collect(), key=lambda r: r.seq)
    assert [(r.seq, r.transaction_seq, r.file, r.vat_count) for r in lines] == [(0, 0, 0, 1), (1, 0, 0, 0), (2, 1, 1, 1), (3, 1, 1, 0)]
    assert lines[0].foreign_currency == "USD" and str(lines[0].foreign_amount) == "11.00" and str(lines[1].signed_amount) == "-10.00"
    assert [(r.seq, r.line_count, str(r.total_debit)) for r in sorted(tables["transactions"].collect(), key=lambda r: r.seq)] == [(0, 2, "10.00"), (1, 2, "10.00")]
    assert {(r.line_seq, r["index"], str(r.signed_amount)) for r in tables["line_vat"].collect()} == {(0, 0, "-2.10"), (2, 0, "-2.10")}


def test_first_definitions_win(tables):
    assert {(r.id, r.description, r.file, r.rgs_code, r.rgs_source) for r in tables["accounts"].collect()} == {("1300", "Débiteuren", 0, "BVor", "RGScode"), ("8000", "Omzet", 0, None, None)}
    relation = tables["relations"].first()
    assert (relation.id, relation.relation_kind, str(relation.opening_balance)) == ("D1", "customer", "-100.00")
    assert {(r.owner_type, r.seq, r.kind, r.city) for r in tables["addresses"].collect()} == {("company", 0, "street", "Utrecht"), ("company", 1, "postal", "Delft"), ("relation", 0, "street", "Breda")}


def test_opening_balance_from_transactions(tables):
    rows = tables["opening_balance"].collect()
    assert {(r.source, r.account_id, r.transaction_seq) for r in rows} == {("transactions", "1300", 1), ("transactions", "8000", 1)}


def test_older_form_and_element_opening(spark, tmp_path):
    text = (
        "<auditfile><header><auditfileVersion>CLAIR2.00.00</auditfileVersion><companyName>C</companyName></header><generalLedger><ledgerAccount><accountID>1</accountID></ledgerAccount></generalLedger>"
        "<transactions><journal><journalID>M</journalID><type>Memo</type><transaction><transactionID>9</transactionID><period>1</period><transactionDate>2003-01-02</transactionDate>"
        "<line><recordID>1</recordID><accountID>1</accountID><debitAmount>5.00</debitAmount></line><line><recordID>2</recordID><accountID>2</accountID><debitAmount>x</debitAmount></line>"
        "<line><recordID>3</recordID><accountID>3</accountID><debitAmount>1.00</debitAmount><creditAmount>4.00</creditAmount></line></transaction></journal></transactions></auditfile>"
    )
    (tmp_path / "c.xml").write_text(text)
    files = open_files(spark, str(tmp_path / "c.xml"))
    made = FileTables(files)
    assert {(r.number, r.side, r.signed_amount and str(r.signed_amount)) for r in made.lines().collect()} == {("1", "D", "5.00"), ("2", None, None), ("3", "D", "-3.00")}
    assert made.header().first()["family"] == "CLAIR2" and made.company().first()["name"] == "C" and made.journals().first()["journal_kind"] == "memo"
    with pytest.raises(ValueError):
        FileTables(files, "guess")
