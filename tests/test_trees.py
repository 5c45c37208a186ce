from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from auditloom.plans.validate import validate
from auditloom.sources import trees
from auditloom.sources.ledger import open_files

from .test_set_rules import CLEAN, codes
from .test_sources import audit_file

LINE = "<trLine><nr>1</nr><accID>1300</accID><desc>btw \"a\" \\ é</desc><desc>dup</desc><vat><vatID>H</vatID><vatAmnt>2.10</vatAmnt></vat><vat><vatID>L</vatID></vat><currency><curCode>USD</curCode></currency><amnt>1.00</amnt><amntTp>D</amntTp></trLine>"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    text = audit_file([("8000", "10.00", "C")])
    text = text.replace("<trLine>", LINE + "<trLine>", 1).replace("<accDesc>Omzet</accDesc>", "<accDesc>Omzet</accDesc><taxonomies><taxonomy><taxoRef>x</taxoRef><entryPoint><entryPointRef>y</entryPointRef><conceptRef>z</conceptRef></entryPoint></taxonomy></taxonomies>")
    folder = tmp_path_factory.mktemp("trees")
    (folder / "a.xaf").write_text(text, encoding="utf-8")
    (folder / "b.xaf").write_text(text.replace("<company>", "\n\n<company>").replace("<vatID>L</vatID>", "<vatID>N</vatID>"), encoding="utf-8")
    return open_files(spark, str(folder), elements=True)


def test_records_keep_all_that_lies_below(files):
    lines = trees.nested(files, "trLine").filter("file like '%a.xaf'").orderBy("ord")
    record = F.col("record")
    row = lines.select(
        trees.text(record, "accID").alias("account"), trees.text(record, "nothing").alias("none"), trees.texts(record, "desc").alias("both"), trees.texts(record, "amnt").alias("one"), trees.texts(record, "x").alias("no"),
        F.transform(trees.children(record, "vat"), lambda v: trees.text(v, "vatID")).alias("vat"), trees.text(trees.child(record, "currency"), "curCode").alias("currency"), F.size(trees.children(record, "x")).alias("size"),
    ).first()
    assert (row.account, row.none, row.both, row.one, row.no) == ("1300", None, ['btw "a" \\ é', "dup"], ["1.00"], [])
    assert (row.vat, row.currency, row.size) == (["H", "L"], "USD", 0)
    plain = trees.to_dict(lines.first().plain)
    assert plain == {"nr": "1", "accID": "1300", "desc": ['btw "a" \\ é', "dup"], "vat": [{"vatID": "H", "vatAmnt": "2.10"}, {"vatID": "L"}], "currency": [{"curCode": "USD"}], "amnt": "1.00", "amntTp": "D"}
    assert json.loads(json.dumps(plain)) == plain
    assert trees.to_dict(lines.collect()[1].plain) == {"nr": "1", "accID": "8000", "effDate": "2024-03-01", "amnt": "10.00", "amntTp": "C"}


def test_records_of_many_levels(files):
    made = {r.tag: trees.to_dict(r.plain) for r in trees.nested(files, "transaction", "ledgerAccount", "company").filter("file like '%a.xaf'").collect()}
    assert set(made) == {"transaction", "ledgerAccount", "company"}
    assert [x["amnt"] for x in made["transaction"]["trLine"]] == ["1.00", "10.00"]
    accounts = made["company"]["generalLedger"][0]["ledgerAccount"]
    assert [x["accID"] for x in accounts] == ["1300", "8000"] and accounts[1]["taxonomies"][0]["taxonomy"][0]["entryPoint"] == [{"entryPointRef": "y", "conceptRef": "z"}]
    record = {r.tag: r.record.toPython() for r in trees.nested(files, "header").collect()}["header"]
    assert record["tag"] == "header" and record["line"] == 2 and record["children"] == {} and record["fields"]["fiscalYear"] == "2024"
    assert trees.nested(files, "nothing").count() == 0


def test_digests_are_those_of_trees(files):
    rows = trees.grown(files, "trLine", "ledgerAccount").collect()
    of = lambda tag: {f: [r.digest for r in sorted(rows, key=lambda r: r.ord) if r.tag == tag and r.file.endswith(f)] for f in ("a.xaf", "b.xaf")}
    lines, accounts = of("trLine"), of("ledgerAccount")
    # other lines of the file, another nested VAT code
    assert accounts["a.xaf"] == accounts["b.xaf"] and len(set(accounts["a.xaf"])) == 2
    assert lines["a.xaf"][0] != lines["b.xaf"][0] and lines["a.xaf"][1] == lines["b.xaf"][1]


@pytest.mark.parametrize(("old", "new", "differs"), [("<streetname>Kade", "<streetname>Laan", True), ("<streetname>Kade", "<!-- moved -->\n<streetname>Kade", False)])
def test_a_nested_address_that_differs_is_a_conflict(spark, tmp_path, old, new, differs):
    text = CLEAN.replace("<generalLedger>", "<customersSuppliers><customerSupplier><custSupID>7</custSupID><streetAddress><streetname>Kade</streetname><city>A</city></streetAddress></customerSupplier></customersSuppliers><generalLedger>", 1)
    assert text != CLEAN
    (tmp_path / "a.xaf").write_text(text)
    (tmp_path / "b.xaf").write_text(text.replace(old, new))
    found = validate(open_files(spark, str(tmp_path))).findings
    assert [(f["code"], f["severity"]) for f in found if f["code"] == "XAF6010"] == [("XAF6010", 20)] * differs


def test_company_names_fold_alike(spark, tmp_path):
    name = CLEAN.partition("<companyName>")[2].partition("<")[0]
    (tmp_path / "a.xaf").write_text(CLEAN.replace(f"<companyName>{name}", "<companyName>Groß  BV"), encoding="utf-8")
    (tmp_path / "b.xaf").write_text(CLEAN.replace(f"<companyName>{name}", "<companyName>GROSS BV"))
    assert name and "XAF6011" not in codes(open_files(spark, str(tmp_path)))
