from __future__ import annotations

import gzip

import pytest

from auditloom.sources import content, records
from auditloom.sources.datasource import AuditReader, register

from .test_ranges import generated
from .test_sources import audit_file

COLUMNS = ["file", "kind", "ord", "up", "path", "line"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    register(spark)
    top = tmp_path_factory.mktemp("source")
    (top / "a.xaf").write_text(generated(1, 40), encoding="utf-8")
    (top / "b.xaf").write_text(audit_file([("1", "2.00", "D")]), encoding="utf-8")
    (top / "c.xaf").write_bytes(gzip.compress((top / "a.xaf").read_bytes()))
    (top / "bad.xaf").write_text(audit_file([("1", "2.00", "D")], tail="</wrong>"), encoding="utf-8")
    (top / "_left").write_text("no audit file")
    return top


def rows(df) -> list[str]:
    return sorted(repr((*[r[c] for c in COLUMNS], sorted(r.fields.items()))) for r in df.collect())


def test_the_source_gives_the_rows_of_read(spark, folder):
    got = spark.read.format("auditfile").load(str(folder))
    assert got.schema == records.read(spark, str(folder)).schema
    assert rows(got) == rows(records.read(spark, str(folder)))
    assert rows(spark.read.format("auditfile").load(f"file://{folder}/?.xaf")) == rows(records.read(spark, f"{folder}/?.xaf"))


@pytest.mark.parametrize("where", ["kind = 'header'", "kind in ('journal', 'transaction')", "kind = 'vat' and line > 20", "kind = 'trLine' and fields['nr'] = '3'", "kind = '#file'", "kind = '#note'", "kind = 'a' and kind = 'b'", "kind is null", "path like '%period'"])
def test_filters_are_pushed_and_exact(spark, folder, where):
    got = spark.read.format("auditfile").load(str(folder)).filter(where)
    assert rows(got) == rows(records.read(spark, str(folder)).filter(where))


def test_the_plan_shows_what_is_pushed(spark, folder, capsys):
    file = f"file:{folder}/a.xaf"
    df = spark.read.format("auditfile").load(str(folder)).filter(f"kind in ('header', 'journal') and file = '{file}' and line > 0")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert f"PushedFilters: [In(kind, [header,journal]), EqualTo(file,{file})]" in plan and "kind" not in plan.partition("Condition :")[2].partition("\n")[0]
    assert {(r.file, r.kind) for r in df.collect()} == {(file, "header"), (file, "journal")}


def test_a_header_read_makes_no_lines(folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = AuditReader({"path": str(folder)})
    rest = list(reader.pushFilters([EqualTo(("kind",), "header"), EqualTo(("file",), f"file:{folder}/a.xaf"), GreaterThan(("line",), 0)]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan"]
    files = reader.partitions()
    assert [f.name for f in files] == [f"file:{folder}/a.xaf"]
    made: list = []
    true = records.parse_xml
    monkeypatch.setattr(records, "parse_xml", lambda *a: (made.append(r) or r for r in true(*a)))
    batches = list(reader.read(files[0]))
    assert {r[1] for r in made} == {"header"} and sum(map(len, batches)) == len(made) == 1
    heads = AuditReader({"path": str(folder)})
    list(heads.pushFilters([EqualTo(("kind",), "#file")]))
    made.clear()
    assert len([b for f in heads.partitions() for b in heads.read(f)]) == 4 and {r[0][-5:] for r in made} <= {"c.xaf"}


def test_wrong_options(folder):
    with pytest.raises(ValueError, match="path"):
        AuditReader({})
    with pytest.raises(ValueError, match="repairs"):
        AuditReader({"path": str(folder), "repair": "magic"})
    with pytest.raises(FileNotFoundError):
        AuditReader({"path": f"{folder}/nothing"}).partitions()
    assert AuditReader({"path": str(folder), "repair": ", ".join(content.REPAIRS)}).repair == content.REPAIRS
