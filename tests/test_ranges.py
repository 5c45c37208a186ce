"""Documents parsed in ranges give the rows of documents parsed whole."""

from __future__ import annotations

import random

import pytest

from auditloom.sources import ranges, records

from .test_sources import audit_file

WORDS = ["Omzet", "Débiteuren", "R&amp;D", "a&lt;b", "x>y", "<![CDATA[<not> a]] tag]]>", "☃🙂", "<!--<b>-->", "<?pi <c> d?>"]


def generated(seed: int, n: int) -> str:
    """A document with comments, CDATA sections, instructions, attributes that hold '>', prefixes, repeated names and mixed content."""
    r = random.Random(seed)
    lines = [(str(r.randrange(1000)), f"{r.random() * 100:.2f}", r.choice("DC")) for _ in range(n)]
    out = audit_file(lines).replace("</trLine>", "</trLine>\n")
    parts = out.split("</trLine>")
    for k in range(len(parts) - 1):
        extra = f"<desc a='x>{k}'>{' '.join(r.choice(WORDS) for _ in range(r.randrange(6)))}</desc>"
        if r.random() < 0.2:
            extra += '<desc>again</desc><empty/><vat><vatID b="/>">x</vatID></vat>'
        if r.random() < 0.05:
            extra += "<!-- " + "<trLine><nr>9</nr>\n" * r.randrange(60) + " -->"
        if r.random() < 0.05:
            extra += "<long><![CDATA[" + "<x>y</x>\r\n" * r.randrange(60) + "]]></long>"
        if r.random() < 0.05:
            extra += f"<x:sub xmlns:x='u'>mixed <x:leaf>{'z' * r.randrange(300)}</x:leaf> tail</x:sub>"
        parts[k] += extra
    return "</trLine>".join(parts)


def rows_of(df) -> list[str]:
    return sorted(repr((r.file.rpartition("/")[2], r.kind, r.ord if r.kind != records.NOTE else 0, r.up, r.path, r.line, sorted(r.fields.items()))) for r in df.collect())


def alike(spark, path: str, monkeypatch, sizes: tuple = ((300, "9000"),), **options) -> list[str]:
    """Rows of both ways, with chunks far smaller than comments and texts."""
    whole = rows_of(records.read(spark, path, **options))
    for chunk, block in sizes:
        monkeypatch.setattr(ranges, "CHUNK", chunk)
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        try:
            assert rows_of(records.read(spark, path, split=0, **options)) == whole
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return whole


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_give_the_rows_of_the_whole(spark, tmp_path, monkeypatch, seed):
    (tmp_path / "a.xaf").write_text(generated(seed, 150), encoding="utf-8")
    (tmp_path / "b.xaf").write_text(generated(seed + 10, 60), encoding="utf-8")
    whole = alike(spark, str(tmp_path), monkeypatch, ((300, "9000"), (20_000, "128m")), elements=True)
    assert len(whole) > 1000
    only = rows_of(records.read(spark, str(tmp_path), split=0, kinds=["header", "journal"]))
    assert [x for x in whole if "'header'" in x.split(", ")[1] or "'journal'" in x.split(", ")[1] or x.split(", ")[1] in ("'#file'", "'#note'")] == only


def test_encodings_marks_and_repairs_in_ranges(spark, tmp_path, monkeypatch):
    text = generated(3, 80).replace("☃🙂", "é")
    (tmp_path / "l.xaf").write_bytes(text.replace("UTF-8", "ISO-8859-1").encode("latin-1").replace(b"Omzet", b"Om\x93zet"))
    (tmp_path / "m.xaf").write_bytes(b"\xef\xbb\xbf" + text.encode())
    (tmp_path / "r.xaf").write_bytes(text.replace("&amp;", "&").replace("again", "ag\x01ain").encode())
    (tmp_path / "n.xaf").write_bytes(text.partition("?>")[2].encode() + b"\n\n")
    (tmp_path / "u.xaf").write_bytes(text.replace("UTF-8", "UTF-16").encode("utf-16"))
    whole = alike(spark, str(tmp_path), monkeypatch, repair=frozenset({"bare-ampersand", "control-chars", "latin1-as-cp1252"}))
    assert {c for c in ("XAF1001", "XAF1002", "XAF1010", "XAF1011", "XAF1012") if any(c in x for x in whole)} == {"XAF1001", "XAF1002", "XAF1010", "XAF1011", "XAF1012"}
    alike(spark, str(tmp_path / "l.xaf"), monkeypatch)


@pytest.mark.parametrize("how", ["cut", "junk", "wrong", "deep", "doctype", "lesser"])
def test_errors_in_ranges(spark, tmp_path, monkeypatch, how):
    text = generated(4, 60)
    at = text.index("</trLine>", len(text) // 2)  # no comment holds it
    text = {
        "cut": text[: at + 5],
        "junk": text + "\n<!-- fine -->\n<again>1</again>" + "<more/>\n" * 200,
        "wrong": text[:at] + "</nothing>" + text[at:],
        "deep": text[:at] + "<d>" * 60 + text[at:],
        "doctype": text.replace("<auditfile", "<!DOCTYPE a [<!ENTITY x 'y'>]>\n<auditfile", 1),
        "lesser": text[:at] + "<a b='<'/>" + text[at:],
    }[how]
    (tmp_path / "a.xaf").write_text(text, encoding="utf-8")
    whole = alike(spark, str(tmp_path / "a.xaf"), monkeypatch)
    assert any("'#note'" in x for x in whole)


def test_sets_in_ranges(spark, tmp_path):
    text = generated(5, 120)
    cuts = [0, *sorted(random.Random(5).sample([k for k in range(200, len(text)) if text.startswith("<trLine>", k) and "<trLine><nr>9<" not in text[k : k + 15]], 7)), len(text)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / f"p{k}.xaf").write_text(("" if k == 0 else f'<?xml version="1.0"?>\n<!-- Vervolgbestand {k + 1} van {len(cuts) - 1} -->') + text[a:b], encoding="utf-8")
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "set").write_text(text, encoding="utf-8")
    (tmp_path / "own.xaf").write_text(generated(6, 5), encoding="utf-8")
    mark = lambda df: sorted((r.kind, r.ord, r.up, r.path, sorted(r.fields.items())) for r in df.filter("file like '%set' and kind not like '#%'").collect())
    got = records.read(spark, str(tmp_path / "*.xaf"), documents={f"p{k}.xaf": "set" for k in range(len(cuts) - 1)})
    assert mark(got) == mark(records.read(spark, str(tmp_path / "whole"))) and got.filter("kind = '#note'").count() == 0
    assert got.filter("file like '%own.xaf'").count() > 10


def test_a_comment_longer_than_many_chunks(spark, tmp_path, monkeypatch):
    text = audit_file([("1", "1.00", "D")]).replace("<company>", "<company><!--" + "<a>'\n" * 3000 + "-->", 1)
    (tmp_path / "a.xaf").write_text(text, encoding="utf-8")
    alike(spark, str(tmp_path / "a.xaf"), monkeypatch)
