from __future__ import annotations

from auditloom.plans.structure_rules import structure
from auditloom.sources.catalogue import catalogue
from auditloom.sources.ledger import open_files

SCHEMA = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:s="urn:s" targetNamespace="urn:s">
<xs:element name="auditfile"><xs:complexType><xs:sequence>
 <xs:element name="header" type="s:Head"/>
 <xs:element name="line" minOccurs="1" maxOccurs="2"><xs:complexType><xs:sequence>
   <xs:element name="nr" type="s:Short"/>
   <xs:choice><xs:element name="debit" type="s:Money"/><xs:element name="credit" type="s:Money"/></xs:choice>
   <xs:element name="side" minOccurs="0"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="D"/><xs:enumeration value="C"/></xs:restriction></xs:simpleType></xs:element>
 </xs:sequence></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element>
<xs:complexType name="Head"><xs:sequence><xs:element name="year" type="s:Year"/><xs:element name="made" type="xs:date"/><xs:element name="note" type="xs:string" fixed="x" minOccurs="0"/></xs:sequence></xs:complexType>
<xs:simpleType name="Short"><xs:restriction base="xs:string"><xs:maxLength value="3"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Year"><xs:restriction base="xs:string"><xs:pattern value="\\d{4}"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Money"><xs:restriction base="xs:decimal"><xs:totalDigits value="5"/><xs:fractionDigits value="2"/><xs:minInclusive value="0"/></xs:restriction></xs:simpleType>
</xs:schema>"""
GOOD = "<auditfile><header><year>2024</year><made>2024-01-01</made></header><line><nr>1</nr><debit>10.50</debit><side>D</side></line></auditfile>"
DEFECTS = [
    ("<side>D", "<side>E", {"XAF3015"}),
    ("2024</year>", "24</year>", {"XAF3016"}),
    ("<made>2024-01-01", "<made>2024-13-01", {"XAF3017"}),
    ("<nr>1", "<nr>1234", {"XAF3014"}),
    ("10.50", "ten", {"XAF3018"}),
    ("10.50", "1234.56", {"XAF3018"}),
    ("10.50", "-1.00", {"XAF3021"}),
    ("<nr>1</nr>", "", {"XAF3010"}),
    ("<debit>10.50</debit>", "", {"XAF3010"}),
    ("</debit>", "</debit><credit>1</credit>", {"XAF3012"}),
    ("<nr>1</nr><debit>10.50</debit>", "<debit>10.50</debit><nr>1</nr>", {"XAF3013"}),
    ("<nr>1</nr>", "<nr>1</nr><odd>1</odd>", {"XAF3011"}),
    ("</made>", "</made><note>y</note>", {"XAF3020"}),
    ("</line>", "</line><line><nr>2</nr><credit>1</credit></line><line><nr>3</nr><credit>1</credit></line>", {"XAF3012"}),
]


def test_structure_rules(spark, tmp_path):
    (tmp_path / "s.xsd").write_text(SCHEMA)
    folder = tmp_path / "files"
    folder.mkdir()
    for k, (old, new, _) in enumerate([("", "", set()), *DEFECTS]):
        text = GOOD.replace(old, new, 1) if old else GOOD
        assert not old or text != GOOD
        (folder / f"{k:02}.xml").write_text(text)
    spec = catalogue(spark, str(tmp_path / "s.xsd"))
    files = open_files(spark, str(folder), elements=True)
    got: dict[str, set] = {}
    for r in structure(files, spec).collect():
        got.setdefault(r.file[-6:-4], set()).add(r.code)
    assert got == {f"{k:02}": codes for k, (_, _, codes) in enumerate(DEFECTS, 1)}

