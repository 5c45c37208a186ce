"""The element catalogue of a version, from its schema file: a specification table, not a validator.

A schema is a few hundred elements; it is read on the driver, and its size doesn't depend on the data.
"""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "parent string, name string, path string, position int, least int, most int, kind string, choice string, min_length int, max_length int, "
    "allowed array<string>, patterns array<string>, total_digits int, fraction_digits int, min_inclusive string, max_inclusive string, fixed string"
)
XS = "{http://www.w3.org/2001/XMLSchema}"
# FIXED VALUES: the schema language's types by the kind of their values
KINDS = {"date": "date", "dateTime": "datetime", "time": "time", "decimal": "decimal", "double": "double", "integer": "integer", "nonNegativeInteger": "integer", "positiveInteger": "integer", "int": "integer", "boolean": "boolean"}


def read_schema(path: str) -> list[tuple]:
    """One row for each element that the schema allows, in document order; recursion and wildcards aren't followed."""
    root = ElementTree.parse(path).getroot()
    named = {(e.tag, e.get("name")): e for e in root if e.get("name")}
    rows: list[tuple] = []

    def local(name: str | None) -> str:
        return (name or "").rpartition(":")[2]

    def facets(simple: ElementTree.Element | None, type_: str) -> dict:
        """Kind and facets of a simple type: its own, and those of the types it restricts."""
        base = local(type_)
        known = named.get((f"{XS}simpleType", base))
        found: dict = {}
        if simple is None and known is not None:
            simple = known
        if simple is None:
            return {"kind": KINDS.get(base, "string")}
        limit = simple.find(f"{XS}restriction")
        if limit is None:
            return {"kind": "string"}
        found = facets(limit.find(f"{XS}simpleType"), limit.get("base", ""))
        values = lambda n: [f.get("value", "") for f in limit.findall(XS + n)]
        for n, key in (("minLength", "min_length"), ("maxLength", "max_length"), ("totalDigits", "total_digits"), ("fractionDigits", "fraction_digits")):
            if values(n):
                found[key] = int(values(n)[0])
        if values("length"):
            found |= {"min_length": int(values("length")[0]), "max_length": int(values("length")[0])}
        for n, key in (("minInclusive", "min_inclusive"), ("maxInclusive", "max_inclusive")):
            if values(n):
                found[key] = values(n)[0]
        for n, key in (("enumeration", "allowed"), ("pattern", "patterns")):
            if values(n):
                found[key] = values(n)
        return found

    def children(model: ElementTree.Element, path: str, above: tuple[str, ...], choice: str | None) -> None:
        for k, part in enumerate(model):
            tag = part.tag.removeprefix(XS)
            if tag in ("sequence", "all"):
                children(part, path, above, choice)
            elif tag == "choice":
                for branch, one in enumerate(part):
                    holder = ElementTree.Element("x")
                    holder.append(one)
                    children(holder, path, above, f"{path}#{k}.{branch}")
            elif tag == "element":
                add(named.get((f"{XS}element", local(part.get("ref"))), part) if part.get("ref") else part, part, path, above, choice)

    def add(element: ElementTree.Element, use: ElementTree.Element, parent: str, above: tuple[str, ...], choice: str | None) -> None:
        name = element.get("name", "")
        path = f"{parent}/{name}"
        type_ = element.get("type", "")
        complex_ = element.find(f"{XS}complexType")
        if complex_ is None and local(type_) not in above:
            complex_ = named.get((f"{XS}complexType", local(type_)))
        most = use.get("maxOccurs", "1")
        f = {"kind": "complex"} if complex_ is not None else facets(element.find(f"{XS}simpleType"), type_)
        position = sum(r[0] == parent for r in rows)
        rows.append(
            (parent, name, path, position, int(use.get("minOccurs", "1")), None if most == "unbounded" else int(most), f["kind"], choice, f.get("min_length"), f.get("max_length"),
             f.get("allowed"), f.get("patterns"), f.get("total_digits"), f.get("fraction_digits"), f.get("min_inclusive"), f.get("max_inclusive"), element.get("fixed"))
        )
        if complex_ is not None:
            children(complex_, path, (*above, local(type_)), None)

    top = root.find(f"{XS}element")
    if top is not None:
        add(top, top, "", (), None)
    return rows


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(read_schema(path), SCHEMA)


def vocabulary(path: str) -> frozenset[str]:
    """The element names of a schema file, to tell versions by."""
    return frozenset(row[1] for row in read_schema(path))
