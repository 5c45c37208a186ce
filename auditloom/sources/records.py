"""Audit files as rows: Spark reads the bytes from any file system, tasks parse whole documents into records.

A record is an element with element children; its fields are the texts of its leaf children, the first of a name. Records keep
their place (ord), their parent's place (up), their path and line, so nothing needs numbering across rows afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.sources import content, formats
from auditloom.sources.content import Refused

SCHEMA = "file string, kind string, ord long, up long, path string, line int, fields map<string,string>"
#: kinds of rows that are no records: what was noted, and what the file is; with elements, every leaf as well
NOTE, FILE, LEAF = "#note", "#file", "#leaf"
#: a part of an element that several ranges share; its fields also hold its name, text, and whether it has children and ends here
PIECE, TAG, TEXT, COMPLEX, ENDED = "#piece", "\0name", "\0text", "\0complex", "\0ended"
ROWS = 5_000
# FIXED VALUES: bounds on hostile files
MAX_DEPTH, MAX_TEXT = 32, 10 << 20
#: Files of more bytes are parsed in ranges.
SPLIT = 32 << 20
# FIXED VALUES: the fixed-width layout, name and width in order
ADF_HEADER = "versie 12 boekhoudpakket 50 administratiecode 20 jaarPeriode 15 fiscaalnummer 15 naamOnderneming 50 adres 30 plaats 30 aantalMutaties 10 datumAanmaak 10 tellingDebet 16 tellingCredit 16"
ADF_LINE = (
    "dagboekcode 20 dagboekomschrijving 30 periode 5 volgnummer 10 regelnummer 5 identificatieJournaalpost 20 verwerkingsdatum 10 grootboekrekeningcode 15 soortGrootboekrekening 5 "
    "cluster 15 grootboekrekeningnaam 30 mutatiedatum 10 boekstuknummer 15 soortMutatie 5 relatieAndereAdministraties 15 kostenplaats 15 kostensoort 15 kostendrager 15 omschrijving 30 "
    "debet 16 credit 16 btwCode 5 valuta 10 koers 13 debCredNummer 15 debCredSoort 5 debCredFiscaalNummer 16 debCredNaam 30 debCredAdres 30 debCredPostcode 10 debCredPlaats 30 debCredLand 15"
)
Row = tuple[str, str, int, int | None, str | None, int | None, dict[str, str]]


def layout(text: str) -> list[tuple[str, int, int]]:
    out, at = [], 0
    words = text.split()
    for name, width in zip(words[::2], map(int, words[1::2]), strict=True):
        out.append((name, at, at + width))
        at += width
    return out


def parse_fixed(file: str, data: bytes, encoding: str) -> Iterator[Row]:
    """The header and the lines of a fixed-width file; a line of more than the layout and two characters is noted."""
    lines = re.split(r"\r\n|\n", data.decode(encoding, "replace").rstrip("\x1a"))
    for k, text in enumerate(x for x in lines if x.strip()):
        fields = layout(ADF_HEADER if k == 0 else ADF_LINE)
        if len(text) > fields[-1][2] + 2:
            yield file, NOTE, k, None, None, k + 1, {"code": "XAF3050", "message": "the line is longer than the layout"}
        yield file, "adfHeader" if k == 0 else "adfLine", k, None, None, k + 1, {n: v for n, a, b in fields if (v := text[a:b].strip())}


@dataclass
class Place:
    """Where in a document a range of it begins, and whether its end is the document's."""

    #: open elements: (name with prefix, ord, line, whether a child of it is known)
    stack: list[tuple[str, int, int, bool]] = field(default_factory=list)
    ord: int = 0
    line: int = 0
    #: characters since the last start tag
    text: int = 0
    closed: bool = False
    last: bool = True


def parse_xml(file: str, data: bytes, leaves: bool, place: Place | None = None, kinds: frozenset[str] | None = None) -> Iterator[Row]:
    """The records of a document, or of a range of one, in the order of their ends; what stands before an error is delivered, then
    the error is raised.

    An element that the range doesn't hold whole gives pieces (PIECE): the fields, and the text of what may be a leaf, that lie here.
    With kinds, only records of these kinds are made, and only their texts are collected (and bounded).
    """
    place = place or Place()
    out: list[Row] = []
    stack: list[list] = []  # name, ord, line, fields, texts, whether it has element children, whether it began in this range
    count, size = place.ord, place.text
    closed = place.closed
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.SetReparseDeferralEnabled(False)
    for name, ord_, line, inner in place.stack:
        try:
            parser.Parse(f"<{name}>".encode(), False)
        except expat.ExpatError:  # no name: the range that opened it ends in an error
            return
        stack.append([name.rpartition(":")[2], ord_, line, {}, [], inner, False])
    if closed:
        parser.Parse(b"<a></a>", False)

    def at() -> int:
        return parser.CurrentLineNumber + place.line

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal count, size
        if len(stack) >= MAX_DEPTH:
            raise Refused("XAF2003", f"more than {MAX_DEPTH} levels", at())
        if stack:
            stack[-1][5] = True
            stack[-1][4].clear()
        stack.append([name.rpartition(":")[2], count, at(), {}, [], False, True])
        count += 1
        size = 0
        if kinds is not None and not leaves:  # only leaves of wanted records need their text
            parser.CharacterDataHandler = data_ if len(stack) > 1 and stack[-2][0] in kinds else None

    def data_(text: str) -> None:
        nonlocal size
        size += len(text)
        if size > MAX_TEXT:
            raise Refused("XAF2003", f"a text of more than {MAX_TEXT} characters", at())
        if stack and not stack[-1][5]:
            stack[-1][4].append(text)

    def piece(depth: int, ended: bool) -> Row:
        tag, ord_, line, fields, texts, complex_, _ = stack[depth]
        path = "/" + "/".join(x[0] for x in stack[: depth + 1])
        told = {TAG: tag, TEXT: "" if complex_ else "".join(texts)} | ({COMPLEX: "1"} if complex_ else {}) | ({ENDED: "1"} if ended else {})
        return file, PIECE, ord_, stack[depth - 1][1] if depth else None, path, line, told | fields

    def end(name: str) -> None:
        nonlocal closed
        if not stack[-1][6]:
            out.append(piece(len(stack) - 1, True))
            stack.pop()
            closed = not stack
            return
        tag, ord_, line, fields, texts, complex_, _ = stack[-1]
        wanted = complex_ and (kinds is None or tag in kinds)
        path = "/" + "/".join(x[0] for x in stack) if wanted or leaves else ""
        stack.pop()
        closed = not stack
        up = stack[-1][1] if stack else None
        if complex_:
            if wanted:
                out.append((file, tag, ord_, up, path, line, fields))
            return
        text = "".join(texts)
        if stack and (kinds is None or stack[-1][0] in kinds):
            stack[-1][3].setdefault(tag, text)
        if leaves:
            out.append((file, LEAF, ord_, up, path, line, {"name": tag, "text": text}))

    def refuse(*_: object) -> None:
        raise Refused("XAF2002", "DOCTYPE and ENTITY declarations are refused", at())

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data_
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    try:
        for first in range(0, len(data), 1 << 16):
            parser.Parse(data[first : first + (1 << 16)], False)
            yield from out
            out.clear()
        if place.last:
            parser.Parse(b"", True)
    except expat.ExpatError as e:
        yield from out
        if closed:  # the document is whole, what follows is left out
            yield file, NOTE, 2**62, None, None, e.lineno + place.line, {"code": "XAF1013", "message": f"ignored data after the end of the document ({expat.ErrorString(e.code)})"}
            return
        raise Refused("XAF2001", f"not well-formed: {expat.ErrorString(e.code)}", e.lineno + place.line) from e
    except Refused:
        yield from out
        raise
    parser.buffer_text = False  # hands over what it holds
    yield from out
    if not place.last:
        made = (piece(k, False) for k in range(len(stack)))
        yield from (p for p, x in zip(made, stack, strict=True) if x[6] or x[3] or p[6][TEXT])


def parse_file(file: str, data: bytes, encoding: str | None, repair: frozenset[str], most: int | None, leaves: bool, vocabularies: dict[str, frozenset[str]] | None = None, kinds: frozenset[str] | None = None) -> Iterator[Row]:
    """All rows of a document: what it is, what was noted, its records, and why it ended early if it did."""
    try:
        data, packed = content.decompressed(data, file, most)
        adf = formats.ADF_MARK in data[:64]
        text, used, notes = (data, encoding or "cp1252", []) if adf else content.utf8(data, encoding, repair)
        kind = formats.detect(text[: 1 << 16], "cp1252" if adf else "utf-8", vocabularies) | {"encoding": used, "compression": packed}
        said = used if adf else content.settled(data, encoding)[0]  # a repair doesn't change what the file says
        if not encoding and formats.forbidden(kind["version"], said):
            notes.append(("XAF1003", f"the version doesn't allow the encoding {said}"))
        if not adf and not kind["continuation"] and not text[:1024].lstrip().startswith(b"<?xml"):
            notes.append(("XAF1002", "no XML declaration"))
        if packed:
            notes.append(("XAF1020", f"the file is compressed ({packed})"))
        yield file, FILE, -1, None, None, None, {k: v for k, v in kind.items() if v is not None}
        for k, (code, message) in enumerate(notes):
            yield file, NOTE, -2 - k, None, None, None, {"code": code, "message": message}
        made = parse_fixed(file, data, used) if adf else parse_xml(file, text, leaves, None, kinds)
        yield from (r for r in made if not adf or kinds is None or r[1] in kinds or r[1] == NOTE)
    except Refused as e:
        yield file, NOTE, 2**62, None, None, e.line, {"code": e.code, "message": str(e)}


def as_batch(rows: list[Row]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
    columns = [pa.array(x, t) for x, t in zip(c[:6], kinds, strict=True)] + [pa.array([list(f.items()) for f in c[6]], pa.map_(pa.string(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def batches_of(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield as_batch(held)
            held = []
    if held:
        yield as_batch(held)


def read(
    spark: SparkSession, paths: str | list[str], *, encoding: str | None = None, repair: frozenset[str] = frozenset(), max_decompressed_size: int | None = None, elements: bool = False, documents: dict[str, str] | None = None,
    vocabularies: dict[str, Iterable[str]] | None = None, split: int = SPLIT, kinds: Iterable[str] | None = None,
) -> DataFrame:
    """The rows (see SCHEMA) of audit files on any file system that Spark reads.

    Files of up to split bytes, and packed or fixed-width ones, are parsed one a task; larger ones, and all parts of the documents below,
    by as many tasks as Spark's reader makes of their bytes, with the same rows. documents maps the names of continuation files to the
    document they are parts of, in the order of their names; no part may end within the end mark of a comment or CDATA section.
    A file that can't be read further ends in a note and never fails the job. vocabularies (element names by version) tell
    the version of files whose namespace doesn't. With kinds, only records of these kinds are made, beside notes and what files are.
    """
    from auditloom.sources.ranges import PACKED, read_ranges

    known_names = {v: frozenset(names) for v, names in (vocabularies or {}).items()}
    wanted_kinds = None if kinds is None else frozenset(kinds)
    if unknown := set(repair) - content.REPAIRS:
        raise ValueError(f"unknown repairs: {sorted(unknown)}")
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    document = path
    apart = (F.col("_metadata.file_size") > split) & ~name.rlike(PACKED)
    if max_decompressed_size:
        apart = apart & (F.col("_metadata.file_size") <= max_decompressed_size)
    if documents:
        known = F.try_element_at(F.create_map(*[F.lit(x) for kv in documents.items() for x in kv]), name)
        document, apart = F.coalesce(known, path), apart | known.isNotNull()
    files = spark.read.format("binaryFile").load(paths)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from batches_of(parse_file(path_, data.as_py(), encoding, frozenset(repair), max_decompressed_size, elements, known_names, wanted_kinds))

    alone = files.filter(~apart).select("path", "content").mapInArrow(parsed, SCHEMA)
    if not documents and files.filter(apart).select("length").isEmpty():
        return alone

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("name").to_pylist(), table.column("content").to_pylist(), strict=True))
        data = b"".join(re.sub(rb"^(\xef\xbb\xbf)?(\s*<\?xml.*?\?>)?(\s*<!--.*?-->)*", b"", d, flags=re.S) if k else d for k, (_, d) in enumerate(rows))
        document_ = table.column("document")[0].as_py()
        made = list(batches_of(parse_file(document_, data, encoding, frozenset(repair), max_decompressed_size, elements, known_names, wanted_kinds)))
        if wrong := formats.misnumbered([d for _, d in rows]):
            made.append(as_batch([(document_, NOTE, 2**61, None, None, None, {"code": "XAF3009", "message": f"continuation files are numbered inconsistently: {wrong}"})]))
        return pa.Table.from_batches(made)

    found, whole = read_ranges(spark, paths, apart, document, encoding=encoding, repair=frozenset(repair), elements=elements, vocabularies=known_names, kinds=wanted_kinds)
    rows = alone.unionByName(found)
    if whole.isEmpty():
        return rows
    undivided = files.filter(apart).select(document.alias("document"), name.alias("name"), "content").join(whole, "document", "left_semi")
    return rows.unionByName(undivided.groupBy("document").applyInArrow(joined, SCHEMA))
