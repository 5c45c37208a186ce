"""One XML document parsed by many tasks.

Spark's line reader cuts a file of any size at '<', so a chunk of it begins at a '<' wherever the file's blocks lie. Each chunk is first
summarised alone: how many elements it closes that others opened, which ones it leaves open, how many start tags and line breaks it has,
and whether its end lies within a comment or the like. A scan over the summaries of a document, a few numbers for each chunk, tells where
every chunk begins: the open elements with their places, and the numbers of elements and lines before it. Then each chunk
is parsed as if all before it had been. Only elements that several chunks share are put together afterwards.

A chunk is summarised as if it began outside comments, CDATA sections and the like. Where the scan finds that it doesn't, it is summarised
again with what it really begins in, until all agree: as a rule that takes no more than one round.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.sources import content, formats, records
from auditloom.sources.content import Refused
from auditloom.sources.records import NOTE, PIECE
from auditloom.sources.shared import written

#: bytes of a chunk, about; what is told of a document from its first bytes; open elements that are told
CHUNK, HEAD, DEEP = 4 << 20, 1 << 16, records.MAX_DEPTH + 8
#: Files with these names are packed or sealed: they can't be cut.
PACKED = r"(?i)\.(gz|zip|bz2|zst|xz|xac|xsc|xfc|adc)$"
TOKEN = re.compile(rb"""(?s)<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<(/?)([^\s/>"'<]*+)((?:[^>"'<]++|"[^"<]*+(?:"|\Z)|'[^'<]*+(?:'|\Z))*+)(>|\Z|(?=<))""")
#: what a chunk may end within: its mark, how it ends, what the next chunk is to begin with
OPEN = ((b"<!--", b"-->", b"<!--"), (b"<![CDATA[", b"]]>", b"<![CDATA["), (b"<?", b"?>", b"<?x "))
LEADING = re.compile(rb"^(\xef\xbb\xbf)?(\s*<\?xml.*?\?>)?(\s*<!--.*?-->)*", re.S)
#: A chunk is known by its file's number, the block that it lies in and its place there.
KEY = ("id", "block", "seq")
CUT = "id long, block long, seq int, bytes long, data binary"
SUMMARY = (
    "id long, block long, seq int, bytes long, carried binary, carries binary, closer binary, aside int, starts long, lines long, led long, text long, closes long, ends int, "
    "opens array<struct<name: binary, ord: long, line: long, inner: boolean>>, head binary, follows string"
)
START = (
    "id long, block long, seq int, document string, later boolean, at int, stale boolean, whole boolean, carried binary, closer binary, aside int, "
    "stack array<struct<name: string, ord: long, line: long, inner: boolean>>, ord long, line long, text long, closed boolean, last boolean, encoding string, wrong string, parts int"
)
PLACED = f"{records.SCHEMA}, at int"
COUNT = "#count"


def numbered(name: Column) -> Column:
    """A file's number: one for each path."""
    return F.xxhash64(name).alias("id")


def pieces_of(spark: SparkSession, paths: str | list[str], wanted: Column) -> DataFrame:
    """The wanted files as written chunks (CUT)."""
    lines = spark.read.option("lineSep", "<").text(paths).filter(wanted)
    lines = lines.select(F.concat(F.lit("<"), "value").cast("binary").alias("data"), numbered(F.col("_metadata.file_path")), F.col("_metadata.file_block_start").alias("block"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, seq = None, [], 0, 0

        def made() -> pa.RecordBatch:
            data = b"".join(held)
            if key[1] == 0 and seq == 0:
                data = data[1:]  # the file doesn't begin with the '<' that stands before each piece
            return pa.RecordBatch.from_pylist([{"id": key[0], "block": key[1], "seq": seq, "bytes": len(data), "data": data}], schema)

        for batch in batches:
            ids, blocks = (batch.column(k).to_numpy() for k in (1, 2))
            ends = np.frombuffer(batch.column(0).buffers()[1], np.int32, len(batch) + 1, batch.column(0).offset * 4)
            bytes_ = batch.column(0).buffers()[2]
            turns = np.flatnonzero((ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for first, last in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)], strict=True):
                now = int(ids[first]), int(blocks[first])
                if now != key:
                    if held:
                        yield made()
                    key, held, size, seq = now, [], 0, 0
                while first < last:
                    upto = min(last, max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK - size, "right")) - 1))
                    held.append(bytes_[int(ends[first]) : int(ends[upto])].to_pybytes())
                    size += len(held[-1])
                    first = upto
                    if size >= CHUNK or first < last:
                        yield made()
                        held, size, seq = [], 0, seq + 1
        if held:
            yield made()

    schema = pa.schema([("id", pa.int64()), ("block", pa.int64()), ("seq", pa.int32()), ("bytes", pa.int64()), ("data", pa.binary())])
    return written(lines.mapInArrow(cut, CUT))


def summarise(data: bytes, carried: bytes) -> dict:
    """What a chunk does to what is open, and what its end lies within."""
    text = carried + data
    opens: list[tuple[bytes, int, int]] = []
    starts = closes = run = behind = 0
    carries, closer, aside, last = b"", b"<!---->", 0, 0
    for m in TOKEN.finditer(text):
        slash, name, rest, end = m.groups()
        run += m.start() - behind
        behind = m.end()
        if name is None:
            whole = m[0]
            mark, ending, opening = next(x for x in OPEN if whole.startswith(x[0]))
            if mark == b"<![CDATA[":
                run += len(whole)
            if not (whole.endswith(ending) and len(whole) >= len(mark) + len(ending)):
                carries, closer = opening, ending
        elif not end and behind == len(text):
            carries, aside = text[m.start() :], min(len(data), len(text) - m.start())
        elif slash:
            last = starts
            if opens:
                opens.pop()
            else:
                closes += 1
        else:
            starts += 1
            run = 0
            if not rest.endswith(b"/"):
                opens.append((name, starts - 1, m.start()))
    run += len(text) - behind
    before = carried.count(b"\n")
    told = [{"name": name, "ord": ord_, "line": text.count(b"\n", 0, place) - before, "inner": k < len(opens) - 1 or starts > ord_ + 1} for k, (name, ord_, place) in enumerate(opens[:DEEP])]
    return {"carried": carried, "carries": carries, "closer": closer, "aside": aside, "starts": starts, "lines": data.count(b"\n"), "text": run, "closes": closes, "ends": sum((x[1] in data) << k for k, x in enumerate(OPEN)), "opens": told}


def mended(data: bytes, repair: frozenset[str]) -> bytes:
    """Repairs that move tags, as they are alike in all encodings that can be cut."""
    data = data.translate(None, content.CONTROL) if "control-chars" in repair else data
    return content.BARE.sub(b"&amp;", data) if "bare-ampersand" in repair else data


def summaries(chunks: DataFrame, repair: frozenset[str]) -> DataFrame:
    """The summary of every chunk (with carried, what it begins with)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = row.pop("data")
                told = row | {"led": 0, "head": None, "follows": None} | summarise(mended(data, repair), row["carried"] or b"")
                if row["block"] == 0 and row["seq"] == 0:
                    said = formats.FOLLOWS.search(data[:HEAD])
                    led = data[: len(data) - len(continued(data))].count(b"\n")
                    told |= {"led": led, "head": data[:HEAD], "follows": f"{int(said[1])}/{int(said[2])}" if said else None}
                yield pa.RecordBatch.from_pylist([told], kinds)

    opened = pa.list_(pa.struct([("name", pa.binary()), ("ord", pa.int64()), ("line", pa.int64()), ("inner", pa.bool_())]))
    kinds = arrow(SUMMARY, {c: pa.binary() for c in ("carried", "carries", "closer", "head")} | {c: pa.int32() for c in ("seq", "aside", "ends")} | {"follows": pa.string(), "opens": opened})
    return written(chunks.mapInArrow(each, SUMMARY))


def arrow(schema: str, other: dict[str, pa.DataType]) -> pa.Schema:
    """The columns of a schema, long but for the others named."""
    names = [x.split()[0] for x in re.sub(r"<[^>]*>", "", schema).split(", ")]
    return pa.schema([(n, other.get(n, pa.int64())) for n in names])


def continued(data: bytes) -> bytes:
    """A later file of a document without its mark, XML declaration and leading comments."""
    return LEADING.sub(b"", data)


def divisible(head: bytes, used: str) -> bool:
    """Whether a document of this head can be cut at '<': plain text, in an encoding that has ASCII as its bytes."""
    if head[:2] in (b"\x1f\x8b", b"PK") or head[:4] == content.CABINET or formats.ADF_MARK in head[:64] or b"\0" in head[:4]:
        return False
    if used in ("utf-8", "ascii"):
        return True
    try:
        every = bytes(range(256)).decode(used, "replace")
    except LookupError:
        return False
    return len(every) == 256 and every[:128] == bytes(range(128)).decode("ascii")


def scan(encoding: str | None):
    """For the summaries of one document: where each chunk begins."""

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"], r["seq"]))
        head, parts = rows[0]["head"] or b"", sorted({r["part"] for r in rows})
        used, _ = content.settled(head, encoding)
        size = {r["part"]: r["size"] for r in rows}
        for r in rows:
            size[r["part"]] -= r["bytes"]
        # what the reader leaves out: a byte-order mark; or a '<' at the very end, and then only a whole read is right
        whole = not divisible(head, used) or any(n not in (0, 3) for n in size.values())
        marked = size[parts[0]] == 3
        said = {r["part"]: r["follows"] for r in rows if r["head"] is not None}
        wrong = "; ".join(f"part {k} of {len(parts)} says {said[p].replace('/', ' of ')}" for k, p in enumerate(parts[1:], 2) if said.get(p) and said[p] != f"{k}/{len(parts)}")
        stack: list[dict] = []
        carried, closed, out = b"", False, []
        ord_ = line = text = 0
        for at, r in enumerate(rows):
            within = next((k for k, x in enumerate(OPEN) if carried == x[2]), None)
            if within is not None and not r["ends"] >> within & 1:  # all of it lies within a comment or the like: nothing to learn
                size_ = r["bytes"] if OPEN[within][0] == b"<![CDATA[" else 0
                r = r | {"carried": carried, "carries": carried, "closer": OPEN[within][1], "aside": 0, "starts": 0, "text": size_, "closes": 0, "opens": []}
            if r["led"] and r["part"] != parts[0]:  # the head of a later file is no part of the document
                r = r | {"lines": r["lines"] - r["led"], "opens": [x | {"line": x["line"] - r["led"]} for x in r["opens"]]}
            out.append({k: r[k] for k in KEY} | {"document": r["document"], "later": r["part"] != parts[0] and r["block"] == 0 and r["seq"] == 0, "at": at, "stale": carried != (r["carried"] or b""), "whole": whole, "carried": carried, "closer": r["closer"], "aside": r["aside"], "stack": [dict(x) for x in stack], "ord": ord_, "line": line - carried.count(b"\n"), "text": text, "closed": closed, "last": at == len(rows) - 1, "encoding": used + ("+mark" if marked else ""), "wrong": wrong if at == len(rows) - 1 else None, "parts": len(parts)})
            began = bool(stack) or closed
            if r["closes"]:
                del stack[max(0, len(stack) - r["closes"]) :]
            if stack and (r["starts"] or r["closes"]):
                for x in stack:
                    x["inner"] = True
            stack += [{"name": x["name"].decode(used, "replace"), "ord": ord_ + x["ord"], "line": line + x["line"] + 1, "inner": x["inner"]} for x in r["opens"]]
            stack = stack[:DEEP]
            closed = closed or (not stack and (began or r["starts"] > 0))
            text = r["text"] + (0 if r["starts"] else text)
            ord_, line, carried = ord_ + r["starts"], line + r["lines"], r["carries"]
        return pa.Table.from_pylist(out, kinds)

    stacked = pa.list_(pa.struct([("name", pa.string()), ("ord", pa.int64()), ("line", pa.int64()), ("inner", pa.bool_())]))
    other = {c: pa.string() for c in ("document", "encoding", "wrong")} | {c: pa.bool_() for c in ("later", "stale", "whole", "closed", "last")} | {c: pa.binary() for c in ("carried", "closer")} | {"stack": stacked} | {c: pa.int32() for c in ("seq", "at", "aside", "parts")}
    kinds = arrow(START, other)
    return one


def starts(chunks: DataFrame, files: DataFrame, encoding: str | None, repair: frozenset[str]) -> DataFrame:
    """Where each chunk begins (START), from summaries that agree with it."""
    order = [*KEY, "bytes", "carried", "data"]
    found = summaries(chunks.withColumn("carried", F.lit(b"")).select(*order), repair)
    while True:
        begun = written(found.join(files, "id").groupBy("document").applyInArrow(scan(encoding), START))
        stale = begun.filter("stale and not whole").select(*KEY, "carried")
        if stale.isEmpty():
            return begun
        again = summaries(chunks.join(stale, list(KEY)).select(*order), repair)
        found = written(found.join(stale.drop("carried"), list(KEY), "left_anti").unionByName(again))


def parse(chunks: DataFrame, begun: DataFrame, repair: frozenset[str], elements: bool, vocabularies: dict[str, frozenset[str]], encoding: str | None, kinds: frozenset[str] | None) -> DataFrame:
    """The rows of all chunks, with the place of their chunk: records, notes, pieces of elements that chunks share, and counts."""
    order = ["document", "later", "at", "carried", "closer", "aside", "stack", "ord", "line", "text", "closed", "last", "encoding", "wrong", "data"]
    rows = chunks.join(begun.filter("not whole"), list(KEY)).select(*order)

    def one(r: dict) -> Iterator[records.Row]:
        file, (used, _, mark) = r["document"], r["encoding"].partition("+")
        data, at = r["data"], r["at"]
        if at == 0:
            head, _ = content.converted(data[:HEAD], used, repair)
            kind = formats.detect(head, "utf-8", vocabularies) | {"encoding": used, "compression": None}
            _, notes = content.settled(data[:HEAD], encoding)
            notes = [("XAF1001", "the file has a byte-order mark")] * bool(mark) + notes
            if not encoding and formats.forbidden(kind["version"], used):
                notes.append(("XAF1003", f"the version doesn't allow the encoding {used}"))
            if not kind["continuation"] and not head[:1024].lstrip().startswith(b"<?xml"):
                notes.append(("XAF1002", "no XML declaration"))
            yield file, records.FILE, -1, None, None, None, {k: v for k, v in kind.items() if v is not None}
            for k, (code, message) in enumerate(notes):
                yield file, NOTE, -2 - k, None, None, None, {"code": code, "message": message}
        elif r["later"]:
            data = continued(data)
        if r["wrong"]:
            yield file, NOTE, 2**61, None, None, None, {"code": "XAF3009", "message": f"continuation files are numbered inconsistently: {r['wrong']}"}
        _, counts = content.converted(data, used, repair)
        data, carried = mended(data, repair), r["carried"]
        if r["aside"] and not r["last"]:  # a tag that the next chunk begins with
            data = data[: len(data) - r["aside"]]
            carried = carried if data else b""
        text, _ = content.converted(carried + data, used, repair)
        yield file, COUNT, at, None, None, None, {k: str(v) for k, v in counts.items() if v}
        place = records.Place([(x["name"], x["ord"], x["line"], x["inner"]) for x in r["stack"]], r["ord"], r["line"], r["text"], r["closed"], r["last"])
        yield from records.parse_xml(file, text + (b"" if r["last"] else r["closer"]), elements, place, kinds)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():

                def ended(r: dict = r) -> Iterator[records.Row]:
                    try:
                        yield from one(r)
                    except Refused as e:
                        yield r["document"], NOTE, 2**62, None, None, e.line, {"code": e.code, "message": str(e)}

                for made in records.batches_of(ended()):
                    yield made.append_column("at", pa.array([r["at"]] * len(made), pa.int32()))

    return written(rows.mapInArrow(each, PLACED))


def joined_pieces(pieces: DataFrame, elements: bool, kinds: frozenset[str] | None) -> DataFrame:
    """Whole records of the pieces of elements, each piece with its chunk's place: a leaf's text goes to its parent where it ends."""
    get = lambda key: F.try_element_at("fields", F.lit(key))
    own = F.map_filter("fields", lambda k, v: ~k.startswith("\0"))
    ended = get(records.ENDED).isNotNull()
    pieces = pieces.select("file", "at", "ord", "up", "path", "line", get(records.TAG).alias("name"), get(records.TEXT).alias("text"), get(records.COMPLEX).isNotNull().alias("inner"), ended.alias("ended"), own.alias("fields"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    element = pieces.groupBy("file", "ord").agg(
        *[F.first(c).alias(c) for c in ("up", "path", "line", "name")], F.max("inner").alias("inner"), F.max(F.when(F.col("ended"), F.col("at"))).alias("until"), texts.alias("text")
    ).filter("until is not null")
    leaves = element.filter("not inner")
    given = leaves.filter("up is not null").select("file", F.col("up").alias("ord"), F.col("until").alias("at"), F.lit(0).alias("turn"), F.create_map("name", "text").alias("fields"))
    parts = pieces.select("file", "ord", "at", F.lit(1).alias("turn"), "fields").unionByName(given)
    # the first of a name stands
    first = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "turn", F.map_entries("fields").alias("entries")))),
        F.expr("cast(map() as map<string, string>)"),
        lambda all_, x: F.map_concat(all_, F.map_filter(F.map_from_entries(x["entries"]), lambda k, v: ~F.map_contains_key(all_, k))),
    )
    fields = parts.groupBy("file", "ord").agg(first.alias("fields"))
    whole = element.filter("inner") if kinds is None else element.filter("inner").filter(F.col("name").isin(*kinds))
    out = whole.join(fields, ["file", "ord"]).select("file", F.col("name").alias("kind"), "ord", "up", "path", "line", "fields")
    if elements:
        told = F.create_map(F.lit("name"), F.col("name"), F.lit("text"), F.col("text"))
        out = out.unionByName(leaves.select("file", F.lit(records.LEAF).alias("kind"), "ord", "up", "path", "line", told.alias("fields")))
    return out


def counted(rows: DataFrame, repair: frozenset[str]) -> DataFrame:
    """Notes of whole documents from the counts of their chunks."""
    names = ("c1", "lost", "control", "bare")
    sums = rows.filter(F.col("kind") == COUNT).groupBy("file").agg(*[F.sum(F.coalesce(F.try_element_at("fields", F.lit(n)).cast("long"), F.lit(0))).alias(n) for n in names])
    notes = []
    for k, n in enumerate(names):
        code, message = content.counted({x: 0 for x in names} | {n: 1}, repair)[0]
        before, one, after = message.partition("1 ") if n != "c1" else (message, "", "")
        text = F.concat(F.lit(before), F.col(n).cast("string"), F.lit(f" {after}")) if one else F.lit(message)
        fields = F.create_map(F.lit("code"), F.lit(code), F.lit("message"), text)
        notes.append(F.when(F.col(n) > 0, F.struct(F.lit(-10 - k).cast("long").alias("ord"), fields.alias("fields"))))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("up", "long"), ("path", "string"), ("line", "int"))]
    return sums.select("file", F.explode(F.array_compact(F.array(*notes))).alias("x")).select("file", F.lit(NOTE).alias("kind"), "x.ord", *nothing, "x.fields")


def read_ranges(
    spark: SparkSession, paths: str | list[str], wanted: Column, document: Column, *, encoding: str | None, repair: frozenset[str], elements: bool, vocabularies: dict[str, Iterable[str]], kinds: frozenset[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(the rows of the wanted files in records.SCHEMA, the documents that can't be cut and must be read whole).

    wanted and document are columns over a file's _metadata. Parts of one document are taken by name.
    """
    chunks = pieces_of(spark, paths, wanted)
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    files = spark.read.format("binaryFile").load(paths).filter(wanted).select(numbered(path), document.alias("document"), name.alias("part"), F.col("length").alias("size"))
    begun = starts(chunks, written(files), encoding, repair)
    rows = parse(chunks, begun, repair, elements, vocabularies, encoding, kinds)
    # what stands behind the first error of a document is left out
    errors = rows.filter((F.col("kind") == NOTE) & (F.col("ord") == 2**62)).groupBy("file").agg(F.min("at").alias("stop"))
    rows = rows.join(errors, "file", "left").filter(F.col("stop").isNull() | (F.col("at") <= F.col("stop")) | ((F.col("kind") == NOTE) & (F.col("ord") == 2**61))).drop("stop")
    names = [x.split()[0] for x in records.SCHEMA.split(", ")]
    plain = rows.filter(~F.col("kind").isin(PIECE, COUNT)).select(*names)
    if "latin1-as-cp1252" in repair:
        mended_ = rows.filter((F.col("kind") == COUNT) & F.try_element_at("fields", F.lit("c1")).isNotNull()).select("file").distinct().withColumn("mended", F.lit(True))
        said = F.map_concat(F.map_filter("fields", lambda k, v: k != "encoding"), F.create_map(F.lit("encoding"), F.lit("cp1252")))
        plain = plain.join(mended_, "file", "left").withColumn("fields", F.when(F.col("mended") & (F.col("kind") == records.FILE), said).otherwise(F.col("fields"))).select(*names)
    found = plain.unionByName(joined_pieces(rows.filter(F.col("kind") == PIECE), elements, kinds).select(*names)).unionByName(counted(rows, repair).select(*names))
    return found, begun.filter("whole").select("document").distinct()
