"""Exact removal of repeated byte strings by sorted suffixes.

Every window of the given length is served by an anchor inside it that only its own bytes decide, and the windows of one
anchor form a segment. An anchor that stands nowhere else serves no repeated window and goes. Of all others, the suffix that
starts at the anchor, followed by what lies before it read backwards, is sorted by a distributed merge sort: tasks sort runs and
send them front-coded, each string once a run, and a tree of losers merges what arrives without comparing known prefixes again.
Where the common prefix is the whole string, segments are equal, and all but the first are repeated. Else the longest common
prefixes with the neighbours bound what of a segment can be repeated after its anchor, and a second merge sort, of the prefixes
before it read backwards, what before it; parts that are equal within these bounds are settled, and the windows of the others
are sorted in the same way, where equal ones meet. Strings are only ever held equal by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import suffix_runs as R
from auditloom.llm.common import WRITTEN, drop_tables, durable, salt, text_of, told_of

#: strings in a bucket of the merge, the most ranges that splitters bound, and strings that are drawn for each splitter
IN_BUCKET, RANGES, DRAWN = 250_000, 4096, 20
#: rows of segments in a partition
IN_PARTITION = 500_000
BLOCK = "bucket int, shared binary, lengths binary, tails binary, docs binary, keys binary, places binary"
PLACE = "doc long, key long, p long"
Batches = Iterator[pa.RecordBatch]


def numbered(docs: DataFrame) -> DataFrame:
    """ord (doc_id, nulls first), key (a digest of the text that tells rows of one doc_id apart) and the text's bytes."""
    text = text_of()
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("ord"), F.xxhash64(text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("body")
    )


def numpy_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def batch_of(columns: tuple, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "byte": pa.int8(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """The segments of all rows, counted within tasks."""
    schema = f"to int, kind byte, h long, {PLACE}"

    def made(batches: Batches) -> Batches:
        held, size = [], 0
        texts = ((o, v, b) for batch in batches for o, v, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for part in R.segments(texts, length):
            held.append(part)
            size += len(part[0])
            if size >= R.COUNTED:
                yield batch_of(R.counted(*(np.concatenate(c) for c in zip(*held, strict=True))), schema)
                held, size = [], 0
        if held:
            yield batch_of(R.counted(*(np.concatenate(c) for c in zip(*held, strict=True))), schema)

    return rows.select("ord", "key", "body").mapInArrow(made, schema)


def not_alone(found: DataFrame, partitions: int) -> DataFrame:
    """The places whose anchor stands elsewhere too: each partition holds all rows of an anchor, sorted, and is read once."""

    def scan(batches: Batches) -> Batches:
        left: list[np.ndarray] | None = None
        for batch in batches:
            columns = numpy_of(batch)
            sure = columns[0] == R.SURE
            yield batch_of(tuple(c[sure] for c in columns[2:]), PLACE)
            columns = [c[~sure] for c in columns]
            if left is not None:
                columns = [np.concatenate(c) for c in zip(left, columns, strict=True)]
            # the last anchor may go on in the next batch
            cut = int(np.searchsorted(columns[1], columns[1][-1])) if len(columns[1]) else 0
            left = [c[cut:] for c in columns]
            if cut:
                yield batch_of(R.repeated(*(c[:cut] for c in columns)), PLACE)
        if left is not None and len(left[0]):
            yield batch_of(R.repeated(*left), PLACE)

    dealt = found.repartition(partitions, "to").sortWithinPartitions("h").select("kind", "h", "doc", "key", "p")
    return dealt.mapInArrow(scan, PLACE)


def with_bodies(places: DataFrame, rows: DataFrame, few: bool = False) -> DataFrame:
    """ord, key, body and places (array of p) of the rows that have places; of few places, no text is shuffled."""
    lists = places.groupBy(F.col("doc").alias("of_ord"), F.col("key").alias("of_key")).agg(F.collect_set("p").alias("places"))
    joined = rows.join(F.broadcast(lists) if few else lists, (F.col("ord") == F.col("of_ord")) & (F.col("key") == F.col("of_key")))
    return joined.select("ord", "key", "body", "places")


def around_anchors(batch: pa.RecordBatch, length: int) -> Iterator[R.Row]:
    """Of each place, the suffix from its anchor to its segment's end, the part before the anchor backwards, and the latter's length."""
    for doc, key, text, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
        for p in places:
            first, at = p >> 16, p & 0xFF
            anchor = first + at
            yield text[anchor : first + (p >> 8 & 0xFF) + length - 1] + text[first:anchor][::-1] + bytes((at,)), doc, key, p


def before_anchors(batch: pa.RecordBatch) -> Iterator[R.Row]:
    """Of open segments, the anchor and what lies before it read backwards."""
    for doc, key, p, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
        at = p & 0xFF
        yield text[at : at + R.GRAM] + text[:at][::-1], doc, key, p


def windows_of(batch: pa.RecordBatch, length: int) -> Iterator[R.Row]:
    """The windows of clipped segments."""
    for doc, key, first, windows, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
        for k in range(windows):
            yield text[k : k + length], doc, key, (first + k) << 16


def drawn_from(rows: DataFrame, strings: Callable[[pa.RecordBatch], Iterator[R.Row]], most: int) -> list[bytes]:
    """At most so many strings of a sample of rows, sorted; the bound is DRAWN * RANGES."""

    def drawn(batches: Batches) -> Batches:
        for batch in batches:
            yield batch_of(([r[0] for r in strings(batch)],), "s binary")

    return sorted(bytes(r[0]) for r in rows.mapInArrow(drawn, "s binary").limit(most).collect())


def sizes(count: int) -> tuple[int, int, int]:
    """Ranges, buckets in a range, and strings to draw for the splitters, of so many strings."""
    buckets = max(1, -(-count // IN_BUCKET))
    ranges = min(buckets, RANGES)
    return ranges, -(-buckets // ranges), DRAWN * ranges


def merge_sorted(
    rows: DataFrame, strings: Callable[[pa.RecordBatch], Iterator[R.Row]], count: int, some: list[bytes],
    collapse: Callable, judge: Callable, direct: Callable, schema: str,
) -> DataFrame:
    """The distributed merge sort: runs of what strings() makes of each batch, exchanged in front-coded blocks by splitters,
    merged bucket by bucket, and handed to judge(rows in order, splitter below, splitter above).

    A bounded sample places the splitters, which can't change the result. Equal strings can't be split, but each run sends but one
    of them; what collapse() tells of the others is handed to direct(documents, keys, places, lengths).
    """
    ranges, subs, _ = sizes(count)
    splitters = sorted({some[k * len(some) // ranges] for k in range(1, ranges)}) if some else []

    def runs(batches: Batches) -> Batches:
        def emit(held: list[R.Row]) -> pa.RecordBatch:
            return batch_of(tuple(zip(*R.sorted_blocks(held, splitters, subs, collapse), strict=True)), BLOCK)

        held: list[R.Row] = []
        for batch in batches:
            for row in strings(batch):
                held.append(row)
                if len(held) >= R.IN_RUN:
                    yield emit(held)
                    held = []
        if held:
            yield emit(held)

    def merged(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blocks = list(zip(*(table.column(k).to_pylist() for k in range(1, 7)), strict=True))
        if bucket < 0:
            columns = direct(*(np.concatenate([np.frombuffer(b[k], np.int64) for b in blocks]) for k in (3, 4, 5)), np.frombuffer(b"".join(b[1] for b in blocks), np.uint8))
        else:
            part = bucket // subs
            columns = judge(R.merge([R.read_block(b) for b in blocks]), splitters[part - 1] if part else None, splitters[part] if part < len(splitters) else None)
        return pa.Table.from_batches([batch_of(columns, schema)])

    return rows.mapInArrow(runs, BLOCK).repartition((len(splitters) + 1) * subs, "bucket").groupBy("bucket").applyInArrow(merged, schema)


def start(row: tuple) -> tuple[int, int]:
    """(document, first window) of (document, row key, place)."""
    return row[0], row[2] >> 16


def first_and_later(members: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Of equal strings at (document, row key, place), those that start first, and those that also start earlier."""
    least = min(map(start, members))
    return sorted({m for m in members if start(m) == least}), [m for m in members if start(m) > least]


def first_of_run(rows: list[R.Row]) -> tuple[list[R.Row], list[R.Row]]:
    first, later = first_and_later([r[1:] for r in rows])
    return [(rows[0][0], *m) for m in first], [(rows[0][0], *m) for m in later]


def ghost_of_run(rows: list[R.Row]) -> tuple[list[R.Row], list[R.Row]]:
    """Rows with equal strings have as long a common prefix as can be; what others have in common with them, one row without place shows."""
    return [(rows[0][0], 0, 0, -1)], rows


def equals(rows: Iterator[R.Merged]) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """(common prefix with the string before, string, its rows) of each different string."""
    last, text, members = 0, b"", []
    for shared, string, *row in rows:
        if members and shared == len(text) == len(string):
            members.append(tuple(row))
            continue
        if members:
            yield last, text, members
        last, text, members = shared, string, [tuple(row)]
    if members:
        yield last, text, members


def neighboured(rows: Iterator[R.Merged], below: bytes | None, above: bytes | None) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """(longest common prefix with another string, string, its rows) of each different string.

    The neighbour in another bucket lies beyond the splitter, which shares at least as much.
    """
    held: tuple[int, bytes, list[tuple[int, int, int]]] | None = None
    for shared, text, members in equals(rows):
        if held is None:
            shared = R.common(text, below) if below is not None else 0
        else:
            yield max(held[0], shared), *held[1:]
        held = shared, text, members
    if held is not None:
        yield max(held[0], R.common(held[1], above) if above is not None else 0), *held[1:]


COVERED, OPEN = range(2)
SEGMENT = f"kind byte, {PLACE}, after int, segment binary"


def equal_segments(rows: Iterator[R.Merged], below: bytes | None, above: bytes | None) -> tuple:
    """Of strings around_anchors() in order: all but the first of equal ones are covered, those with an anchor in common open."""
    out: list[tuple] = []
    for near, text, members in neighboured(rows, below, above):
        first, later = first_and_later(members)
        out += [(COVERED, *m, None, None) for m in later]
        if near >= R.GRAM:
            at = text[-1]
            suffix = text[: len(text) - 1 - at]
            segment = text[len(suffix) : -1][::-1] + suffix
            out += [(OPEN, *m, min(near, len(suffix)), segment) for m in first]
    return tuple(zip(*out, strict=True)) if out else ([],) * 6


def covered_segments(docs: np.ndarray, keys: np.ndarray, places: np.ndarray, _: np.ndarray) -> tuple:
    return np.full(len(docs), COVERED, np.int8), docs, keys, places, [None] * len(docs), [None] * len(docs)


NEAR = f"{PLACE}, before int"


def near_before(rows: Iterator[R.Merged], below: bytes | None, above: bytes | None) -> tuple:
    out = [(*m, len(text) if len(members) > 1 else near) for near, text, members in neighboured(rows, below, above) for m in members if m[2] >= 0]
    return tuple(zip(*out, strict=True)) if out else ([],) * 4


def later_windows(rows: Iterator[R.Merged], below: bytes | None, above: bytes | None) -> tuple:
    out = [m for _, _, members in equals(rows) if len(members) > 1 for m in first_and_later(members)[1]]
    return tuple(zip(*out, strict=True)) if out else ([],) * 3


def clipped(rows: DataFrame, length: int) -> DataFrame:
    """Open segments cut down to the windows that may be repeated, with a hash of the anchor; the others are dropped."""
    schema = "h long, doc long, key long, first long, windows long, segment binary"

    def clip(batches: Batches) -> Batches:
        for batch in batches:
            out: list[tuple] = []
            for doc, key, p, after, text, before in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                at, windows, first = p & 0xFF, (p >> 8) & 0xFF, p >> 16
                least = max(at - windows + 1, length - after)
                most = min(at, before - R.GRAM)
                if least <= most:
                    h = xxhash.xxh3_64_intdigest(text[at : at + R.GRAM]) >> 1
                    out.append((h, doc, key, first + at - most, most - least + 1, text[at - most : at - least + length]))
            yield batch_of(tuple(zip(*out, strict=True)) if out else ([],) * 6, schema)

    return rows.mapInArrow(clip, schema)


def covered(docs: DataFrame, length: int = 100) -> DataFrame:
    """(ord, key, spans) of the rows with windows that also start earlier; spans: array of (first window, windows).

    The tables between its steps go as soon as the next is written, and the last ones when the spans are.
    """
    spark, began = docs.sparkSession, len(WRITTEN)
    rows = numbered(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    partitions = max(1, -(-int(chars) // (IN_PARTITION * 30)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = durable(not_alone(anchored(rows, length), partitions))
    count = places.count()
    strings = lambda b: around_anchors(b, length)
    most = sizes(count)[2]
    some = drawn_from(with_bodies(places.sample(min(1.0, most / count), seed=7).limit(2 * most), rows, few=True), strings, 2 * most) if count > IN_BUCKET else []
    found = durable(merge_sorted(with_bodies(places, rows), strings, count, some, first_of_run, equal_segments, covered_segments, SEGMENT))
    drop_tables(spark, began, keep=1)
    whole = found.filter(F.col("kind") == COVERED).select("doc", "key", F.shiftrightunsigned("p", 16).alias("first"), F.shiftrightunsigned("p", 8).bitwiseAND(F.lit(255)).alias("windows"))

    unclear = found.filter(F.col("kind") == OPEN).select("doc", "key", "p", "segment", "after")
    count = unclear.count()
    most = sizes(count)[2]
    some = drawn_from(unclear.sample(min(1.0, most / count), seed=7), before_anchors, 2 * most) if count > IN_BUCKET else []
    near = merge_sorted(unclear, before_anchors, count, some, ghost_of_run, near_before, lambda d, k, p, n: (d, k, p, n.astype(np.int32)), NEAR)
    near = near.withColumnsRenamed({"doc": "d", "key": "k", "p": "q"})
    bounded = unclear.join(near, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k")) & (F.col("p") == F.col("q"))).select("doc", "key", "p", "after", "segment", "before")
    clips = durable(clipped(bounded, length))
    # an anchor's equal parts meet whole; only where its parts differ, their windows are sorted
    parts = clips.groupBy("h", "segment", salt("doc")).agg(F.min(F.struct("doc", "first")).alias("x"))
    firsts = parts.groupBy("h", "segment").agg(F.min("x").alias("least"))
    of_anchor = firsts.groupBy("h", salt("segment")).agg(F.count("*").alias("n"))
    several = of_anchor.groupBy("h").agg((F.sum("n") > 1).alias("several"))
    firsts = firsts.withColumn("salt", salt("segment")).join(told_of(of_anchor, ["h"], several), ["h", "salt"]).drop("salt")
    told = clips.withColumn("salt", salt("doc")).join(told_of(parts, ["h", "segment"], firsts), ["h", "segment", "salt"])
    told = durable(told.withColumn("again", F.struct("doc", "first") > F.col("least")).filter("again or several"))
    drop_tables(spark, began + 1, keep=1)  # the clipped segments
    equal = told.filter("again").select("doc", "key", "first", "windows")
    rest = told.filter("not again").select("doc", "key", "first", "windows", "segment")
    count = rest.agg(F.sum("windows")).first()[0] or 0
    most = sizes(count)[2]
    some = drawn_from(rest.sample(min(1.0, most / count), seed=7), lambda b: windows_of(b, length), 2 * most) if count > IN_BUCKET else []
    single = merge_sorted(rest, lambda b: windows_of(b, length), count, some, first_of_run, later_windows, lambda d, k, p, _: (d, k, p), PLACE)
    single = single.select("doc", "key", F.shiftrightunsigned("p", 16).alias("first"), F.lit(1).cast("long").alias("windows"))
    spans = whole.unionByName(equal).unionByName(single)
    spans = durable(spans.groupBy(F.col("doc").alias("of_ord"), F.col("key").alias("of_key")).agg(F.collect_list(F.struct("first", "windows")).alias("spans")))
    drop_tables(spark, began, keep=1)
    return spans


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with_text adds the bytes that are kept.

    A null text is empty, and a text shorter than the length has nothing to remove; rows without doc_id come before all others
    and, like rows of one doc_id, count as one document: of equal strings in them, only those at a later place are repeated. So
    repeated rows are not repeats of each other; other columns are not read; no rows give no rows.
    """
    rows, found = numbered(docs), covered(docs, length)
    joined = rows.join(found, (F.col("ord") == F.col("of_ord")) & (F.col("key") == F.col("of_key")), "left").select("doc_id", "body", "spans")

    def removed(batches: Batches) -> Batches:
        for batch in batches:
            out: list[tuple] = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                kept, gone, runs = text, 0, 0
                if spans.is_valid:
                    first, windows = (spans.values.field(k).to_numpy() for k in range(2))
                    order = np.argsort(first, kind="stable")
                    first, last = first[order], np.maximum.accumulate((first + windows + length - 1)[order])
                    new = np.append(True, first[1:] > last[:-1])
                    starts, ends = first[new], last[np.append(np.flatnonzero(new)[1:] - 1, len(last) - 1)]
                    gone, runs = int((ends - starts).sum()), len(starts)
                    cuts = zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)
                    kept = b"".join(text[a:b] for a, b in cuts)
                out.append((len(text), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            made = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                made.append(pa.array(columns[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(made, names=names)

    return joined.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
