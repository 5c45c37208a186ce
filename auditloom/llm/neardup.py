"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct word shingles. Fast similarity sketching fills a sketch of T coordinates in rounds: in each of
the first T rounds every element is hashed to one bin with a value that starts with the round's number, in the next T rounds
to the bin of the round, and a bin keeps its least value; a document is done after the first round in which all its bins are
full. So every coordinate is filled, two sets agree in a coordinate with a chance equal to their similarity, and the share of
agreeing coordinates concentrates around it. Bands of coordinates are then joined, and every link is confirmed on full sets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import durable, salt, text_of, told_of

#: Sets of similarity 0.85 miss all 24 bands of 5 coordinates with a chance of 8 in ten million.
BANDS, ROWS = 24, 5
#: Members of a bucket up to this number are held against each other; larger buckets are searched by what differs from a pivot.
FEW = 12
#: A set that many others are held against goes out once for every so many of them.
PER = 500
#: 64-bit words of the bitmaps that bound the difference of two sets
BITMAP = 8
#: word hashes that a worker keeps, and shingles that are sketched at a time
KEPT_WORDS, AT_ONCE = 500_000, 400_000
ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


HASHES = WordHashes()


def words(text: str) -> list[bytes]:
    """Words between white space U+0009..U+000D and U+0020, A-Z in lower case."""
    return text.encode().lower().split()


def shingle_set(found: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than a shingle has are one shingle, none are none."""
    if not found:
        return np.empty(0, np.uint64)
    if len(HASHES) > KEPT_WORDS:
        HASHES.clear()
    h = np.fromiter(map(HASHES.__getitem__, found), np.uint64, len(found))
    n = min(size, len(found))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = mixed(total + h[k : len(h) - n + 1 + k] * ODD[k % len(ODD)])
    return np.unique(total)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each non-empty set."""
    if not sets:
        return np.empty((0, t), np.uint64)
    empty = np.uint64(2**64 - 1)
    x, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * t, empty, np.uint64)
    for i in range(2 * t):
        v = mixed(x + np.uint64((i + 1) * int(ODD[0]) % 2**64))
        bins = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, of * t + bins, (np.uint64(i) << np.uint64(56)) | (v * ODD[1] >> np.uint64(8)))
        open_ = (out.reshape(-1, t) == empty).any(axis=1)
        if not open_.any():
            break
        more = open_[of]
        x, of = x[more], of[more]
    return out.reshape(-1, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketches), bands))
    for k in range(rows):
        keys = mixed(keys * ODD[2] + sketches[:, k::rows])
    return keys.view(np.int64)


def sketched(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the digest of the words as two numbers, and the band keys (null for an empty set), of each row."""
    names = ["doc_id", "n_shingles", "hi", "lo", "bands"]

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first = 0
            while first < len(texts):
                sets, digests, held, at = [], [], 0, first
                while at < len(texts) and held < AT_ONCE:
                    found = words(texts[at].as_py())
                    sets.append(shingle_set(found, size))
                    digests.append(xxhash.xxh3_128_digest(b" ".join(found)))
                    held += len(sets[-1])
                    at += 1
                full = np.array([len(s) > 0 for s in sets])
                keys = band_keys(sketch([s for s in sets if len(s)], bands * rows), bands, rows)
                hi_lo = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                offsets = pa.array(np.concatenate([[0], np.cumsum(full * bands)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, at - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi_lo[:, 0]), pa.array(hi_lo[:, 1]), lists],
                    names=names,
                )
                first = at

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows_.mapInArrow(of_batch, "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def with_texts(pairs: DataFrame, one: str, texts_of_one: DataFrame, two: str, texts_of_two: DataFrame) -> DataFrame:
    """pairs with both texts; texts are merged in by key at every size, so that what is moved follows the input.

    The second is a pivot that may stand in very many pairs: these are dealt into parts, and its text goes to each part.
    """
    pairs = pairs.withColumn("salt", salt(one))
    counts = pairs.groupBy(two, "salt").agg(F.count("*").alias("n"))
    parts = counts.groupBy(two).agg(F.ceil(F.sum("n") / PER).cast("int").alias("parts"))
    dealt = durable(pairs.join(told_of(counts, [two], parts), [two, "salt"]).withColumn("part", F.col("salt") % F.col("parts")).drop("salt", "parts"))
    pivots = dealt.select(two, "part").distinct().hint("merge").join(texts_of_two.hint("merge"), two)
    return dealt.hint("merge").join(texts_of_one.hint("merge"), one).hint("merge").join(pivots.hint("merge"), [two, "part"])


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The rows of one a lie together, so its set is made once; a pair whose b holds too few or too many shingles has no chance and
    was left out before.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            good = []
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a not in kept:
                    kept[a] = shingle_set(words(batch.column(2)[i].as_py()), size)
                    if len(kept) > 64:
                        kept.popitem(last=False)
                one, two = kept[a], shingle_set(words(batch.column(3)[i].as_py()), size)
                both = int(np.isin(one, two, assume_unique=True).sum())
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return with_texts(pairs, "b", second, "a", first).select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def differences(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs (p, u) with the shingles that only one of the two sets has, a bitmap of these, and the sizes of both sets."""
    names = ["p", "u", "only", "np", "nu", *(f"s{k}" for k in range(BITMAP))]

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            lists, sizes, bitmaps = [], ([], []), []
            for i, p in enumerate(batch.column(0).to_pylist()):
                if p not in kept:
                    kept[p] = shingle_set(words(batch.column(2)[i].as_py()), size)
                    if len(kept) > 64:
                        kept.popitem(last=False)
                one, two = kept[p], shingle_set(words(batch.column(3)[i].as_py()), size)
                only = np.setxor1d(one, two, assume_unique=True)
                bits = np.zeros(BITMAP, np.uint64)
                np.bitwise_or.at(bits, (only % np.uint64(BITMAP)).astype(np.int64), np.uint64(1) << (only >> np.uint64(32) & np.uint64(63)))
                bitmaps.append(bits.view(np.int64))
                lists.append(only.view(np.int64))
                sizes[0].append(len(one))
                sizes[1].append(len(two))
            columns = np.array(bitmaps, np.int64).reshape(-1, BITMAP)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64())), pa.array(sizes[0], pa.int64()), pa.array(sizes[1], pa.int64()), *(pa.array(columns[:, k]) for k in range(BITMAP))], names=names
            )

    first = texts.select(F.col("doc_id").alias("p"), F.col("text").alias("tp"))
    second = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    schema = "p long, u long, only array<long>, np long, nu long" + "".join(f", s{k} long" for k in range(BITMAP))
    return with_texts(pairs, "u", second, "p", first).select("p", "u", "tp", "tu").mapInArrow(differ, schema)


def around_pivots(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b, of_a, of_b) of different components in large buckets, without forming all pairs.

    Let D be what differs between a set and its bucket's pivot p, and k = (1 - t) / (1 + t) for similarity t. Two sets u and v are
    linked only if |Du & Dv| >= (eu + ev) / 2 with e = |D| - k * |set|. A set that isn't linked with the pivot has e > k * |p|, and of two
    sets of different components one is such a set, v. So u must share one of its |Du| - floor((eu + k * |p|) / 2) rarest
    differences with v. Copies with different edits differ from the pivot in different shingles, so few pairs come up.
    """
    k = (100 - percent) / (100 + percent)
    pairs = members.select(F.col("pivot").alias("p"), F.col("doc_id").alias("u"), F.col("component").alias("of_u"), F.col("of_pivot").alias("of_p")).filter("p != u").distinct()
    found = durable(differences(pairs.select("p", "u"), texts, size).join(pairs, ["p", "u"]))
    each = found.select("p", "u", salt("u"), F.explode("only").alias("x"))
    parts = each.groupBy("p", "x", "salt").agg(F.count("*").alias("m"))
    counts = parts.groupBy("p", "x").agg(F.sum("m").alias("c")).filter("c > 1")
    # a difference that no other set has can't be shared: it only shortens the prefix
    shared = each.join(told_of(parts, ["p", "x"], counts), ["p", "x", "salt"]).groupBy("p", "u").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("xs"))
    rows = durable(found.withColumn("d", F.size("only")).drop("only").join(shared, ["p", "u"]))
    need = F.floor((F.col("d") - F.lit(k) * F.col("nu") + F.lit(k) * F.col("np")) / 2 - 1e-6)
    prefix = F.slice("xs", 1, F.greatest(F.least(F.size("xs"), F.size("xs") - need), F.lit(0)).cast("int"))
    bits = [f"s{i}" for i in range(BITMAP)]
    one = rows.select("p", F.col("u").alias("a"), F.col("of_u").alias("of_a"), F.col("nu").alias("na"), *bits, F.explode(prefix).alias("y")).withColumn("x", F.col("y.x")).drop("y")
    two = rows.filter("of_u != of_p").select(F.col("p").alias("q"), F.col("u").alias("b"), F.col("of_u").alias("of_b"), F.col("nu").alias("nb"), *[F.col(c).alias(f"t{c}") for c in bits], F.explode("xs.x").alias("z"))
    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"t{c}"))) for c in bits), F.lit(0))
    near = (F.col("of_a") != F.col("of_b")) & (differing <= F.lit(k) * (F.col("na") + F.col("nb")) + 1e-6)
    apart = one.join(two, (F.col("p") == F.col("q")) & (F.col("x") == F.col("z")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return apart.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): the least node that can be reached."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("far"))
        new = durable(least.join(jump, "now").select("node", "was", F.least("now", "far").alias("component")))
        moved = new.filter("was != component").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Rows of equal words are one class, which its least doc_id stands for. Each class is first held against the pivot that it
    shares most bands with, then against the pivots of its other buckets, and last the members of a bucket that are still in
    different components are searched for links (see around_pivots for large buckets); a pair that is already connected needs
    no test. So a large group of copies costs a test or two for each member, and no link between components is lost.

    Null or empty texts, and texts without words, have an empty set and are linked with nothing. Rows of one doc_id are one
    document. A null doc_id has no component and is kept. Other columns are not read; no rows give no rows.
    """
    made = durable(sketched(docs, size, bands, rows))
    able = made.filter("doc_id is not null and n_shingles > 0")
    classes = durable(able.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("x"), F.count("*").alias("rows")))
    of_band = classes.select(F.col("x.doc_id").alias("doc_id"), F.col("x.n_shingles").alias("n"), salt("x.doc_id"), F.explode("x.bands").alias("band"))
    parts = of_band.groupBy("band", "salt").agg(F.count("*").alias("m"))
    full = durable(told_of(parts, ["band"], parts.groupBy("band").agg(F.sum("m").alias("c")).filter("c > 1")))
    inside = durable(of_band.join(full, ["band", "salt"]))
    # the pivot of a bucket is its member with most company in all its buckets: the likeliest centre of a group of copies
    score = inside.groupBy("doc_id").agg(F.sum("c").alias("score"))
    pivots = inside.join(score, "doc_id").groupBy("band").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("by"), "doc_id", "n")).alias("pivot"))
    members = durable(inside.join(told_of(full, ["band"], pivots), ["band", "salt"]))
    fits = lambda m, n: (100 * m >= percent * n) & (100 * n >= percent * m)
    stars = members.filter(F.col("doc_id") != F.col("pivot.doc_id")).filter(fits(F.col("n"), F.col("pivot.n")))
    stars = durable(stars.groupBy(F.col("pivot.doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("c")))

    ids = members.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    texts = durable(texts.hint("merge").join(ids.hint("merge"), "doc_id", "left_semi"))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
    edges = durable(confirmed(best, texts, size, percent))
    tested = best
    for step in ("stars", "rest"):
        labels = components(edges)
        label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        if step == "stars":
            pairs = stars.select("a", "b").join(tested, ["a", "b"], "left_anti")
            apart = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
        else:
            here = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            here = here.select("band", "salt", "doc_id", "n", "c", "component", F.col("pivot.doc_id").alias("pivot"))
            mixed_ = here.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.when(F.col("doc_id") == F.col("pivot"), F.col("component"))).alias("of_pivot"))
            left = durable(here.join(told_of(full, ["band"], mixed_.filter("x != y").select("band", "of_pivot")), ["band", "salt"]))
            few = left.filter(F.col("c") <= FEW)
            one = few.select("band", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("component").alias("of_a"))
            two = few.select("band", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("of_b"))
            pairs = one.join(two, "band").filter((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & fits(F.col("na"), F.col("nb")))
            apart = durable(pairs.select("a", "b").unionByName(around_pivots(left.filter(F.col("c") > FEW), texts, size, percent)).distinct())
            tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            apart = apart.join(tried, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
        apart = durable(apart.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
        edges = durable(edges.unionByName(confirmed(apart, texts, size, percent)))
    labels = components(edges).select(F.col("node").alias("least"), "component")
    several = classes.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.col("x.doc_id").alias("least")).join(labels, "least", "left")
    several = several.withColumn("component", F.coalesce("component", "least"))
    rows_ = made.join(several, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows_.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = 4) -> DataFrame:
    """The rows of docs, in docs' columns, but for those near-duplicates of which a smaller doc_id stays."""
    gone = near_duplicates(docs, size, percent, bands, rows).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")
