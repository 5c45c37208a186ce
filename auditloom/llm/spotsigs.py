"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot is a common word (the anchor) with the chain of content words that follow it; common words between them are passed
over. A document's fingerprint is the set of its spots' digests. Fingerprints are compared by Jaccard similarity. Where those that
are near are looked for, sets are partitioned by length, so that sets whose lengths alone rule out a similarity never meet, and
only sets that share one of the rarest spots of the one asked for are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.llm.common import durable, lower_ascii, salt, text_of, told_of

# FIXED VALUES: common words of English, German, French and Spanish
COMMON = """
a an and are as at be been but by can for from had has have he her his i if in is it its not of on or our she that the their
them they this to was we were which will with you
aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht oder
sich sie sind so und von war werden wie zu zum zur
au aux avec ce ces cette dans de du elle en est et il je la le les leur lui mais ne nous ou par pas plus pour que qui sa se
ses son sont sur un une vous
al con como del el ella las lo los más no para pero por se si sin su sus una uno y
""".split()
#: content words in a chain
CHAIN = 2
#: Rows whose doc_id is divisible by this are asked for all rows of this likeness.
ASKED, SIMILARITY = 100, 0.8
OPEN, CLOSE = "⟨", "⟩"
APART = r"[\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+"


def fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sorted distinct spot digests of a text column as an array.

    A text with words but no spot has one digest, of all its words, so that only equal word sequences are alike; no words, none.
    """
    inner = F.concat(F.lit(OPEN), F.regexp_replace(F.translate(lower_ascii(F.col(text)), OPEN + CLOSE, ""), APART, CLOSE + OPEN), F.lit(CLOSE))
    marked = F.regexp_replace(inner, f"{OPEN}({'|'.join(sorted(set(COMMON)))}){CLOSE}", "\x01$1\x02")
    rows = rows.withColumn("tokens_", F.filter(F.split(marked, CLOSE), lambda x: x.contains(OPEN) & ~x.endswith(OPEN)))
    rows = rows.withColumn("content_", F.transform("tokens_", lambda x: F.substring_index(x, OPEN, -1)))
    anchor = lambda x: F.substring_index(F.substring_index(x, "\x01", -1), "\x02", 1)
    chain = lambda i: [F.get(F.col("content_"), i + k) for k in range(CHAIN)]
    spot = lambda x, i: F.when(x.startswith("\x01") & (i + CHAIN <= F.size("content_")), F.substring(F.md5(F.concat_ws(" ", anchor(x), *chain(i))), 1, 12))
    rows = rows.withColumn("spots_", F.array_sort(F.array_distinct(F.array_compact(F.transform("tokens_", spot)))))
    all_ = F.when(F.col(text).rlike(r"[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]"), F.array(F.substring(F.md5(marked), 1, 12))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn(name, F.when(F.size("spots_") > 0, F.col("spots_")).otherwise(all_)).drop("tokens_", "content_", "spots_")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(F.col(a)) + F.size(F.col(b)) - both))


#: rows of a bucket of neighbouring documents, and the most buckets there are
IN_BUCKET, BUCKETS = 1500, 16_000


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text (of the next row by doc_id, after the last the first) of each row.

    Rows are put into buckets of ids that quantiles bound, and the first row of each bucket also goes to the bucket before, so
    texts are shuffled once and nothing passes through one task. Null ids come first; rows of one id are ordered by a hash.
    """
    least = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("ord", F.coalesce("doc_id", F.lit(least)))
    n = min(BUCKETS, max(1, -(-rows.count() // IN_BUCKET)))
    cuts = sorted({int(x) for x in rows.approxQuantile("ord", [k / n for k in range(1, n)], 0.25 / n)}) if n > 1 else []
    step = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col("ord")))
    if parts:
        outer = below(F.array(*[F.lit(p[0]) for p in parts]))
        inner = F.element_at(F.array(*[F.array(*[F.lit(x) for x in p]) for p in parts]), F.greatest(F.col("outer"), F.lit(1)))
        rows = rows.withColumn("outer", outer).withColumn("bucket", F.col("outer") * F.lit(step + 1) + F.when(F.col("outer") > 0, below(inner)).otherwise(0)).drop("outer")
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    # one row for each bucket, BUCKETS at most
    firsts = sorted((r["first"], r["bucket"]) for r in rows.groupBy("bucket").agg(F.min("ord").alias("first")).collect())
    spark = docs.sparkSession
    before = [(first, firsts[k - 1][1], k == 0) for k, (first, _) in enumerate(firsts)]
    guards = F.broadcast(spark.createDataFrame(before, "first long, to int, wraps boolean"))
    again = rows.join(guards, rows["ord"] == guards["first"]).select("doc_id", "text", "ord", F.col("to").alias("bucket"), F.lit(1).alias("guard"))
    both = rows.withColumn("guard", F.lit(0)).unionByName(again)
    order = W.partitionBy("bucket").orderBy("guard", "ord", F.xxhash64("text"))
    return both.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.struct("guard", "ord", F.xxhash64("text")))


def edited_fingerprints(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness to each other and to the next row's; and for rows whose
    doc_id is divisible by ASKED n_near, the number of other rows whose fingerprint is at least as like as similarity.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next row's text. A null
    text is empty, a single row is its own next; a null doc_id stays null and comes first; repeated rows are fingerprinted
    each, and near each other; an empty fingerprint is near none; other columns are not read; no rows give no rows.
    """
    rows = neighbours(docs).withColumn("n", F.length("text")).withColumn("k", F.floor(F.col("n") / 2).cast("int"))
    edited = F.concat(F.left("text", F.col("n") - F.col("k")), F.left(F.coalesce("next_text", F.lit("")), F.col("k")))
    rows = rows.withColumn("edited", F.when(F.col("guard") == 0, edited).otherwise(""))
    rows = fingerprint(fingerprint(rows, "text", "own"), "edited", "other")
    rows = rows.select("bucket", "guard", "ord", "place", "doc_id", "n", F.sha2("edited", 256).alias("edited_sha256"), "own", "other")
    rows = rows.withColumn("next", F.lead("own").over(W.partitionBy("bucket").orderBy("guard", "ord", F.col("place.col3")))).filter("guard = 0")
    text = lambda c: F.array_join(c, " ")
    done = durable(
        rows.select(
            "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", text("own").alias("fingerprint"), text("other").alias("edited_fingerprint"),
            likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"),
        )
    )
    is_asked = F.coalesce(F.col("doc_id") % ASKED == 0, F.lit(False))
    sets = done.filter("fingerprint != ''").select("doc_id", is_asked.alias("asked"), F.xxhash64("fingerprint").alias("print"), "fingerprint", F.split("fingerprint", " ").alias("spots"))
    near = near_counts(sets, similarity).select(F.md5("fingerprint").alias("key"), "n_near")
    asked = done.filter(is_asked).withColumns({"key": F.md5("fingerprint"), "salt": salt("doc_id")})
    parts = asked.groupBy("key", "salt").agg(F.count("*").alias("n"))
    found = asked.join(told_of(parts, ["key"], near), ["key", "salt"], "left").select(*done.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    return found.unionByName(done.filter(~is_asked).withColumn("n_near", F.lit(None).cast("long")))


def prefix(sets: DataFrame, key: str, similarity: float) -> DataFrame:
    """(key, n, spot) of the rarest spots of each set, of which a set of that similarity must hold one."""
    each = sets.select(key, F.explode("spots").alias("spot"))
    counts = each.groupBy("spot").agg(F.count("*").alias("c"))
    ordered = each.join(counts, "spot").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("c", "spot"))).alias("xs")).withColumn("n", F.size("xs"))
    return ordered.select(key, "n", F.explode(F.slice("xs", 1, (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int"))).alias("x")).select(key, "n", "x.spot")


def part(n: str, similarity: float) -> Column:
    """The partition of a set's length: sets of that similarity are in the same or in neighbouring ones."""
    return F.floor(F.log(n) / -F.log(F.lit(similarity))).cast("int")


#: spots in a shard of sets, or in a block of asked ones, that are held against each other at once; a larger set is alone
IN_CELL = 8192


def families(keys: DataFrame) -> DataFrame:
    """(q, family) of asked sets of keys (q, spot, part, own): the key of its own length that it shares with most others.

    A key of m sets leads to few families: each of them stands for a key of at least m sets, so there are no more than the root of
    all keys.
    """
    shared = keys.filter("part = own").groupBy("key").agg(F.count("*").alias("c"))
    return keys.filter("part = own").join(shared, "key").groupBy("q").agg(F.max_by("key", F.struct("c", "key")).alias("family"))


def near_counts(sets: DataFrame, similarity: float) -> DataFrame:
    """(fingerprint, n_near) of those that are asked for: how many other rows of sets (doc_id, asked, print, fingerprint, spots) are as
    like as that.

    Equal prints are compared once. A spot meets its like by a hash with its set's partition, so only two numbers are moved for each,
    and by a merge at every size. What it meets is a family of asked sets, not each of them: in a large group of near copies each
    set makes a few rows however many of the group are asked for. Families are cut into blocks, the sets that met them into
    shards, of bounded sizes; a block and a shard are compared within a row and give a count for each asked set. What comes up by
    chance is told apart by the spots themselves.
    """
    asked = durable(sets.filter("asked").select(F.col("print").alias("q"), "fingerprint", "spots").dropDuplicates(["fingerprint"]))
    parts = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.col("own") + k)
    keys = prefix(asked.select("q", "spots"), "q", similarity).withColumn("own", part("n", similarity)).select("q", "spot", "own", F.explode(parts).alias("part"))
    keys = durable(keys.withColumn("key", F.xxhash64("spot", "part")))
    family = durable(families(keys))
    met = durable(keys.join(family, "q").select("key", "family").distinct())
    rows = sets.withColumn("part", F.floor(F.log(F.size("spots")) / -F.log(F.lit(similarity))).cast("int"))
    each = rows.select("print", F.explode(F.transform("spots", lambda x: F.xxhash64(x, F.col("part")))).alias("key"))
    pairs = durable(each.hint("merge").join(met.hint("merge"), "key").select("print", "family").distinct())
    some = sets.select("doc_id", "print", "spots", salt("doc_id"))
    wanted = told_of(some.groupBy("print", "salt").agg(F.count("*").alias("n")), ["print"], pairs.select("print").distinct())
    some = some.join(wanted, ["print", "salt"], "left_semi").groupBy("print", "spots").agg(F.count("*").alias("rows"))

    # spots are 12 hexadecimal digits
    whole = F.transform("spots", lambda x: F.conv(x, 16, 10).cast("long")).alias("spots")
    cells = lambda rows: rows.groupBy("family").agg(F.ceil(F.sum(F.size("spots")) / IN_CELL).cast("int").alias("cells"))
    cell = lambda by: F.pmod(F.xxhash64(by), F.col("cells")).cast("int")
    ys = durable(pairs.join(some, "print").select("family", "print", whole, "rows", salt("print")))
    shards = durable(cells(ys))
    told = told_of(ys.groupBy("family", "salt").agg(F.count("*").alias("n")), ["family"], shards)
    ys = ys.join(told, ["family", "salt"]).groupBy("family", cell("print").alias("shard")).agg(F.collect_list(F.struct("spots", "rows")).alias("ys"))
    qs = durable(asked.join(family, "q").select("family", "fingerprint", whole))
    qs = qs.join(cells(qs), "family").groupBy("family", cell("fingerprint").alias("block")).agg(F.collect_list(F.struct("fingerprint", "spots")).alias("qs"))
    qs = qs.join(shards, "family").select("family", "qs", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("shard"))

    def near(q: Column) -> Column:
        n = F.size(q["spots"])
        able = F.filter("ys", lambda y: F.least(n, F.size(y["spots"])) >= F.greatest(n, F.size(y["spots"])) * similarity - 1e-9)
        both = F.transform(able, lambda y: F.struct(y["rows"].alias("rows"), F.size(y["spots"]).alias("n"), F.size(F.array_intersect(q["spots"], y["spots"])).alias("both")))
        return F.aggregate(both, F.lit(0).cast("long"), lambda sum_, y: sum_ + F.when(y["both"] / (n + y["n"] - y["both"]) >= similarity, y["rows"]).otherwise(0))

    counts = qs.join(ys, ["family", "shard"]).select(F.explode(F.transform("qs", lambda q: F.struct(q["fingerprint"].alias("fingerprint"), near(q).alias("rows")))).alias("x"))
    return counts.groupBy("x.fingerprint").agg((F.sum("x.rows") - 1).alias("n_near"))


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, likeness) of classes of equal fingerprints, by their least doc_id, whose likeness is similarity or more.

    Sets are partitioned by length so that only equal or neighbouring partitions can hold such a pair; there, pairs are made
    where a set of the one has a spot that is among the rarest of the other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter("doc_id is not null")
    # written before it is filtered: a filter would be pushed below, and make the spots again and again
    sets = durable(fingerprint(rows, "text", "spots").select("doc_id", "spots")).filter(F.size("spots") > 0)
    sets = durable(sets.groupBy("spots").agg(F.min("doc_id").alias("doc_id")))
    keys = durable(prefix(sets, "doc_id", similarity).withColumn("part", part("n", similarity)))
    one = keys.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "part", "spot")
    two = keys.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "spot")
    able = (F.col("nb") * similarity <= F.col("na")) & (F.col("na") <= F.col("nb")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = one.join(two, ["spot", "part"]).filter(able).select("a", "b").distinct()
    whole = lambda c, d: sets.select(F.col("doc_id").alias(c), F.col("spots").alias(d))
    found = pairs.join(whole("a", "x"), "a").join(whole("b", "y"), "b").withColumn("likeness", likeness("x", "y"))
    return found.filter(F.col("likeness") >= similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def _sql_marked(text: str) -> str:
    low = f"translate(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{OPEN}{CLOSE}', '')"
    inner = f"('{OPEN}' || regexp_replace({low}, '{APART}', '{CLOSE}{OPEN}', 'g') || '{CLOSE}')"
    return f"regexp_replace({inner}, '{OPEN}({'|'.join(sorted(set(COMMON)))}){CLOSE}', chr(1) || '\\1' || chr(2), 'g')"


SQL = f"""
with base as (select doc_id, coalesce(text, '') t from documents),
nexts as (select doc_id, t, coalesce(lead(t) over (order by doc_id), (select t from base order by doc_id limit 1)) nt from base),
texts as (select doc_id, t, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) e from nexts),
long as (select doc_id, 0 which, t x from texts union all select doc_id, 1, e from texts),
marks as (select doc_id, which, x, {_sql_marked("x")} m from long),
toks as (select *, list_filter(string_split(m, '{CLOSE}'), lambda s: contains(s, '{OPEN}') and not suffix(s, '{OPEN}')) tok from marks),
cons as (select *, list_transform(tok, lambda s: string_split(s, '{OPEN}')[-1]) con from toks),
spots as (select doc_id, which, x, m, list_sort(list_distinct(list_filter(list_transform(tok, lambda s, i: case when starts_with(s, chr(1)) and i + {CHAIN - 1} <= len(con)
  then substr(md5(string_split(string_split(s, chr(1))[-1], chr(2))[1] || ' ' || con[i] || ' ' || con[i + 1]), 1, 12) end), lambda s: s is not null))) sp from cons),
prints as (select doc_id, which, x, case when len(sp) > 0 then sp when regexp_matches(x, '{APART.replace("[", "[^").removesuffix("+")}') then [substr(md5(m), 1, 12)] else [] end fp from spots),
pairs as (select a.doc_id, a.x t, b.x e, a.fp f, b.fp g,
  coalesce(lead(a.fp) over (order by a.doc_id), (select fp from prints where which = 0 order by doc_id limit 1)) h
  from prints a join prints b on a.doc_id = b.doc_id and a.which = 0 and b.which = 1),
near as (select q.doc_id, count(*) - 1 n from pairs q join pairs o on q.doc_id % {ASKED} = 0 and len(q.f) > 0 and len(o.f) > 0
  and len(list_intersect(q.f, o.f))::double / (len(q.f) + len(o.f) - len(list_intersect(q.f, o.f))) >= {SIMILARITY} group by 1)
select doc_id, length(t)::bigint n_chars, sha256(e) edited_sha256, array_to_string(f, ' ') fingerprint, array_to_string(g, ' ') edited_fingerprint,
  case when len(f) = 0 and len(g) = 0 then 1.0::double else len(list_intersect(f, g))::double / (len(f) + len(g) - len(list_intersect(f, g))) end near_edited,
  case when len(f) = 0 and len(h) = 0 then 1.0::double else len(list_intersect(f, h))::double / (len(f) + len(h) - len(list_intersect(f, h))) end near_next,
  case when doc_id % {ASKED} = 0 then coalesce(n, 0)::bigint end n_near
from pairs left join near using (doc_id)
"""
