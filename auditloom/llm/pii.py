"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions only.

The valid base entities are seeds, and so are tokens in a published format of secret keys. The two words before an entity are a
lexical pattern, and the two words after it another. Patterns and instances (seeds and identifier-like tokens alike) form a graph.
A pattern's score is the mean of its instances' scores, and each ordinary word that stands in the pattern's place counts as an
instance of score 0. A token's score is the mean of a prior and of what its patterns say, which is their score if they are trusted and
nothing if not; seeds stay at 1. What an instance and a pattern tell each other leaves out what they were told by one another, so
neither vouches for itself. A pattern is trusted with a high score and enough different instances that are seeds or, in later
rounds, are vouched for by other patterns: so each round's instances are seeds of new patterns. After the last round, the
identifier-like tokens that stand in a trusted pattern are found too, as kind "id".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import GAP, durable, lower_ascii, text_of

#: kinds of the base patterns in the order in which spans of one start are listed
KINDS = ("email", "ip", "card", "phone")
NEW = "id"
LOCAL = r"A-Za-z0-9._%+-"
#: Possessive groups run in a loop instead of recursion, and the look-behind tries each run of local-part characters once.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Identifier-like: six characters or more, with a digit, or an underscore or capital letter inside.
TOKEN = r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*+[0-9]|[A-Za-z/-]++_|[A-Za-z]*?[a-z][A-Z])[A-Za-z0-9_/-]{6,}+"
# FIXED VALUES: published formats of keys: long hexadecimal digests with a digit and a letter, access keys of three services, signed tokens
STRONG = r"^(?:(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{24,}|eyJ[0-9A-Za-z_-]{20,})$"
#: rounds of scoring; a pattern is trusted from this score, and from this many different seeds
ROUNDS, SCORE, SEEDS = 4, 0.5, 3
#: In this part of the documents the ordinary words of patterns are counted first.
PART = 1 / 32
#: score of a token of which nothing is known
PRIOR = 1 / 3


#: characters on either side of an entity that are looked at, and code points in a block of a text
NEAR, BLOCK = 80, 1000
BEFORE, AFTER = "<", ">"


def with_running(rows: DataFrame, values: str, name: str, zero: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds the array of what the values up to each come to by step.

    Arrays are built in blocks of about the square root of their size, as each append copies what is there. What a lambda uses
    more than once is a column first, read twice, so that it is made once a row.
    """
    blocks, sums, before = (f"{name}_{x}" for x in ("blocks", "sums", "before"))
    size = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    rows = rows.withColumn(blocks, F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))))
    rows = rows.withColumn(sums, F.when(F.size(blocks) > 0, F.transform(blocks, lambda x: F.aggregate(x, zero, lambda acc, y: step(acc, y)))))
    listed_ = lambda one, first: F.aggregate(one, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], step(acc["at"], x)).alias("out")), lambda acc: acc["out"])
    again = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    rows = rows.withColumn(before, F.when(F.size(sums) > 0, F.aggregate(sums, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), again, lambda acc: acc["out"])))
    rows = rows.withColumn(name, F.when(F.size(before) > 0, F.flatten(F.transform(blocks, lambda x, b: listed_(x, F.get(before, b))))).otherwise(F.array().cast("array<int>")))
    return rows.drop(blocks, sums, before)


def words_in(text: Column) -> Column:
    """Words of a context: lower case, digits as 0."""
    return F.array_remove(F.split(F.regexp_replace(lower_ascii(text), r"[0-9]", "0"), GAP), "")


def located(rows: DataFrame, text: str, pattern: str, name: str, need: str | None = None) -> DataFrame:
    """Adds the leftmost non-overlapping matches as array<struct<start,end,match,patterns>>; patterns: the two words on either side.

    What lies between the matches and the matches themselves are columns first, so that they are made once a row.
    """
    may = F.col(text).rlike(r"[0-9]") if need is None else F.col(text).contains(need)
    rows = rows.withColumn("matches", F.when(may, F.regexp_extract_all(text, F.lit(pattern), 0)))
    rows = rows.withColumn("gaps", F.when(F.size("matches") > 0, F.split(text, pattern, -1)))
    rows = rows.withColumn("lengths", F.when(F.size("gaps") > 0, F.transform("matches", lambda m, i: F.length(F.get("gaps", i)) + F.length(m))))
    rows = with_running(rows, "lengths", "ends", F.lit(0), lambda acc, x: acc + x)

    def told(m: Column, i: Column) -> Column:
        before = words_in(F.regexp_replace(F.right(F.concat_ws("", F.get("matches", i - 1), F.get("gaps", i)), F.lit(NEAR)), r"[\x22'(\[<]+$", ""))
        after = words_in(F.regexp_replace(F.left(F.concat_ws("", F.get("gaps", i + 1), F.get("matches", i + 1)), F.lit(NEAR)), r"^[\x22')\]>]+", ""))
        left = F.when(F.size(before) > 1, F.concat(F.lit(BEFORE), F.array_join(F.slice(before, F.size(before) - 1, 2), " ")))
        right = F.when(F.size(after) > 1, F.concat(F.lit(AFTER), F.array_join(F.slice(after, 1, 2), " ")))
        end = F.get("ends", i)
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"), F.array_compact(F.array(left, right)).alias("patterns"))

    empty = F.array().cast("array<struct<start:int,end:int,match:string,patterns:array<string>>>")
    return rows.withColumn(name, F.when(F.size("gaps") > 0, F.transform("matches", told)).otherwise(empty)).drop("matches", "gaps", "lengths", "ends")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.try_cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def apart(rows: DataFrame, tokens: str, spans: str) -> DataFrame:
    """rows whose tokens (sorted) are those that overlap none of the spans (sorted, possibly overlapping)."""
    place = lambda column, is_span: F.transform(column, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(is_span).alias("is_span"), i.alias("i")))
    rows = rows.withColumn("all_", F.when(F.size(tokens) > 0, F.sort_array(F.concat(place(spans, 1), place(tokens, 0)))))
    rows = rows.withColumn("all_ends", F.when(F.size("all_") > 0, F.transform("all_", lambda x: F.when(x["is_span"] == 1, x["end"]).otherwise(0))))
    rows = rows.withColumn("all_starts", F.when(F.size("all_") > 0, F.transform(F.reverse("all_"), lambda x: F.when(x["is_span"] == 1, x["start"]).otherwise(2**31 - 1))))
    rows = with_running(rows, "all_ends", "reached", F.lit(0), F.greatest)
    rows = with_running(rows, "all_starts", "ahead", F.lit(2**31 - 1), F.least)
    free = F.transform("all_", lambda x, k: F.when((x["is_span"] == 0) & (F.get("reached", k) <= x["start"]) & (F.get("ahead", F.size("ahead") - 1 - k) >= x["end"]), x["i"]))
    rows = rows.withColumn("free", F.when(F.size("all_") > 0, F.array_compact(free)).otherwise(F.array().cast("array<int>")))
    return rows.withColumn(tokens, F.transform("free", lambda i: F.get(tokens, i))).drop("all_", "all_ends", "all_starts", "reached", "ahead", "free")


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, digest, base (spans with kind and order) and tokens (identifier-like, outside base spans) of each row.

    Written once to the shared folder: everything after it but the count of ordinary words reads these short arrays and no text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    for kind in KINDS:
        rows = located(rows, "text", PATTERNS[kind], f"found_{kind}", NEEDS[kind])
    told = lambda kind, no: F.transform(
        F.filter(f"found_{kind}", lambda x: valid(kind, x["match"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"), x["patterns"].alias("patterns")),
    )
    rows = rows.withColumn("base", F.sort_array(F.concat(*[told(k, n) for n, k in enumerate(KINDS)])))
    rows = apart(located(rows, "text", TOKEN, "tokens", ""), "tokens", "base")
    return durable(rows.select("doc_id", F.xxhash64("text").alias("digest"), "base", "tokens"))


def ordinary_words(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern and others, the number of different words that are not identifier-like and stand in the pattern's place, for those
    that have any.

    The words of all texts meet the patterns by a hash; Spark broadcasts these if they are few.
    """
    rows = docs.select(F.regexp_replace(text_of(), r"[0-9]", "0").alias("text"))
    rows = rows.select(F.array_remove(F.split("text", GAP), "").alias("words"), words_in(F.col("text")).alias("low"))
    key = lambda side, i: F.xxhash64(F.lit(side), F.get("low", i), F.get("low", i + 1))
    both = F.flatten(F.transform("words", lambda w, i: F.array(F.struct(w.alias("word"), F.when(i > 1, key(BEFORE, i - 2)).alias("key")), F.struct(w.alias("word"), key(AFTER, i + 1).alias("key")))))
    each = rows.select(F.explode(both).alias("x")).select("x.*").filter(~F.col("word").rlike("[0-9@_]|[a-z][A-Z]"))
    known = patterns.select("pattern", F.split(F.substring("pattern", 2, 1_000_000), " ").alias("w"))
    known = durable(known.select("pattern", F.xxhash64(F.substring("pattern", 1, 1), F.get("w", 0), F.get("w", 1)).alias("key")))
    return each.join(known, "key").select("pattern", "word").distinct().groupBy("pattern").agg(F.count("*").alias("others"))


def possible(edges: DataFrame, others: DataFrame | None, rounds: int, score: float, seeds: int, prior: float) -> DataFrame:
    """The patterns of edges (pattern, instance, seed) that could be trusted, or believed in some round, if all went well for them.

    An instance is known by more than the prior only if it is a seed or another pattern is believed. So, round by round, the instances
    of patterns that could be believed could be vouched for, and a pattern needs enough of these, and of all its instances and ordinary
    words (others, or as many as are known yet) such a share that their mean could reach the score without its worst instance.
    What is left out tells nothing in any round.
    """
    hoped = edges.filter("seed = 1").select("instance").distinct()
    found, before = None, -1
    for _ in range(rounds + 1):
        # with a prior that high every instance counts from the start
        marked = edges.join(hoped.withColumn("hope", F.lit(1)), "instance", "left") if prior < score else edges.withColumn("hope", F.lit(1))
        sums = marked.groupBy("pattern").agg(F.count("*").alias("n"), F.count("hope").alias("hopes"))
        sums = sums if others is None else sums.join(others, "pattern", "left")
        more = F.lit(0) if others is None else F.coalesce("others", F.lit(0))
        reached = F.col("hopes") + prior * (F.col("n") - F.col("hopes")) >= score * (F.col("n") + more - 1) - 1e-6
        found = durable(sums.filter((F.col("hopes") >= seeds) & reached).select("pattern"))
        now = found.count()
        if now == before:  # the patterns only become more
            break
        before = now
        hoped = durable(edges.join(found, "pattern", "left_semi").select("instance").unionByName(edges.filter("seed = 1").select("instance")).distinct())
    return found


def trusted(docs: DataFrame, found: DataFrame, rounds: int = ROUNDS, score: float = SCORE, seeds: int = SEEDS, prior: float = PRIOR, part: float = PART) -> DataFrame:
    """The patterns that are trusted after the rounds of scoring.

    Equal pairs of pattern and instance count once, so copies of a document add nothing. Only patterns of enough different
    instances take part: another can't be trusted, and tells nothing of its instances.

    Ordinary words are counted for the patterns that could be trusted without any; of these, in a part of the documents first: most
    have too many even there, and only the others meet all texts. Neither changes the result.
    """
    pairs = lambda c, seed: found.select(F.explode(c).alias("x")).select(F.explode("x.patterns").alias("pattern"), lower_ascii(F.col("x.match")).alias("instance"), seed.cast("int").alias("seed"))
    both = pairs("base", F.lit(1)).unionByName(pairs("tokens", F.col("x.match").rlike(STRONG)))
    edges = durable(both.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    # an instance is a seed wherever it stands
    sure = edges.filter("seed = 1").select("instance").distinct().withColumn("sure", F.lit(1))
    able = durable(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= seeds).select("pattern"))
    edges = edges.join(able, "pattern").join(sure, "instance", "left").select("pattern", "instance", F.coalesce("sure", F.lit(0)).alias("seed"))
    # how many patterns an instance stands in, those that tell nothing among them
    edges = durable(edges)
    stands = edges.groupBy("instance").agg(F.count("*").alias("patterns"))
    hopeful = possible(edges, None, rounds, score, seeds, prior)
    some = F.pmod(F.xxhash64(text_of()), F.lit(2**20)) < int(part * 2**20)
    hopeful = durable(possible(edges.join(hopeful, "pattern", "left_semi"), durable(ordinary_words(docs.filter(some), hopeful)), rounds, score, seeds, prior))
    words = durable(ordinary_words(docs, hopeful))
    edges = edges.join(hopeful, "pattern", "left_semi").join(stands, "instance")
    enough = lambda c: c >= score - 1e-9
    # known: what the instance tells the pattern, without what this pattern told it
    edges = durable(edges.withColumn("known", F.when(F.col("seed") == 1, 1.0).otherwise(prior)))

    def scored(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("pattern").agg(F.sum("known").alias("total"), F.count("*").alias("n"), F.sum(enough(F.col("known")).cast("int")).alias("support"))
        return sums.join(words, "pattern", "left").select("pattern", "total", (F.col("n") + F.coalesce("others", F.lit(0))).alias("n"), "support")

    for _ in range(rounds):
        rest = (F.col("total") - F.col("known")) / F.nullif(F.col("n") - 1, F.lit(0))
        vouched = F.col("support") - enough(F.col("known")).cast("int")
        told = F.when(enough(rest) & (vouched >= seeds), rest).otherwise(0.0)
        each = edges.join(scored(edges), "pattern").select("pattern", "instance", "seed", "patterns", told.alias("told"))
        instances = each.groupBy("instance").agg(F.sum("told").alias("all_told"))
        known = (prior + F.col("all_told") - F.col("told")) / F.col("patterns")
        edges = durable(each.join(instances, "instance").select("pattern", "instance", "seed", "patterns", F.when(F.col("seed") == 1, 1.0).otherwise(known).alias("known")))
    return scored(edges).filter(enough(F.col("total") / F.col("n")) & (F.col("support") >= seeds)).select("pattern")


def discovered(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, digest and the new spans of the documents that have any."""
    each = found.select("doc_id", "digest", F.explode("tokens").alias("x")).select("doc_id", "digest", "x", F.explode("x.patterns").alias("pattern"))
    span = F.struct(F.col("x.start").alias("start"), F.lit(len(KINDS)).alias("no"), F.col("x.end").alias("end"), F.lit(NEW).alias("kind"))
    return each.join(patterns, "pattern").groupBy("doc_id", "digest").agg(F.collect_set(span).alias("new"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def all_spans(docs: DataFrame, **tuning: float) -> DataFrame:
    """doc_id, digest, base and spans (start, no, end, kind; sorted) of each row."""
    found = findings(docs)
    new = discovered(found, durable(trusted(docs, found, **tuning))).withColumnsRenamed({"doc_id": "new_id", "digest": "new_digest"})
    by = F.col("doc_id").eqNullSafe(F.col("new_id")) & (F.col("digest") == F.col("new_digest"))
    rows = found.drop("tokens").join(new, by, "left")
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["no"].alias("no"), x["end"].alias("end"), x["kind"].alias("kind")))
    return rows.select("doc_id", "digest", plain.alias("base"), F.sort_array(F.concat(plain, F.coalesce("new", F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")))).alias("spans"))


def find_pii(docs: DataFrame, **tuning: float) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans, of each row.

    A null text is empty (no spans); a null doc_id stays null; repeated rows get the same spans each and add no evidence; other
    columns are not read; no rows give no rows.
    """
    count = lambda no: F.size(F.filter("base", lambda x: x["no"] == no)).cast("long")
    return all_spans(docs, **tuning).select(
        "doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def cut(blocks: str, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in blocks."""
    a, b = (F.floor(x / BLOCK).cast("int") for x in (start, end))
    inside = F.substring(F.get(blocks, a), start % BLOCK + 1, end - start)
    across = F.concat(F.substring(F.get(blocks, a), start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(blocks, b), F.lit(1), end % BLOCK), F.lit("")))
    return F.when(start >= end, "").when(a == b, inside).otherwise(across)


def redact(docs: DataFrame, **tuning: float) -> DataFrame:
    """docs, in its own columns, with every span of text replaced by its kind in brackets; all rows are kept.

    Where spans overlap, the first one's kind stands for all that they cover.
    """
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("key"), text_of().alias("body")).withColumn("sum", F.xxhash64("body"))
    found = all_spans(docs, **tuning).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", "spans")
    found = found.withColumn("span_ends", F.transform("spans", lambda x: x["end"]))
    found = with_running(found, "span_ends", "reached", F.lit(0), F.greatest)
    rows = rows.join(found, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("sum") == F.col("digest")), "left")
    rows = rows.withColumn("blocks", F.when(F.size("spans") > 0, F.regexp_extract_all("body", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    # what all spans before this one reach
    past = lambda i: F.coalesce(F.get("reached", i - 1), F.lit(0))
    part = lambda x, i: F.when(x["start"] >= past(i), F.concat(cut("blocks", past(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
    last = cut("blocks", F.get("reached", F.size("reached") - 1), F.length("body"))
    text = F.when(F.size("blocks") > 0, F.concat(F.array_join(F.transform("spans", part), ""), last)).otherwise(F.col("row.text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
