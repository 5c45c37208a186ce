"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one document: too few words, or too many of its words in 5-word windows that the text repeats. The
method's rule looks across documents: lines are normalised and hashed, the documents of a host that hold each line are
counted, lines above the host's limit are removed, and a document whose removal leaves too little is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import durable, lower_ascii, text_of, words_of

#: words in a window of the repetition rule
WINDOW = 5
#: A line is boilerplate of its host above this share of the host's documents, and above this many of them.
SHARE, LEAST = 0.10, 10
#: Whatever the host's size, so is a line of so many words above this number of documents.
MOST, LONG = 1000, 6
#: A document is depleted if less than this share of its words is left.
LEFT = 0.30
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: characters that count as symbols
SYMBOLS = "#*$%&|<>"


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def normal_line(line: Column) -> Column:
    """Case, digits and white space don't tell lines apart."""
    return F.trim(F.regexp_replace(F.translate(lower_ascii(line), "123456789", "000000000"), r"[\x20\x09-\x0D]+", " "))


def base_figures(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with text."""
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    window = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)])
    rows = rows.withColumn("windows", F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), window)))
    again = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    rows = rows.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: x["h"].eqNullSafe(F.get(F.col("sorted"), j - 1)["h"]) | x["h"].eqNullSafe(F.get(F.col("sorted"), j + 1)["h"])
    rows = rows.withColumn("at", F.sort_array(F.transform(F.filter("sorted", same), lambda x: x["i"])))
    step = lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1) - p, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("at", step), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("lines", lines_with_words(F.col("text")))
    return rows.withColumns(
        {
            "n_words": F.col("n").cast("long"),
            "word_chars": F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per row: doc_id, host, a hash of the text, its lines as (hash, words), and the base figures.

    Written once to the shared folder; the counts across documents then read it and no text.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        text_of().alias("text"),
    )
    line = lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words_of(x)).alias("n"))
    rows = base_figures(rows).withColumns({"digest": F.xxhash64("text"), "hashes": F.transform("lines", line)})
    return durable(rows.select("doc_id", "host", "digest", "hashes", *FIGURES))


def boilerplate(rows: DataFrame, share: float = SHARE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(host, h) of the lines that more documents of their host hold than either limit allows; every row is a document."""
    each = rows.select("host", F.explode(F.array_distinct("hashes")).alias("x")).select("host", "x.h", F.col("x.n").alias("words"))
    counts = each.groupBy("host", "h", "words").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    hosts = rows.groupBy("host").agg(F.count("*").alias("documents"))
    high = (F.col("n") > share * F.col("documents")) | ((F.col("n") > most) & (F.col("words") >= LONG))
    return counts.join(hosts, "host").filter(high).select("host", "h")


def lines_to_remove(rows: DataFrame, share: float = SHARE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, host, digest and the hashes of the lines to remove, of the documents that have any."""
    high = boilerplate(rows, share, least, most)
    each = rows.select("doc_id", "host", "digest", F.explode(F.array_distinct(F.col("hashes.h"))).alias("h"))
    return each.join(high, ["host", "h"]).groupBy("doc_id", "host", "digest").agg(F.collect_set("h").alias("remove"))


def judged(rows: DataFrame, remove: DataFrame, left: float = LEFT) -> DataFrame:
    """rows (with hashes and base figures) and whether each is kept."""
    remove = remove.withColumnsRenamed({c: f"of_{c}" for c in ("doc_id", "host", "digest")})
    same = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("host") == F.col("of_host")) & (F.col("digest") == F.col("of_digest"))
    gone = F.aggregate(F.filter("hashes", lambda x: F.array_contains("remove", x["h"])), F.lit(0), lambda a, x: a + x["n"])
    joined = rows.join(remove, same, "left")
    spent = F.col("remove").isNotNull() & (F.col("n_words") - F.coalesce(gone, F.lit(0)) < left * F.col("n_words"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~spent)


def quality(docs: DataFrame, host: str = "source", share: float = SHARE, least: int = LEAST, left: float = LEFT, most: int = MOST) -> DataFrame:
    """The figures and the verdict of each row; no text is shuffled.

    A null text is empty (no words: base_failed); a null host is a host of its own; a null doc_id stays null; repeated rows
    get the same figures each, and each is a document of its host; other columns are not read; no rows give no rows.
    """
    rows = figures(docs, host)
    return judged(rows, lines_to_remove(rows, share, least, most), left).select("doc_id", *FIGURES, "kept")


def keep_good(docs: DataFrame, host: str = "source", share: float = SHARE, least: int = LEAST, left: float = LEFT, most: int = MOST) -> DataFrame:
    """The rows of docs that are kept, in docs' columns, without the lines above their host's limit."""
    names, rows = docs.columns, figures(docs, host)
    kept = judged(rows, lines_to_remove(rows, share, least, most), left).filter("kept").select("doc_id", "digest", "remove").dropDuplicates(["doc_id", "digest"])
    whole = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(text_of()).alias("sum"))
    both = whole.join(kept, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("sum") == F.col("digest")))
    lines = F.filter(F.split(F.col("row.text"), "\n"), lambda x: ~F.array_contains("remove", F.xxhash64(normal_line(x))))
    text = F.when(F.col("remove").isNull(), F.col("row.text")).otherwise(F.array_join(lines, "\n"))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


#: DuckDB SQL for quality() over documents
SQL = rf"""
with base as (
  select doc_id, coalesce(source, '') host, coalesce(text, '') t from documents),
w as (select doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls from base),
wins as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') k
  from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i from w where len(ws) >= {WINDOW})),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) n from wins) where n > 1),
rep as (select doc_id, count(distinct p) n_repeat_words from (select doc_id, unnest(range(i, i + {WINDOW})) p from again) group by 1),
norm as (select doc_id, host, t, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) n,
  trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') l
  from (select doc_id, host, t, unnest(ls) l from w)),
hosts as (select host, count(*) documents from base group by 1),
high as (select host, l from (select host, l, n words, count(distinct doc_id) n from norm group by 1, 2, 3) join hosts using (host)
  where n > {LEAST} and (n > {SHARE} * documents or (n > {MOST} and words >= {LONG}))),
gone as (select doc_id, sum(n) gone from norm join high using (host, l) group by 1)
select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words,
  len(ws) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(ws) base_failed,
  not (len(ws) < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * len(ws)) and not (gone is not null and len(ws) - gone < {LEFT} * len(ws)) kept
from w left join rep using (doc_id) left join gone using (doc_id)
"""
