"""Fill-in-the-middle: texts are cut at two places between units and their parts exchanged, by escaped marker injection.

A unit is a run of Latin letters or any other single character. A separator is put after every unit, so counting separators
counts units and substring_index gives any run of them. A text that holds the separator itself is escaped before and unescaped
after: no text is too odd to be cut, and nothing but built-in functions runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import text_of

#: stands after each unit; and what stands for itself and for the separator in a text that holds them
AFTER, ESCAPE = "\x1f", "\x1e"
ESCAPED = {ESCAPE: ESCAPE + "0", AFTER: ESCAPE + "1"}
#: An escaped character is one unit, as the character was.
UNIT = f"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many stay as they are; of a hundred of the others so many have the suffix in front.
PLAIN, SUFFIX_FIRST = 10, 20
#: told before the id, so that another seed cuts elsewhere
SEED = "1"


def escaped(text: Column) -> Column:
    """The text without the separator."""
    for plain, code in ESCAPED.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def restored(part: Column) -> Column:
    """What a run of units was in the text."""
    part = F.replace(part, F.lit(AFTER), F.lit(""))
    for plain, code in reversed(ESCAPED.items()):
        part = F.replace(part, F.lit(code), F.lit(plain))
    return part


def drawn(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 that only the seed and the id decide."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), doc_id.cast("string")).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def cut(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix and the output of every row of docs.

    form is plain (output is the text, parts are null), psm or spm. Plain are empty and null texts, texts that hold a marker, and a
    drawn share. A null doc_id is drawn as an empty one; repeated rows are cut alike; a text of one unit has two empty parts at least;
    columns other than doc_id and text are not read; no rows give no rows. Texts stay in their rows: nothing is shuffled.
    """
    h1, h2, h3, h4 = drawn(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    text, units = F.col("text"), F.col("units")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.select("doc_id", "text", h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"), escaped(text).alias("whole"))
    rows = rows.withColumn("units", F.regexp_replace("whole", UNIT, f"$0{AFTER}"))
    rows = rows.withColumn("n", (F.length(units) - F.length("whole")).cast("long"))  # the separators
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(marker)
    form = F.when((text == "") | marked | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    rows = rows.select("doc_id", "text", "n", "units", form.alias("form"), F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))
    pieces = lambda of, k: F.call_function("substring_index", of, F.lit(AFTER), k.cast("int"))
    # the separator after the last unit leaves an empty piece behind it, so the last k units are k + 1 pieces from the end
    ranked = {
        "prefix": pieces(units, F.col("first")),
        "middle": pieces(pieces(units, F.col("second")), F.col("first") - F.col("second")),
        "suffix": pieces(units, F.col("second") - F.col("n") - 1),
    }
    rows = rows.select("doc_id", "text", "n", "form", *[F.when(F.col("form") != "plain", restored(part)).alias(name) for name, part in ranked.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def rebuilt(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of. A text with a marker is never cut, so each marker of an output stands once."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    left, right = (lambda a: F.substring_index(rest, a, 1)), (lambda a: F.substring_index(rest, a, -1))
    psm = F.concat(F.substring_index(left(SUFFIX), PREFIX, -1), middle, right(SUFFIX))
    spm = F.concat(right(PREFIX), middle, F.substring_index(left(PREFIX), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(cuts: DataFrame) -> DataFrame:
    """The rows of cut() without their texts: lengths in code points, and digests of the output and of the text rebuilt from it."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return cuts.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"),
        sha(rebuilt(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
with texts as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents
), units as (
  select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as u,
    cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2,
    cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4
  from texts
), places as (
  select doc_id, text, u, cast(len(u) as bigint) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
         when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from units
), parts as (
  select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from places
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from parts
"""
