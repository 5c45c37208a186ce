"""Every operator over rows that are hard on purpose, over an empty table, and with columns that clash with its own."""

from __future__ import annotations

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditloom.llm import common, html_extract, licences, mixing, neardup, packing, pii, quality, spotsigs, substrings, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "the cat sat on a mat near 10.0.0.1 and a@b.co " * 4000
ROWS = [
    (1, "plain words in a short text of ten words or more", "en", "a"),
    (1, "plain words in a short text of ten words or more", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "de", "b"),
    (None, "a text without an id but with a@b.co in it", "en", "a"),
    (6, LONG, "en", "b"),
    (7, LONG, "en", "b"),
    (8, "x" * 200_000, "fr", "c"),
    (9, "☃ \u0000 é́ 🙂 <|endoftext|> </s> \u0085", "fr", "c"),
    (-5, "the\n" * 3000, "es", "c"),
    (2**62, "1" * 5000 + "." * 5000, "es", "c"),
]
CLASHING = "digest words n bands kept component component_id spans row key a b sum found lines text_ ord bucket guard start end licence weight probability tokens h g doc p cleaned".split()
OPERATORS = {
    "op1": lambda d: licences.scan(d, licences.registry(d.sparkSession, licences.LICENCES), licences.registry(d.sparkSession, licences.NOTICES)),
    "op3": mixing.mix,
    "op4": lambda d: packing.pack(d, BPE),
    "op5": lambda d: token_counts.count_tokens(d, PIECES),
    "op6": neardup.near_duplicates,
    "op7": spotsigs.edited_fingerprints,
    "op8": substrings.remove_repeats,
    "op9": quality.quality,
    "op10": pii.find_pii,
}
KEEPERS = {"quality": quality.keep_good, "near": neardup.keep_one, "pii": pii.redact, "mix": mixing.sample}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_hard_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name == "op4":
        total = {}
        for r in rows:
            total.setdefault(r.doc_id, []).append(r)
        assert set(total) == {r[0] for r in ROWS}
        assert sum(r.length for r in rows if r.doc_id == 2) == 1
    else:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.filter("false")).count() == 0


@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_stages_keep_columns(docs, name):
    kept = KEEPERS[name](docs)
    assert kept.columns == docs.columns
    assert kept.select("doc_id", "text", "digest").count() <= len(ROWS)
    assert KEEPERS[name](docs.filter("false")).count() == 0


def test_written_tables_can_be_dropped(spark):
    table = common.durable(spark.range(3))
    assert table.count() == 3 and common.WRITTEN
    folder = common.WRITTEN[-1]
    common.drop_tables(spark)
    assert not common.WRITTEN and not os.path.exists(folder)


def test_pages(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (3, "u", "<article><p>One &amp; two"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "&am"), (6, "u", "<" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    got = html_extract.extract(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r.text for r in got if r.page_id == 3} == {"One & two"} and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages.filter("false")).count() == 0
