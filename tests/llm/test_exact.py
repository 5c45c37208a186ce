"""Operators that SQL can't express, against brute force; and those with SQL, against it."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import corpus_pipeline
from auditloom.llm import html_extract, html_training, licences, mixing, neardup, packing, pii, quality, queries, spotsigs, substrings, token_counts
from auditloom.llm import suffix_runs as R
from auditloom.llm.html_nodes import decode, features

FOLDER = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    df = queries.queries()[name](spark, FOLDER)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in place)) for r in want.fetchall())


def test_packing_gives_the_tokenizers_ids_back(docs, texts):
    exact = Tokenizer.from_file(BPE)
    rows = packing.pack(docs, BPE, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_doc: dict[int, list] = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and r.bucket == r.length.bit_length() - 1
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        ids = [i for r in parts for i in r.ids]
        assert ids == [*exact.encode(text, add_special_tokens=False).ids, 0] and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]


def test_token_counts_are_the_librarys(docs, texts):
    library = SentencePieceProcessor(model_file=PIECES)
    for r in token_counts.count_tokens(docs, PIECES).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


@pytest.mark.parametrize("text", ["", " ", "  a", "\n", "a\n b", "▁▁x ▁", "<s>x</s>", "日本語テキスト", "a" * 3000, " " * 500 + "x", "\tc\x00é́ﬁ①"])
def test_token_counts_of_odd_texts(text):
    assert token_counts.counter(PIECES).count(text) == len(SentencePieceProcessor(model_file=PIECES).encode(text))


def components(sets: dict[int, set], percent: int) -> dict[int, int]:
    top = {i: i for i in sets}

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    where: dict = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        seen = Counter(j for g in s for j in where[g] if j > i)
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def shingles(text: str, size: int) -> set:
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def test_near_duplicates_lose_no_link(docs, texts):
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    want = components(sets, 85)
    for r in neardup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_in_a_large_group_around_the_threshold(spark):
    r = random.Random(3)
    lexicon, rows = [f"w{i}" for i in range(3000)], []
    for g in range(2):
        base = [r.choice(lexicon) for _ in range(70 + 40 * g)]
        for _ in range(100):
            words = list(base)
            for _ in range(r.randint(0, len(words) // 12)):
                k, x = r.randrange(len(words)), r.random()
                if x < 0.5:
                    words[k] = r.choice(lexicon[:40])
                elif x < 0.75:
                    del words[k]
                else:
                    words.insert(k, r.choice(lexicon[:40]))
            rows.append((len(rows) * 7 % 5003, " ".join(words)))
    want = components({i: shingles(t, 3) for i, t in rows}, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_similarity_of_sketches_is_that_of_sets():
    r = random.Random(1)
    one = [r.getrandbits(64) for _ in range(1000)]
    for share in (0.2, 0.5, 0.85):
        n = int(1000 * 2 * share / (1 + share))
        two = one[:n] + [r.getrandbits(64) for _ in range(1000 - n)]
        a, b = neardup.sketch([np.array(sorted(x), np.uint64) for x in (one, two)], 2000)
        assert abs((a == b).mean() - share) < 0.05
    assert (neardup.sketch([np.array([5], np.uint64)], 64) != 2**64 - 1).all()


def brute_repeats(texts: dict[int, str], length: int = 100) -> dict[int, tuple]:
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        text = texts[i].encode()
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            window = text[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, x in zip(text, gone, strict=True) if not x)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [250_000, 400])
def test_repeats_are_removed_to_the_byte(spark, docs, texts, bucket, monkeypatch):
    monkeypatch.setattr(substrings, "IN_BUCKET", bucket)
    more = {10_000: "é" * 60, 10_001: "x" * 3000, 10_002: "ab" * 300 + "\0" * 120, 10_003: "q" * 99, 10_004: "x" * 100}
    all_ = dict(list(texts.items())[:120]) | more
    df = spark.createDataFrame(list(all_.items()), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in substrings.remove_repeats(df).collect()}
    assert got == brute_repeats(all_)


def brute_rows(rows: list[tuple[int | None, str]], length: int = 100) -> list[tuple]:
    """Rows of one id (or of none) are one document: a window is repeated if it also starts at a lesser (id, place) of any row."""
    least: dict[bytes, tuple[int, int]] = {}
    for i, t in rows:
        body = t.encode()
        for p in range(len(body) - length + 1):
            at = (-(2**63) if i is None else i, p)
            least[body[p : p + length]] = min(at, least.get(body[p : p + length], at))
    out = []
    for i, t in rows:
        body = t.encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if least[body[p : p + length]] < (-(2**63) if i is None else i, p):
                gone[p : p + length] = b"\1" * length
        out.append((str(i), len(body), sum(gone), hashlib.sha256(bytes(c for c, x in zip(body, gone, strict=True) if not x)).hexdigest()))
    return sorted(out)


def test_rows_without_id_are_told_apart(spark, monkeypatch):
    r = random.Random(4)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(160)) for _ in range(5)]
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = [(None, word(r.randint(0, 90)) + r.choice(passages)[r.randint(0, 40) :] + word(20)) for _ in range(3000)]
    rows += [(5, word(30) + passages[0]), (5, word(20) + passages[0] + word(9)), (5, "ab" + passages[1]), (5, "ab" + passages[1])]
    monkeypatch.setattr(substrings, "IN_BUCKET", 5000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(df).collect())
    assert got == brute_rows(rows)


def test_one_passage_in_all_documents(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(230))
    df = spark.range(0, 60_000, 1, 12).selectExpr("id doc_id", f"concat(md5(cast(id as string)), '{passage}', sha1(cast(id as string))) text")
    got = substrings.remove_repeats(df).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    # the first keeps its passage; no other byte is in a repeated string, but where hexadecimal neighbours happen to be equal
    assert sum(x["count"] for x in got if x.n_removed == 0) == 1
    assert sum(x["count"] for x in got) == 60_000 and all(x.n_spans == 1 and 230 <= x.n_removed <= 250 for x in got if x.n_removed)


def test_buckets_beyond_the_splitters(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(substrings, "IN_BUCKET", 300)
    monkeypatch.setattr(substrings, "RANGES", 4)
    some = dict(list(texts.items())[:60])
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3)
    assert {r[0]: tuple(r)[1:] for r in substrings.remove_repeats(df).collect()} == brute_repeats(some)


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(2)
    rows = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(500)})
    rows = [(x, k, 0, k) for k, x in enumerate(rows * 2)]
    blocks = [b[1:] for k in range(7) for b in R.sorted_blocks(rows[k::7], [], 1, lambda same: (same, []))]
    merged = list(R.merge([R.read_block(b) for b in blocks]))
    assert [m[1] for m in merged] == sorted(x[0] for x in rows)
    assert all(n == R.common(a[1], b[1]) for a, b, n in zip(merged, merged[1:], [m[0] for m in merged[1:]], strict=False))


def test_a_run_sends_equal_strings_once():
    rows = [(b"abc", 3, 0, 0), (b"abc", 1, 0, 9 << 16), (b"abd", 2, 0, 0), (b"abc", 1, 0, 2 << 16)]
    told, sent = R.sorted_blocks(rows, [], 1, substrings.first_of_run)
    assert told[0] < 0 and np.frombuffer(told[4], np.int64).tolist() == [1, 3]
    assert list(R.read_block(sent[1:])) == [(0, b"abc", 1, 0, 2 << 16), (2, b"abd", 2, 0, 0)]


def test_next_texts_across_buckets(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(spotsigs, "IN_BUCKET", 7)
    ids = sorted(texts)
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs).collect()}
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(text) // 2
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
        assert got[i].near_next == (1.0 if got[i].fingerprint == got[ids[(k + 1) % len(ids)]].fingerprint else got[i].near_next)
        a, b = set(got[i].fingerprint.split()), set(got[i].edited_fingerprint.split())
        assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_spot_pairs_match_brute_force(spark, docs):
    sets = {r.doc_id: frozenset(r.spots) for r in spotsigs.fingerprint(docs, "text", "spots").collect() if r.spots}
    first: dict[frozenset, int] = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first.values())
    want = {(a, b) for k, a in enumerate(reps) for b in reps[k + 1 :] if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(docs, 0.5).collect()} == want and want


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        check = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and check % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data(spark, docs, texts):
    more = {10_002: "a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 😀 +1 (411) 555-1507 4540 5499 9036 6437 4111-1111-1111-1111", 10_004: "1 " * 30_000, 10_005: "a.b" * 30_000 + "@x.y"}
    more |= {11_000 + i: f"Please send it to user{i}@mail.example.com and thanks {i}" for i in range(8)}
    more |= {11_100: "so send it to XK-12345678 and thanks", 11_101: "an order no 12345678 here"}
    all_ = texts | more
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(all_.items()), "doc_id long, text string")).collect()}
    for i, text in all_.items():
        spans = base_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[3] == k for s in spans) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))
    assert got[11_100].spans == "id:14:25" and got[11_101].spans == ""


def test_redaction_leaves_the_rest(spark):
    rows = [(1, "mail a@b.co or 10.0.0.1!"), (2, "nothing here"), (3, None)]
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mail [EMAIL] or [IP]!", 2: "nothing here", 3: None}


def test_raking_is_that_of_brute_force(spark, docs):
    rows = mixing.labelled(docs)
    cells = rows.groupBy(*mixing.DIMENSIONS).sum("n_tokens").withColumnRenamed("sum(n_tokens)", "tokens")
    goal = {d: mixing.tempered(cells, d) for d in mixing.DIMENSIONS}
    raked = [r.asDict() for r in mixing.rake(cells, goal, close=0.0, sweeps=6).collect()]
    weights = {tuple(r[d] for d in mixing.DIMENSIONS): float(r["tokens"]) for r in raked}
    total = sum(weights.values())
    weights = {k: v / total for k, v in weights.items()}
    wanted = [{r[d]: r.target for r in goal[d].collect()} for d in mixing.DIMENSIONS]
    for _ in range(6):
        for k in range(3):
            sums = Counter()
            for c, v in weights.items():
                sums[c[k]] += v
            weights = {c: v * wanted[k][c[k]] / sums[c[k]] if sums[c[k]] else v for c, v in weights.items()}
    for r in raked:
        assert r["weight"] == pytest.approx(weights[tuple(r[d] for d in mixing.DIMENSIONS)], rel=1e-9, abs=1e-15)


def test_sampling_is_calibrated_and_repeatable(spark, docs):
    one, two = (mixing.mix(docs).collect() for _ in range(2))
    assert sorted(one) == sorted(two) and all(0 <= r.probability <= 1 for r in one)
    expected, total = sum(r.probability * r.n_tokens for r in one), sum(r.n_tokens for r in one)
    assert expected == pytest.approx(mixing.FRACTION * total, rel=1e-6)


def test_extraction_on_pages_held_out(spark):
    trees = html_extract.fitted(spark)
    right = runs = 0
    for seed in range(200):
        page, label = html_training.labelled_page(999_000_000 + seed)
        kept = decode(page, html_extract.chances(trees, features([page])))
        for k, text in enumerate(page.text):
            assert not kept[k] or k == 0 or kept[page.parent[k]]
            if text:
                runs += 1
                right += kept[k] == bool(label[k])
    assert right / runs > 0.96


def test_a_whole_licence_is_known_in_any_dress(spark):
    dressed = licences.MIT.upper().replace("LICENSE", "LICENCE").replace(",", " ;").replace("<YEAR> <COPYRIGHT HOLDERS>", "2019 Somebody") + "\n\n"
    rows = [(1, licences.MIT), (2, dressed), (3, licences.MIT + " and more"), (4, "Copyright (c) 2020 me"), (5, "text\nReleased under the MIT licence!\nLicensed under CC BY 4.0")]
    known, notices = (licences.registry(spark, x) for x in (licences.LICENCES, licences.NOTICES))
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), known, notices).collect()}
    assert [got[i].licence for i in range(1, 6)] == ["MIT", "MIT", None, None, None]
    assert got[4].digest is None and (got[5].notices, got[5].n_notices) == ("CC-BY-4.0,MIT", 2)


def test_pipeline_stages_hold_their_contracts(spark, docs):
    current = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in current.collect()}
        new = stage(spark, current, FOLDER)
        if k == len(names) - 1:
            assert {r.doc_id for r in new.collect()} == set(before)
            break
        assert new.columns == current.columns
        new = new.persist()
        after = {r.doc_id: r.text for r in new.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            top = components({i: shingles(t or "", 5) for i, t in before.items()}, 80)
            assert set(after) == {i for i in before if top[i] == i}
        if name == "personal_data":
            assert set(after) == set(before) and not any(base_spans(t or "") for t in after.values())
        current = new
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_long_lines_of_a_large_host_have_an_absolute_limit(spark):
    banner, short = "Subscribe to our weekly letter and never miss a story", "See also"
    own = lambda i: " ".join("abcdefghij"[int(c)] + "o" for c in f"{i:04d}")
    rows = [(i, f"story {own(i)} tells of many things that only it has, at some length\n" + (banner if i % 20 == 0 else short if i % 20 == 1 else "plain end"), "big") for i in range(2000)]
    rows += [(5000 + i, banner + f"\nand ten other words of my own, number {own(i)} of many", "small") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality.figures(docs)
    high = lambda **limits: {(r.host, r.h) for r in quality.boilerplate(found, **limits).collect()}
    of = {x: spark.createDataFrame([(x,)], "t string").select(F.xxhash64(quality.normal_line(F.col("t")))).first()[0] for x in (banner, short)}
    # 100 of 2,000 documents are below the share of the large host, and above an absolute limit of 80; the short line has too few words
    assert ("small", of[banner]) in high() and ("big", of[banner]) not in high()
    assert ("big", of[banner]) in high(most=80) and ("big", of[short]) not in high(most=80)
    kept = {r.doc_id: r.text for r in quality.keep_good(docs, most=80).collect()}
    assert banner not in kept[20] and kept[21].endswith(short)


def test_raking_warns_where_it_does_not_converge(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    share = lambda d, **x: spark.createDataFrame(list(x.items()), f"{d} string, target double")
    with pytest.warns(UserWarning, match="did not converge"):
        mixing.rake(cells, {"source": share("source", a=0.9, b=0.1), "lang": share("lang", x=0.1, y=0.9), "topic": share("topic", t=1.0)}, sweeps=3)


def test_copies_of_a_banner_count_as_documents(spark):
    own = lambda i: " ".join("abcdefghij"[int(c)] + "o" for c in f"{i:04d}")
    page = "Subscribe to our weekly letter and never miss a story\na page of nothing but its banner and very little else today"
    rows = [(i, page, "h") for i in range(40)] + [(100 + i, f"story {own(i)} tells of many things that only it has, at some length", "h") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert not any(kept[i] for i in range(40)) and all(kept[100 + i] for i in range(60))


def test_near_counts_of_a_large_group_make_no_pairs(spark, monkeypatch):
    """Every set of a group of near copies is asked for: counts are those of brute force, and no table holds a row for each pair."""
    dice = random.Random(5)
    core = [f"{k:012x}" for k in range(1, 31)]
    sets = {}
    for k in range(400):
        kept = [x for x in core if dice.random() > 0.06]
        sets[k] = sorted({*kept, *(f"{dice.randrange(16**12):012x}" for _ in range(dice.randrange(3)))})
    sets |= {k: sets[k - 400] for k in range(400, 430)} | {k: [f"{k:012x}", f"{k + 1:012x}"] for k in range(430, 460)}
    rows = spark.createDataFrame([(k, " ".join(x)) for k, x in sets.items()], "doc_id long, fingerprint string")
    rows = rows.select("doc_id", F.lit(True).alias("asked"), F.xxhash64("fingerprint").alias("print"), "fingerprint", F.split("fingerprint", " ").alias("spots"))
    written, durable = [], spotsigs.durable

    def counted(df):
        out = durable(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(spotsigs, "durable", counted)
    monkeypatch.setattr(spotsigs, "IN_CELL", 2000, raising=False)
    got = {r.fingerprint: r.n_near for r in spotsigs.near_counts(rows, 0.8).collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    plain = {k: frozenset(x) for k, x in sets.items()}
    want = {" ".join(x): sum(like(plain[k], y) >= 0.8 for y in plain.values()) - 1 for k, x in sets.items()}
    assert got == want and max(want.values()) > 100
    assert max(written) <= 3 * sum(map(len, sets.values()))
