"""Fill-in-the-middle, hard negatives and top-k search against brute force, on rows that are hard on purpose."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from auditloom.llm import fill_middle, hard_negatives, top_k, vectors

LONG = "the Cat sat on a mat, 42 times. " * 20_000
TEXTS = ["", None, " ", "a", "word", "ab cd", "\x1e", "\x1f", "\x1e0\x1e1\x1f\x1f1\x1e", "a\x1fb\x1e1c", "<P>", "x <S> y", "end <M", "<", "<S", "é☃ 🙂🙂 q\r\n\u0085 z", "<<S<S> no", "tab\there\0null", LONG, "z" * 200_000, "$1 \\ $0"]
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute_cut(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = SHA(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, None, text
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middles_of_odd_texts(spark):
    rows = [(i, t) for k, t in enumerate(TEXTS) for i in (range(100 * k, 100 * k + 25) if t is None or len(t) < 1000 else [100 * k, 100 * k + 1])]
    rows += [(None, "without an id"), (7, "twice"), (7, "twice"), (-5, "below zero"), (2**62, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(f"clash {c}") for c in "n form prefix middle suffix output units whole first second h1".split()})
    cut = fill_middle.cut(docs)
    got = [tuple(r) for r in cut.collect()]
    assert sorted(got, key=repr) == sorted((brute_cut(i, t) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    told = fill_middle.digests(cut).collect()
    want = sorted((str(i), SHA(t or ""), SHA(brute_cut(i, t)[-1])) for i, t in rows)
    assert sorted((str(r.doc_id), r.restored_sha256, r.output_sha256) for r in told) == want
    assert fill_middle.cut(docs.filter("false")).count() == 0


def test_shares_of_middles_are_parameters(spark):
    docs = spark.range(500).selectExpr("id doc_id", "concat('some words of document ', id) text")
    count = lambda **x: {r.form: r["count"] for r in fill_middle.cut(docs, **x).groupBy("form").count().collect()}
    assert set(count(plain=0, suffix_first=0)) == {"psm"} and set(count(plain=100)) == {"plain"} and set(count(plain=0, suffix_first=100)) == {"spm"}
    cuts = lambda seed: {r.doc_id: r.prefix for r in fill_middle.cut(docs, seed=seed).collect()}
    assert cuts("1") != cuts("2")


def whole(rows: list[tuple], scale: int) -> dict[int, tuple]:
    """id: (label, components) of the rows that take part; of an id the least."""
    out: dict[int, tuple] = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = label, [max(-(2**63), min(2**63, math.floor(x * scale))) for x in v]
        out[i] = min(row, out.get(i, row))
    return out


def product(a: list[int], b: list[int]) -> int:
    return max(-vectors.LIMIT, min(vectors.LIMIT, sum(x * y for x, y in zip(a, b, strict=True))))


def brute_top(rows: list[tuple], k: int, every: int) -> list[tuple]:
    known, out = whole([(i, v, 0) for i, v, _ in rows], 1024), []
    for q, (_, a) in known.items():
        if q % every == 0:
            scored = sorted((-product(a, b), i) for i, (_, b) in known.items() if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def brute_negatives(rows: list[tuple], every: int, low: int = 50, high: int = 95) -> list[tuple]:
    known, out = whole(rows, 256), []
    for a, (label, v) in known.items():
        if a % every == 0:
            scored = sorted((-product(v, w), i, other) for i, (other, w) in known.items() if i != a and len(v) == len(w))
            for s, p, _ in [x for x in scored if x[2] == label][:5]:
                fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
                out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fit[:3])]
    return sorted(out)


def hard_rows(n: int, dims: int) -> list[tuple]:
    """Clusters with ties, a third of all rows alike, ids far apart, and rows that take no part or are rare."""
    r = random.Random(n + dims)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    common, rows = [0.25] * dims, []
    for k in range(n):
        centre = centres[r.randrange(6)]
        v = common if k % 3 == 0 else [x + r.gauss(0, 0.3) for x in centre] if k % 3 == 1 else [round(x) / 2 for x in centre]
        rows.append((k, v, r.randrange(4)))
    nan, inf = float("nan"), float("inf")
    rows += [(None, common, 1), (10_000, None, 1), (10_100, common, None), (10_200, [nan] * dims, 1), (10_300, [*common[1:], inf], 1), (10_400, [*common[1:], None], 1)]
    rows += [(0, rows[0][1], rows[0][2]), (300, [9.0] * dims, 3), (50, common, 0), (50, [0.5] * dims, 0)]
    rows += [(-200, common, 2), (2**62, common, 2), (-(2**62), common, 1), (100_000, [1.0, 2.0], 1), (100_001, [1.0, 1.9], 2), (100_002, [1.0, 1.5], 1), (100_100, [], 1), (100_101, [], 1)]
    rows += [(200_000, [3e18] * dims, 1), (200_001, [-3e18] * dims, 1), (200_100, [1e6] * dims, 2), (200_101, [1e6 + 1] * dims, 3), (200_150, [2e12] + [0.0] * (dims - 1), 0)]
    return rows


@pytest.fixture(scope="module")
def points(spark):
    rows = hard_rows(700, 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return rows, df.withColumns({c: F.lit(f"clash {c}") for c in "v dim part shard block score rank floor last query_id anchor_id windows w need row n".split()})


@pytest.mark.parametrize("size", [vectors.SHARD_BYTES, 6000])
def test_top_k_of_hard_rows(points, size, monkeypatch):
    rows, df = points
    monkeypatch.setattr(vectors, "SHARD_BYTES", size)
    monkeypatch.setattr(top_k, "LEAF", 16)
    got = sorted(tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows, 10, 50)


@pytest.mark.parametrize(("size", "few", "digit"), [(vectors.SHARD_BYTES, 16, 10), (8000, 1, 6)])
def test_hard_negatives_of_hard_rows(points, size, few, digit, monkeypatch):
    rows, df = points
    monkeypatch.setattr(vectors, "SHARD_BYTES", size)
    monkeypatch.setattr(hard_negatives, "FEW", few)
    monkeypatch.setattr(hard_negatives, "DIGIT", digit)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect())
    want = brute_negatives(rows, 50)
    assert got == want and len(want) > 50


def test_no_vectors(points):
    _, df = points
    assert top_k.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert top_k.top_k(df, F.lit(False)).count() == 0 and hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_a_kth_score_from_elsewhere_spares_leaves(monkeypatch):
    """Leaves below the floor are not scored, and what is found still beats it."""
    import numpy as np

    r = np.random.default_rng(1)
    rows = np.floor(100 * (r.normal(size=(4000, 8)) + 6 * r.integers(0, 5, (4000, 1))))
    tree = top_k.ball_tree(np.arange(4000), rows)
    queries, own = rows[:20], np.full(20, -1)
    seen = []
    true = vectors.scores
    monkeypatch.setattr(vectors, "scores", lambda a, b: seen.append(len(a)) or true(a, b))
    none = np.full(20, -vectors.LIMIT - 1), np.full(20, 2**63 - 1)
    place, ids, score = top_k.search(tree, queries, own, *none, 10)
    alone, floors = sum(seen), np.array([score[place == q].min() for q in range(20)])
    assert alone < 0.5 * 20 * (tree["left_child"] == 0).sum()
    seen.clear()
    assert not len(top_k.search(tree, queries, own, floors, np.zeros(20, np.int64), 10)[0]) or (score >= 0).all()
    assert sum(seen) <= alone
    for q in range(20):
        exact = rows @ queries[q]
        want = np.lexsort((np.arange(4000), -exact))[:10]
        assert ids[place == q].tolist() == want.tolist()
