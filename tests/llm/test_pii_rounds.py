"""Scores of contextual patterns rise and fall over the rounds, as in a brute-force version of the graph."""

from __future__ import annotations

import random
import re
import time

from auditloom.llm import pii


def test_verdicts_change_between_the_first_and_the_last_round(spark):
    said = [f"contact id seed{i}@mail.example.com" for i in range(60)]
    said += [f"{left} TT-10000{i}" for left in ("contact id", "ticket ref") for i in range(5)] + ["ticket ref XX-900001"]
    said += [f"case no other{i}@mail.example.com" for i in range(3)]
    said += [f"{left} UU-20000{i}" for left in ("case no", "lot number") for i in range(6)] + [f"lot number VV-30000{i}" for i in range(6)]
    # few seeds by share, but other patterns vouch for the rest
    said += [f"write at seed{i}@mail.example.com" for i in range(3)]
    said += [f"{left} WW-40000{i}" for left in ("contact id", "write at") for i in range(13)]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    found = pii.findings(docs)
    told = lambda **tuning: {r.pattern for r in pii.trusted(docs, found, **tuning).collect()}
    assert told(rounds=0) == {"<contact id", "<case no"}
    assert told() == {"<contact id", "<ticket ref", "<write at"}
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs).collect()}
    assert spans[said.index("ticket ref XX-900001")] == "id:11:20" and spans[said.index("lot number VV-300000")] == "" and spans[said.index("case no UU-200000")] == ""


def brute_patterns(texts: list[str], rounds: int = pii.ROUNDS, score: float = pii.SCORE, seeds: int = pii.SEEDS, prior: float = pii.PRIOR) -> set[str]:
    """For texts whose entities and tokens stand alone between spaces."""
    edges: dict[str, dict[str, bool]] = {}
    ordinary: dict[str, set[str]] = {}
    sure: set[str] = set()
    for text in texts:
        words = [re.sub("[0-9]", "0", w.lower()) for w in text.split()]
        for k, w in enumerate(text.split()):
            base = bool(re.fullmatch(pii.PATTERNS["email"].replace(r"\G|", ""), w))
            token = bool(re.fullmatch(pii.TOKEN, w)) and not base
            patterns = ["<" + " ".join(words[k - 2 : k])] * (k > 1) + [">" + " ".join(words[k + 1 : k + 3])] * (k + 2 < len(words))
            if base or re.fullmatch(pii.STRONG[1:-1], w):
                sure.add(w.lower())
            for p in patterns:
                if base or token:
                    edges.setdefault(p, {})[w.lower()] = True
                if not re.search("[0-9@_]|[a-z][A-Z]", w):
                    ordinary.setdefault(p, set()).add(w)
    edges = {p: x for p, x in edges.items() if len(x) >= seeds}
    others = {p: len(ordinary.get(p, ())) for p in edges}
    known = {(p, i): 1.0 if i in sure else prior for p, x in edges.items() for i in x}
    enough = lambda x: x >= score - 1e-9
    for _ in range(rounds):
        told = {}
        for p, x in edges.items():
            for i in x:
                rest = [known[p, j] for j in x if j != i]
                size = len(rest) + others[p]
                mean = sum(rest) / size if size else 0.0
                told[p, i] = mean if enough(mean) and sum(map(enough, rest)) >= seeds else 0.0
        of: dict[str, list[str]] = {}
        for p, i in known:
            of.setdefault(i, []).append(p)
        known = {(p, i): 1.0 if i in sure else (prior + sum(told[q, i] for q in of[i] if q != p)) / len(of[i]) for p, i in known}
    mean = {p: sum(known[p, i] for i in x) / (len(x) + others[p]) for p, x in edges.items()}
    return {p for p, x in edges.items() if enough(mean[p]) and sum(enough(known[p, i]) for i in x) >= seeds}


def test_trusted_patterns_match_brute_force(spark):
    r = random.Random(8)
    plain = "the of order ref id was sent to desk and then kept".split()
    names = [f"user{i}@mail.example.com" for i in range(60)] + [f"KEY-{i:05d}" for i in range(12)] + [f"keyOf{c}alue" for c in "abcdefgh"]
    texts = []
    for _ in range(700):
        words = [r.choice(plain) for _ in range(r.randint(3, 9))]
        if r.random() < 0.2:
            words[r.randrange(len(words))] = r.choice(names)
        if r.random() < 0.4:
            words += ["secret", "key", r.choice(names), "ends", "here"]
        if r.random() < 0.3:
            words += ["ticket", "no", r.choice(names[60:])]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.pattern for x in pii.trusted(docs, pii.findings(docs)).collect()}
    assert got == brute_patterns(texts) and {"<secret key", ">ends here", "<ticket no"} <= got


def test_unseen_keys_are_found_in_the_tables(spark):
    """The tables hold keys in double quotes; their format makes some of them seeds, and what stands around them tells the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    wanted = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer('"([0-9A-Za-z]{40})"', t)}
    got = {(x.doc_id, int(s.split(":")[1]), int(s.split(":")[2])) for x in pii.find_pii(docs).collect() for s in x.spans.split(",") if s.startswith("id:")}
    assert wanted and len(got & wanted) >= 0.9 * len(wanted) and len(got & wanted) >= 0.95 * len(got)


def test_very_many_spans_in_one_text(spark):
    text = " ".join(f"a{k}@b.co 10.0.0.{k % 256}" for k in range(50_000))
    docs = spark.createDataFrame([(1, text), (2, "🙂 " * 600 + "x@y.zz 🙂" + "é" * 1500 + " +31 20 555 1234")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    kept = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.monotonic() - began < 90
    assert got[1].n_email == got[1].n_ip == 50_000
    places = [s.split(":") for s in got[1].spans.split(",") if not s.startswith("id")]
    assert all(("@" in text[int(a) : int(b)]) == (kind == "email") for kind, a, b in places) and text[int(places[-1][1]) : int(places[-1][2])] == "10.0.0.79"
    assert kept[1] == " ".join(["[EMAIL] [IP]"] * 50_000)
    assert kept[2] == "🙂 " * 600 + "[EMAIL] 🙂" + "é" * 1500 + " [PHONE]"


def test_a_pattern_is_found_in_a_corpus_of_any_size(spark):
    """Five documents give the same identifier alone and among thousands of others, and none of a published format of keys."""
    five = [f"contact ref {w}@mail.example.com today" for w in ("anna", "bert", "cora", "dirk")] + ["contact ref TT-100001 today"]
    r = random.Random(9)
    plain = "the of order was sent to desk and then kept by us for all".split()
    noise = [" ".join(r.choice(plain) for _ in range(12)) + f" KX-{i:06d} " + r.choice(plain) for i in range(6000)]
    alone = {x.doc_id: x.spans for x in pii.find_pii(spark.createDataFrame(list(enumerate(five)), "doc_id long, text string")).collect()}
    among = {x.doc_id: x.spans for x in pii.find_pii(spark.createDataFrame(list(enumerate(five + noise)), "doc_id long, text string")).collect()}
    assert alone[4] == "id:12:21" and {i: among[i] for i in alone} == alone


def test_what_could_be_trusted_holds_all_that_is(spark):
    """Bounds leave out nothing: with no bound at all the same patterns are trusted."""
    r = random.Random(10)
    plain = "the of order ref id was sent to desk".split()
    names = [f"user{i}@mail.example.com" for i in range(30)] + [f"KEY-{i:05d}" for i in range(40)]
    texts = [" ".join([r.choice(plain) for _ in range(4)] + [r.choice(["secret", "ticket", "lot", "box"]), r.choice(["key", "no"]), r.choice(names[: 30 + 10 * (k % 5)]), r.choice(plain), r.choice(plain)]) for k in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.findings(docs)
    for tuning in ({}, {"prior": 0.6}, {"score": 0.3, "seeds": 2}, {"part": 1.0}, {"part": 0.0}):
        got = {x.pattern for x in pii.trusted(docs, found, **tuning).collect()}
        assert got == brute_patterns(texts, **{k: v for k, v in tuning.items() if k != "part"})
