"""Whole licences as they are published, in the line breaks that they are found in."""

from __future__ import annotations

import re
import textwrap

import duckdb
import pyarrow as pa

from auditloom.llm import licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def wrapped(text: str, width: int) -> str:
    """Each paragraph in lines of the width."""
    return "\n\n".join("\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))


def scanned(spark, texts: list[str]) -> list:
    known, notices = (licences.registry(spark, x) for x in (licences.LICENCES, licences.NOTICES))
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known, notices)
    return sorted(rows.collect(), key=lambda r: r.doc_id)


def test_published_texts_are_known_in_any_line_breaks(spark):
    heads = ["", "MIT License\n\nCopyright (c) 2019 Some Body\n\n", "The MIT License (MIT)\nCopyright 2004-2010, The Some Contributors\nAll rights reserved.\n\n", "# Copyright © 2020 Some Body\n\n(c) 2021 Another\n\n"]
    texts = [h + t for h in heads for t in (MIT, *[wrapped(MIT, w) for w in (24, 60, 79, 10_000)])]
    texts += [h + wrapped(ISC, w) for h in ("", "ISC License\n\nCopyright (c) 2019, Some Body\n\n") for w in (12, 40, 72, 10_000)]
    got = scanned(spark, texts)
    assert [r.licence for r in got] == ["MIT"] * 20 + ["ISC"] * 8
    assert len({r.digest for r in got[:5]}) == 1


def test_only_statements_are_left_out(spark):
    a, b, c, d, e = scanned(spark, ["one\ncopyright holders may\ntwo", "one\n(c) You must keep it\ntwo", "one two", "one\n  (c) 2020 me\nCopyright: me\nAll rights reserved.\ntwo", MIT.replace("copyright notice and", "notice and")])
    assert len({a.digest, b.digest, c.digest}) == 3 and c.digest == d.digest and e.licence is None


def test_common_licences_and_notices_are_known(spark):
    whole = {name.partition("~")[0]: text for name, text in licences.read(licences.TEXTS)}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(whole)
    got = scanned(spark, [*whole.values(), *[licences.unwrapped(t) for t in whole.values()]])
    assert [r.licence for r in got] == list(whole) * 2
    said = {
        "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
        "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later",
        "Distributed under the terms of the GNU General Public License, version 2 or later.": "GPL-2.0-or-later",
        "This software is licensed under the Mozilla Public License, v. 2.0": "MPL-2.0",
        "Licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0-only",
        "a text about the MIT License and others": "",
    }
    assert [r.notices for r in scanned(spark, [f"one\n{line}\ntwo" for line in said])] == list(said.values())


def test_headers_of_files_are_known(spark):
    heads = dict(licences.read(licences.HEADERS))
    assert [r.licence for r in scanned(spark, ["Copyright 2020 Some Body\n\n" + t for t in heads.values()])] == list(heads)


def test_tables_of_digests_are_small_enough_to_broadcast(spark):
    known = licences.digests(licences.registry(spark, licences.NOTICES))
    assert known._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 256 * 1024


def test_neighbouring_spellings(spark):
    rows = ["the centre centre of labour labour labour", "the center center of labor labor labor", "per cent per cent sub licence sub licence", "percent percent sublicense sublicense"]
    got = scanned(spark, rows)
    assert got[0].digest == got[1].digest and got[2].digest == got[3].digest
    assert [licences.plain(x) for x in rows[::2]] == rows[1::2]


def test_the_sql_holds_the_whole_registry(spark):
    """Every registered text, in several line breaks, with what only just is a statement or isn't, in Spark and in DuckDB."""
    texts = [t for _, t in licences.LICENCES if len(t) < 40_000]
    texts += [wrapped(t, w) for name, t in licences.read(licences.TEXTS) for w in (24, 51, 79, 10_000)]
    texts += [line for _, line in licences.NOTICES[::7]]
    marks = ["Copyright\n\n notices stay", "copyright\nSome Body\nstays", "(c)\n copyright 2020 me\nstays", "(c)\n[year] me\nstays", "(c) 2020 me", "(c) item", "# © me", "all rights reserved. \nx", "all rights reserved to me", "copyright\x01 me", "copyrighted work", "a copyright 2020", "copyright (c) on\ncopyright on copyright notice", "", "\u00a0copyright me", "(c)\n(c)\ncopyright x", "* Copyright the\nlibrary", "copyright", "the sub\nlicence centre centre"]
    texts += [a + "\n" + b for a in marks for b in marks]
    spark_rows = [tuple(r) for r in scanned(spark, texts)]
    documents = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    con = duckdb.connect()
    con.register("documents", documents)
    assert con.sql(licences.sql() + " order by doc_id").fetchall() == spark_rows
    assert len({r[2] for r in spark_rows} - {None}) >= 25 and len({r[3] for r in spark_rows}) > 35
    assert not re.search("above notice and this", licences.sql())
