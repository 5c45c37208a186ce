"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is made canonical (case, punctuation, copyright statements and equivalent spellings no longer tell texts apart), and the
digest of the whole canonical text is joined with the digests of known licences. Each line is a text of its own as well,
joined with the digests of known licence notices.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.common import durable, lower_ascii, text_of

# FIXED VALUES: equivalent spellings, the right-hand one is canonical
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "copyright holder": "copyright owner",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub license": "sublicense",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
}

#: Texts of known licences and the headers that files of a licence have, each in a file named by its SPDX identifier (and, after
#: a tilde, by the form of the text).
TEXTS, HEADERS = (Path(__file__).with_name(n) for n in ("licence_texts", "licence_headers"))
# FIXED VALUES: other titles of the texts whose first paragraph is a title; each is also known without one
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "License: MIT"],
    "ISC": ["The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "The Zero-Clause BSD License"],
    "BSD-2-Clause": ["The BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["The BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License"],
    "Zlib": ["The zlib License", "The zlib/libpng License"],
    "BSL-1.0": ["Boost Software License 1.0"],
}
# FIXED VALUES: what stands differently in copies of the same text: all of these pairs are tried, one after the other
FORMS = [
    (r"https?://", "http://"),
    (r"https?://", "https://"),
    (r"(?s)(END OF TERMS AND CONDITIONS).*", r"\1"),
    (r"51 Franklin St(?:reet)?, Fifth Floor, Boston,\s+MA\s+02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307"),
    (r"(?m)^ *[0-9]\. (Redistributions|Neither)", r"* \1"),
    (r"(THE COPYRIGHT) HOLDER(\s+)OR CONTRIBUTORS", r"\1 OWNER\2OR CONTRIBUTORS"),
    (r"(THE COPYRIGHT) (?:HOLDER|OWNER)(\s+)OR CONTRIBUTORS", r"\1 HOLDERS\2OR CONTRIBUTORS"),
]


def unwrapped(text: str) -> str:
    """Each paragraph in one line."""
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text.strip()))


def forms(text: str) -> list[str]:
    """The different forms of a text, wrapped as it is given and not."""
    made = [text]
    for pattern, new in FORMS:
        made += [x for t in made if (x := re.sub(pattern, new, t)) != t]
    return list(dict.fromkeys(x for t in made for x in (t, unwrapped(t))))


def dressed(name: str, text: str) -> list[tuple[str, str]]:
    """(licence, text) of a text under its own title, its other titles and none, in all its forms."""
    licence, head, body = name.partition("~")[0], *text.partition("\n\n")[::2]
    if name not in TITLES:
        return [(licence, x) for x in forms(text)]
    titled = [f"{t}\n\n{x}" for x in forms(body) for t in (head, *TITLES[name])]
    return [(licence, x) for x in [text, *titled, *forms(body)]]


def read(folder: Path) -> list[tuple[str, str]]:
    return [(file.name.removesuffix(".txt"), file.read_text("utf-8").strip()) for file in sorted(folder.glob("*.txt"))]


MIT = dict(read(TEXTS))["MIT"]
LICENCES = [x for name, text in read(TEXTS) + read(HEADERS) for x in dressed(name, text)]

# FIXED VALUES: known licence notices
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
# FIXED VALUES: names of licences in notices
NAMES = {
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "GNU AGPLv3", "AGPLv3", "AGPL-3.0"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "GNU Affero General Public License, version 3 or any later version", "GNU AGPL version 3 or later", "AGPLv3 or later"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache-2.0", "Apache 2.0", "Apache Software License 2.0", "Apache License, v2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International (CC BY 4.0)"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "European Union Public Licence, version 1.2", "EUPL 1.2"],
    "GFDL-1.3-only": ["GNU Free Documentation License, version 1.3"],
    "GFDL-1.3-or-later": ["GNU Free Documentation License, version 1.3 or any later version", "GNU Free Documentation License, version 1.3 or later"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL version 2", "GNU GPL v2", "GNU GPLv2", "GPL version 2", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License, version 2 or any later version", "GNU General Public License, version 2 or (at your option) any later version", "GNU General Public License v2.0 or later", "GNU GPL version 2 or later", "GNU GPL v2 or later", "GPL version 2 or later", "GPLv2 or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL version 3", "GNU GPL v3", "GNU GPLv3", "GPL version 3", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License, version 3 or any later version", "GNU General Public License, version 3 or (at your option) any later version", "GNU General Public License v3.0 or later", "GNU GPL version 3 or later", "GNU GPL v3 or later", "GPL version 3 or later", "GPLv3 or later"],
    "ISC": ["ISC License", "ISC"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "GNU LGPL v2.1", "LGPL version 2.1", "LGPL 2.1", "LGPLv2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "GNU Lesser General Public License, version 2.1 or any later version", "GNU LGPL version 2.1 or later", "LGPL version 2.1 or later", "LGPLv2.1 or later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL version 3", "GNU LGPL v3", "LGPL version 3", "LGPLv3"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "GNU Lesser General Public License, version 3 or any later version", "GNU LGPL version 3 or later", "LGPL version 3 or later", "LGPLv3 or later"],
    "MIT": ["MIT License", "MIT license (MIT)", "MIT"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
WAYS = ["Licensed under", "Released under", "Distributed under", "Available under", "Published under", "This work is licensed under", "This software is licensed under", "This project is licensed under"]
# an identifier with a plus sign is left out, as its canonical text is that of the one without
NOTICES += [(licence, f"{way} {the}{name}.") for licence, names in NAMES.items() for name in names for way in WAYS for the in ("", "the ", "the terms of the ")]
NOTICES += [(licence, f"License: {name}") for licence, names in NAMES.items() for name in names]
NOTICES += [(licence, f"SPDX-License-Identifier: {licence}") for licence in sorted({*NAMES, *(x for x, _ in LICENCES)})]
NOTICES += [(licence, x) for name, text in read(HEADERS) for licence, x in dressed(name, unwrapped(text).replace("\n\n", " "))]
#: Copyright statements: lines that begin with "copyright", "©" or a dated "(c)", or are just "all rights reserved". What goes on with
#: one of these words is the body of a licence that is wrapped there, and "(c)" without a year is an item of a list.
GOES_ON = "notices?|holders?|owners?|laws?|acts?|treat(?:y|ies)|licen[cs]es?|permissions?|protect(?:ion|ed)|rights?|interests?|statements?|status|assignments?|claims?|disclaimers?|restrictions?|infringements?|doctrines?|and|or|on|in|of|to|for|is|as|are|has|have|may|shall|that|this|which|under|with|than|if|line|resulting|ownership|the\\s+(?:library|program|software|work)"
MARK = rf"\n[^\na-z0-9(©\x{{80}}-\x{{10FFFF}}]*+(?:copyright(?![a-z,.;)'”\x22/-])(?!\s+(?:{GOES_ON})(?![a-z]))[^\n]*|©[^\n]*|\(c\)\s*(?:copyright|©|[<\[])[^\n]*|\(c\)(?=[^\n]*(?:19|20)[0-9]{{2}})[^\n]*|all rights reserved[^\na-z0-9]*(?=\n|\z))"
APART = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """What is left of a text when case, copyright statements, punctuation and equivalent spellings don't count."""
    low = F.concat(F.lit("\n"), lower_ascii(text))
    low = F.when(low.rlike("copyright|\\(c\\)|©|all rights reserved"), F.regexp_replace(low, MARK, "")).otherwise(low)
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, APART, " ")), F.lit(" "))
    some = flat.rlike(f" (?:{'|'.join(SPELLINGS)}) ")
    same = F.replace(flat, F.lit(" "), F.lit("  "))  # so that neighbours don't share a space
    for a, b in SPELLINGS.items():
        same = F.replace(same, F.lit(apart(a)), F.lit(apart(b)))
    return F.trim(F.when(some, F.replace(same, F.lit("  "), F.lit(" "))).otherwise(flat))


def apart(words: str) -> str:
    """Words as they stand where each space is doubled."""
    return f" {words.replace(' ', '  ')} "


def plain(text: str) -> str:
    """The canonical form of one text of the registry, as the column has it."""
    low = "\n" + text.translate({k: k + 32 for k in range(ord("A"), ord("Z") + 1)})
    low = re.sub(python_pattern(MARK), "", low, flags=re.ASCII)
    same = f" {re.sub(python_pattern(APART), ' ', low).strip(' ')} ".replace(" ", "  ")
    for a, b in SPELLINGS.items():
        same = same.replace(apart(a), apart(b))
    return same.replace("  ", " ").strip(" ")


def python_pattern(pattern: str) -> str:
    return pattern.replace(r"\x{80}", "\x80").replace(r"\x{10FFFF}", "\U0010ffff").replace(r"\z", r"\Z")


def digests(known: DataFrame) -> DataFrame:
    """(licence, digest) of known (licence, text), one licence (the first by name) for each digest; empty texts are left out.

    A written table, so that Spark knows its size before it plans the joins.
    """
    made = known.select("licence", canonical(F.col("text")).alias("c")).filter("c != ''")
    return durable(made.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("licence").alias("licence")))


def registry(spark: SparkSession, values: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(values, "licence string, text string")


def scan(docs: DataFrame, licences: DataFrame, notices: DataFrame) -> DataFrame:
    """Of each row: doc_id, digest of the canonical whole text (null if nothing is left of it), licence (null if unknown), and
    the distinct known notices among its lines as a sorted, comma-joined string with the number of lines that are one.

    Spark sees the size of both tables of digests and broadcasts them if they are small, else the digests are hash-joined; only
    lines that are a notice are shuffled. A null text is empty; a null doc_id stays null; repeated rows are scanned each, and
    share their result; other columns are not read; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    each = rows.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("line", "said"))
    lines = each.withColumn("line_digest", F.sha2(canonical(F.col("said")), 256))
    found = lines.join(digests(notices).withColumnsRenamed({"digest": "line_digest", "licence": "notice"}), "line_digest")
    found = found.groupBy(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key")).agg(
        F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"), F.count_distinct("line").alias("n_notices")
    )
    clean = F.nullif(canonical(F.col("text")), F.lit(""))
    whole = rows.select("doc_id", F.xxhash64("text").alias("key"), F.sha2(clean, 256).alias("digest")).join(digests(licences), "digest", "left")
    joined = whole.join(found, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key")), "left")
    return joined.select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


@lru_cache
def sql() -> str:
    """DuckDB SQL that the scan of documents is held against, with the digests of the whole registry.

    DuckDB's patterns can't look ahead. So what makes "copyright" the body of a licence is marked first, a statement that goes on in
    the next line is put into one, and then whole lines are kept or not.
    """

    def known(values: list[tuple[str, str]]) -> str:
        first: dict[str, str] = {}
        for licence, text in sorted(values, reverse=True):
            if flat := plain(text):
                first[hashlib.sha256(flat.encode()).hexdigest()] = licence
        return ", ".join(f"('{d}', '{licence}')" for d, licence in sorted(first.items()))

    def flat(x: str) -> str:
        out = f"regexp_replace(chr(10) || translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1), 'abcdefghijklmnopqrstuvwxyz' || chr(2)), '{BODY}', 'copyright' || chr(1) || '\\1', 'g')"
        out = f"regexp_replace({out}, '{OVER_LINES}', '\\1 \\2', 'g')"
        out = f"array_to_string(list_filter(string_split({out}, chr(10)), lambda l: not regexp_matches(l, '{STATEMENT}')), chr(10))"
        out = f"replace(' ' || trim(regexp_replace({out}, '{APART}', ' ', 'g'), ' ') || ' ', ' ', '  ')"
        for a, b in SPELLINGS.items():
            out = f"replace({out}, '{apart(a)}', '{apart(b)}')"
        return f"trim(replace({out}, '  ', ' '), ' ')"

    blank = r"[ \t\n\x0B\f\r]"
    lead = r"[^\na-z0-9(©\x{80}-\x{10FFFF}]*"
    BODY = f"copyright({blank}+(?:{GOES_ON.replace(chr(92) + 's', blank)})(?:[^a-z]|\\z))"
    OVER_LINES = rf"(\n{lead}\(c\)[ \t\x0B\f\r]*)\n{blank}*(copyright|©|[<\[])"
    STATEMENT = rf"^{lead}(?:copyright(?:[^a-z,.;)''”\x22/\x01-]|\z)|©|\(c\){blank}*(?:copyright|©|[<\[])|\(c\).*(?:19|20)[0-9]{{2}}|all rights reserved[^a-z0-9]*\z)"
    return f"""
with known(digest, licence) as (values {known(LICENCES)}),
notes(digest, notice) as (values {known(NOTICES)}),
base as (select doc_id, coalesce(text, '') t from documents),
found as (select doc_id, array_to_string(list_sort(list_distinct(list(notice))), ',') notices, count(*) n_notices
  from (select doc_id, sha256({flat("s")}) digest from (select doc_id, unnest(string_split(t, chr(10))) s from base)) join notes using (digest) group by 1),
whole as (select doc_id, sha256(nullif({flat("t")}, '')) digest from base)
select doc_id, digest, licence, coalesce(notices, '') notices, coalesce(n_notices, 0)::bigint n_notices
from whole left join known using (digest) left join found using (doc_id)"""
