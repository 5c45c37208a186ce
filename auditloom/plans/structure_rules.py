"""Structure rules of a version's catalogue over the records of files read with elements=True."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.values import AMOUNT, is_double, parse_date, parse_int, significant_digits, stripped
from auditloom.operators.findings import ERROR, distinct, finding, several
from auditloom.plans.validate import say
from auditloom.sources import records
from auditloom.sources.ledger import Files

# FIXED VALUES: the lexical forms of times and truth values
DATETIME, TIME, TRUTH = r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$", r"^[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$", ["true", "false", "0", "1"]


def elements(files: Files) -> DataFrame:
    """Every element: its file, parent's and own place, path, name, line, and text of a leaf."""
    leaf = F.col("kind") == records.LEAF
    get = lambda n: F.try_element_at("fields", F.lit(n))
    rows = files.rows.filter((F.col("kind") == records.LEAF) | ~F.col("kind").startswith("#")).filter("kind not like 'adf%'")
    return rows.select("file", "up", "ord", "path", "line", F.when(leaf, get("name")).otherwise(F.col("kind")).alias("name"), F.when(leaf, get("text")).alias("text"))


def value_rules(known: DataFrame) -> list[DataFrame]:
    """Facets of leaves, judged once for each different (path, text) of the specification."""
    s, raw = stripped(F.col("text")), F.col("text")
    leaves = known.filter("kind <> 'complex' and text is not null")
    # most texts occur again and again, and few are wrong: each is judged once, and only the wrong ones meet the elements
    rows = leaves.drop("file", "up", "ord", "line").dropDuplicates(["path", "text"])
    kind = lambda *k: F.col("kind").isin(*k)
    all_, after = significant_digits(raw)
    number = F.when(s.rlike(AMOUNT), s.try_cast("decimal(38,10)"))
    no = lambda test: ~F.coalesce(test, F.lit(False))
    length = F.char_length(raw)
    like: Column = F.exists("patterns", lambda p: F.regexp_like(raw, F.concat(F.lit("^(?:"), p, F.lit(")$"))))
    tests: list[tuple[str, Column, str]] = [
        ("XAF3020", F.col("fixed").isNotNull() & (s != F.col("fixed")), "not the fixed value"),
        ("XAF3014", kind("string") & ((length < F.col("min_length")) | (length > F.col("max_length"))), "too short or too long"),
        ("XAF3015", F.col("allowed").isNotNull() & ~F.array_contains("allowed", raw), "not one of the allowed values"),
        ("XAF3015", kind("boolean") & ~s.isin(TRUTH), "not a truth value"),
        ("XAF3016", F.col("patterns").isNotNull() & ~like, "not of the required form"),
        ("XAF3017", (kind("date") & parse_date(raw).isNull()) | (kind("datetime") & ~s.rlike(DATETIME)) | (kind("time") & ~s.rlike(TIME)), "not a valid date or time"),
        ("XAF3018", (kind("decimal") & no(s.rlike(AMOUNT))) | (kind("double") & ~is_double(raw)), "not a valid number"),
        ("XAF3018", kind("decimal") & s.rlike(AMOUNT) & ((all_ > F.col("total_digits")) | (after > F.col("fraction_digits"))), "too many digits"),
        ("XAF3019", kind("integer") & (parse_int(raw).isNull() | (all_ > F.col("total_digits"))), "not a valid integer"),
        ("XAF3021", kind("decimal", "integer") & ((number < F.col("min_inclusive").try_cast("decimal(38,10)")) | (number > F.col("max_inclusive").try_cast("decimal(38,10)"))), "out of bounds"),
    ]
    wrong = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(text).alias("said"))) for code, test, text in tests]
    judged = rows.select("path", "text", F.explode(F.array_compact(F.array(*wrong))).alias("x")).select("path", "text", "x.*")
    found = leaves.select("file", "line", "path", "name", "text").join(judged, ["path", "text"])
    codes = [(F.col("code") == c, c, ERROR, say(F.col("name"), F.col("said")), F.col("text")) for c in sorted({c for c, *_ in tests})]
    return [several(found, codes, file=F.col("file"), line=F.col("line"), path=F.col("path"))]


def structure(files: Files, spec: DataFrame) -> DataFrame:
    """Findings of files against a catalogue (auditloom.sources.catalogue): unknown and missing elements, order, choices, facets.

    The catalogue has a few hundred rows whatever the data, so it is broadcast; elements are grouped by their parent.
    """
    spec = F.broadcast(spec)
    rows = elements(files)
    known = rows.join(spec.drop("name"), "path", "left")
    unknown = known.filter("position is null")
    at = {"file": F.col("file"), "line": F.col("line"), "path": F.col("path")}
    good = known.filter("position is not null")

    before = F.lag("position").over(W.partitionBy("file", "up").orderBy("ord"))
    jumbled = good.withColumn("before", before).filter("before > position").groupBy("file", "up").agg(F.min("line").alias("line"), F.first("parent").alias("path"))
    counts = good.groupBy("file", "up", F.col("path").alias("child")).agg(F.count("*").alias("n"))
    parents = good.filter("kind = 'complex'").select("file", F.col("ord").alias("up"), F.col("path").alias("parent"), "line")
    wanted = parents.join(spec.select("parent", "name", F.col("path").alias("child"), "least", "most", "choice"), "parent")
    found = wanted.join(counts, ["file", "up", "child"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    plain = found.filter("choice is null")
    group = F.substring_index("choice", ".", 1)
    branches = found.filter("choice is not null").withColumn("group", group).groupBy("file", "up", "parent", "line", "group", "choice").agg(F.sum("n").alias("n"), F.max("least").alias("needs"), F.sum(F.when(F.col("n") < F.col("least"), 1).otherwise(0)).alias("lacking"))
    chosen = branches.groupBy("file", "up", "parent", "line", "group").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("branches"), F.max("needs").alias("needs"), F.max(F.when(F.col("n") > 0, F.col("lacking"))).alias("lacking"))
    up = {"file": F.col("file"), "line": F.col("line"), "path": F.col("parent")}
    parts = [
        finding(unknown, "XAF3011", ERROR, say("element is not defined:", F.col("name")), **at),
        finding(jumbled, "XAF3013", ERROR, say("children are not in the order of the schema"), **at),
        finding(plain.filter("n < least"), "XAF3010", ERROR, say("required element is missing:", F.col("name")), **up),
        finding(plain.filter("n > most"), "XAF3012", ERROR, say("element occurs too often:", F.col("name"), F.col("n").cast("string")), **up),
        finding(chosen.filter("branches > 1"), "XAF3012", ERROR, say("only one of several elements may occur"), **up),
        finding(chosen.filter("branches = 0 and needs > 0"), "XAF3010", ERROR, say("one of several elements must occur"), **up),
        finding(chosen.filter("branches = 1 and lacking > 0"), "XAF3010", ERROR, say("the chosen elements are not complete"), **up),
        *value_rules(good),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return distinct(out)
