"""Records with all that lies below them, put together from the leaves up.

Rows know their parent's place, so each level of a document is grouped by (file, up) into the level above. Only what lies below a record
of a wanted kind is touched: sections that hold a whole file are never gathered.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.sources import records
from auditloom.sources.ledger import Files

PARTS = ("first", "name", "json", "plain", "digest")


def quoted(name: str) -> Column:
    """A name as JSON: names of elements hold nothing that must be escaped."""
    return F.concat(F.lit('"'), name, F.lit('"'))


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)


def listed(column: str) -> Column:
    """One JSON list of a field of the collected structs, in the order of places."""
    return F.concat(F.lit("["), F.array_join(F.transform("each", lambda x: x[column]), ","), F.lit("]"))


def repeated(files: Files, inside: Column) -> DataFrame:
    """Leaves whose name occurs again below the same parent, as entries of the parent; none if leaves weren't kept."""
    get = lambda n: F.try_element_at("fields", F.lit(n))
    leaves = files.of(records.LEAF).filter(inside).select("file", "up", "ord", "line", get("name").alias("name"), get("text").alias("text"))
    leaves = leaves.withColumn("n", F.count("*").over(W.partitionBy("file", "up", "name"))).filter("n > 1")
    told = F.to_json(F.struct(F.col("name").alias("tag"), "line", "text"))
    # to_json writes a list of one text with its brackets
    one = F.to_json(F.array("text"))
    rows = leaves.withColumn("one", one).select("file", "up", "name", F.struct("ord", told.alias("json"), F.expr("substring(one, 2, length(one) - 2)").alias("plain")).alias("x"))
    rows = rows.groupBy("file", "up", "name").agg(F.array_sort(F.collect_list("x")).alias("each"))
    return rows.select("file", "up", F.struct(F.col("each")[0]["ord"].alias("first"), "name", listed("json").alias("json"), listed("plain").alias("plain"), sha(listed("plain")).alias("digest")).alias("entry"))


def grown(files: Files, *kinds: str) -> DataFrame:
    """file, ord, up, line, path, tag, json, plain and digest of every record of these kinds, wherever it stands.

    json has tag, line, fields (the first leaf of a name) and children: by name, in document order, all records below and all leaves
    of a name that occurs again. plain is the same without tags and lines. Equal digests are equal trees, but for lines and for the
    order of differently named children.
    """
    inside = F.col("path").rlike(f"/(?:{'|'.join(map(re.escape, kinds))})(?:/|$)")
    rows = files.rows.filter(~F.col("kind").startswith("#") & inside).select("file", "up", "ord", "line", "path", F.col("kind").alias("tag"), "fields", F.size(F.split("path", "/")).alias("level"))
    span = rows.agg(F.min("level"), F.max("level")).first()
    leaves = repeated(files, inside)
    made: list[DataFrame] = []
    below: DataFrame | None = None
    for level in range(span[1] or 0, (span[0] or 1) - 1, -1):
        own = rows.filter(F.col("level") == level)
        entries = leaves
        if below is not None:
            lists = below.groupBy("file", "up", F.col("tag").alias("name")).agg(F.array_sort(F.collect_list(F.struct("ord", "json", "plain", "digest"))).alias("each"))
            entries = leaves.unionByName(lists.select("file", "up", F.struct(F.col("each")[0]["ord"].alias("first"), "name", listed("json").alias("json"), listed("plain").alias("plain"), sha(listed("digest")).alias("digest")).alias("entry")))
        kids = entries.groupBy("file", F.col("up").alias("ord")).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        below = own.join(kids, ["file", "ord"], "left").withColumn("entries", F.coalesce("entries", F.expr("array()"))).select("file", "up", "ord", "line", "path", "tag", *node())
        made.append(below.filter(F.col("tag").isin(*kinds)))
    if not made:
        return rows.select("file", "ord", "up", "line", "path", "tag", *[F.lit("").alias(c) for c in PARTS[2:]])
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.select("file", "ord", "up", "line", "path", "tag", *PARTS[2:])


def node() -> list[Column]:
    """json, plain and digest of a record from its fields and entries."""
    entry = lambda of: F.array_join(F.transform("entries", lambda x: F.concat(F.lit('"'), x["name"], F.lit('":'), x[of])), ",")
    json = F.concat(F.lit('{"tag":'), quoted("tag"), F.lit(',"line":'), F.col("line").cast("string"), F.lit(',"fields":'), F.to_json("fields"), F.lit(',"children":{'), entry("json"), F.lit("}}"))
    names = F.transform("entries", lambda x: x["name"])
    left = F.to_json(F.map_filter("fields", lambda k, v: ~F.array_contains(names, k)))
    comma = F.when((left != "{}") & (F.size("entries") > 0), ",").otherwise("")
    plain = F.concat(F.lit("{"), F.regexp_replace(left, r"^\{|\}$", ""), comma, entry("plain"), F.lit("}"))
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    digests = F.array_join(F.array_sort(F.transform("entries", lambda x: F.concat(x["name"], F.lit(":"), x["digest"]))), ",")
    return [json.alias("json"), plain.alias("plain"), sha(F.col("tag"), ordered, digests).alias("digest")]


def nested(files: Files, *kinds: str) -> DataFrame:
    """file, ord, up, line, path, tag, record, plain and digest; record and plain are variants (see grown).

    Repeated leaves are there if the files were read with elements=True. A record beyond the size that a variant may have is null.
    """
    rows = grown(files, *kinds)
    return rows.select("file", "ord", "up", "line", "path", "tag", F.try_parse_json("json").alias("record"), F.try_parse_json("plain").alias("plain"), "digest")


def text(record: Column, name: str) -> Column:
    """The first text of a leaf child."""
    return F.try_variant_get(record, f"$.fields['{name}']", "string")


def children(record: Column, name: str) -> Column:
    """All records, or repeated leaves, of a name, in document order; an empty array if there are none."""
    return F.coalesce(F.try_variant_get(record, f"$.children['{name}']", "array<variant>"), F.expr("array()").cast("array<variant>"))


def child(record: Column, name: str) -> Column:
    """The first record of a name."""
    return F.try_variant_get(record, f"$.children['{name}'][0]", "variant")


def texts(record: Column, name: str) -> Column:
    """The texts of all leaves of a name, in document order."""
    several = F.transform(children(record, name), lambda x: F.try_variant_get(x, "$.text", "string"))
    alone = text(record, name)
    return F.when(F.size(several) > 0, several).when(alone.isNotNull(), F.array(alone)).otherwise(several)


def to_dict(plain: Any) -> dict[str, Any]:
    """A plain variant of a collected row as a dictionary: texts, lists of texts, lists of dictionaries."""
    return plain.toPython()
