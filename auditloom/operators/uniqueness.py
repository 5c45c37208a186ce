"""First definitions, later duplicates and conflicts, as windows or aggregates over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds nth: the place of a row among those of its key (nulls are a key of their own)."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return ranked(rows, keys, order).filter("nth = 1").drop("nth")


def later(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row after the first of its key."""
    return ranked(rows, keys, order).filter("nth > 1")


#: parts of rows whose keys are nearly all different; up to 200, a shuffle writes its parts without holding rows in memory
SPREAD = 200


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows dealt by keys that are nearly all different to SPREAD tasks.

    To aggregate such keys before the shuffle only fills memory, and the tasks aren't put together again by their size on disk,
    where such keys take little.
    """
    return rows.repartition(SPREAD, *keys)


def distinct_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The different values of keys that are nearly all different."""
    return dealt(rows.select(*keys), keys).distinct()


def duplicate_counts(rows: DataFrame, keys: list[str], rare: bool = False) -> DataFrame:
    """Keys that occur more than once, with how often; pre-aggregates before the shuffle, so hot keys are cheap.

    rare: nearly all keys are different, and so are dealt before they are counted.
    """
    if rare:
        rows = dealt(rows.select(*keys), keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def first_holder(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose key another row had before, with that first row's value."""
    window = W.partitionBy(key).orderBy(*order)
    first = F.first(value).over(window.rowsBetween(W.unboundedPreceding, 0))
    return rows.filter(F.col(key).isNotNull()).withColumns({f"first_{value}": first, "nth": F.row_number().over(window)}).filter("nth > 1").drop("nth")


def conflicts(first: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that two files define differently, compared field by field, null like null."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    a, b = (x.select(key, *fields).alias(n) for x, n in ((first, "a"), (other, "b")))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).filter(~same).select(F.col(f"a.{key}").alias(key))


def islands(rows: DataFrame, keys: list[str], within: list[str], order: list[str], block: Column) -> DataFrame:
    """Adds island: the running number, from 0, of the run of consecutive rows with equal keys.

    block is a column that never falls along the order, such as a place divided by some number. Runs are numbered within each block, in
    as many tasks as there are blocks; then the first and last keys of neighbouring blocks tell whether a run goes on over
    the border, and only a row a block is windowed by within.
    """
    at = [*within, "__block"]
    window = W.partitionBy(*at).orderBy(*order)
    changed: Column = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.lag(k).over(window))
    first = F.row_number().over(window) == 1
    rows = rows.withColumn("__block", block).withColumn("__starts", F.when(first, 0).otherwise(changed.cast("int")))
    rows = rows.withColumn("__island", F.sum("__starts").over(window.rowsBetween(W.unboundedPreceding, 0))).drop("__starts")
    key, place = F.struct(*keys), F.struct(*order)
    edges = rows.groupBy(*at).agg(F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"), F.max("__island").alias("changes"))
    along = W.partitionBy(*within).orderBy("__block")
    before = F.lag("last").over(along)
    edges = edges.withColumn("border", F.when(F.row_number().over(along) == 1, 0).otherwise((~F.col("first").eqNullSafe(before)).cast("int")))
    number = F.sum("border").over(along.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("changes").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*[F.col(c).alias(f"{c}__") for c in at], number.alias("__before"))
    same = F.lit(True)
    for c in at:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    joined = rows.join(edges, same).withColumn("island", F.col("__before") + F.col("__island"))
    return joined.drop("__block", "__island", "__before", *[f"{c}__" for c in at])


def running_numbers(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds seq to rows with (file, ord): ordinals that go on across files, from the counts (file, n) of the files before.

    Only one row for each file is windowed; no rows pass through one task.
    """
    before = F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parts.join(counts.withColumn("before", before).drop("n"), "file").withColumn("seq", F.col("before") + F.col("ord")).drop("before")
