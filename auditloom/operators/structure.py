"""Schema rules over the elements of a document: facets, cardinality, order and choice.

elements: parent (key), name, ord (place among the parent's children), value. spec: name, min, max, position, and facets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions.values import AMOUNT, significant_digits, stripped


def too_long(value: Column, most: int) -> Column:
    return F.char_length(value) > most


def not_in_enum(value: Column, allowed: list[str]) -> Column:
    return ~stripped(value).isin(allowed)


def not_like(value: Column, pattern: str) -> Column:
    return ~value.rlike(f"^(?:{pattern})$")


def too_many_digits(value: Column, total: int, fraction: int) -> Column:
    """Valid decimals with more significant digits, or more of them after the point, than allowed."""
    all_, after = significant_digits(value)
    return stripped(value).rlike(AMOUNT) & ((all_ > total) | (after > fraction))


def cardinality(parents: DataFrame, elements: DataFrame, spec: DataFrame) -> DataFrame:
    """(parent, name, occurrences) outside the bounds of spec (name, min, max); a missing child occurs 0 times.

    Parents are crossed with the few rows of the specification, whose size does not depend on the data.
    """
    counts = elements.groupBy("parent", "name").agg(F.count("*").alias("n"))
    wanted = parents.crossJoin(F.broadcast(spec))
    joined = wanted.join(counts, ["parent", "name"], "left").withColumn("occurrences", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.filter((F.col("occurrences") < F.col("min")) | (F.col("occurrences") > F.col("max"))).select("parent", "name", "occurrences")


def out_of_order(elements: DataFrame) -> DataFrame:
    """Parents with a child whose position in the specification is before that of the child ahead of it."""
    before = F.lag("position").over(W.partitionBy("parent").orderBy("ord"))
    return elements.withColumn("before", before).filter("before > position").select("parent").distinct()


def unknown_elements(elements: DataFrame, spec: DataFrame) -> DataFrame:
    return elements.join(F.broadcast(spec.select("name")), "name", "left_anti")
