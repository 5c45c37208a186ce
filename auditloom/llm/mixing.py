"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed into cells of (source, language, topic); the cells' token weights are raked to the target share of
every source, language and topic in turn until no factor moves; a document is then drawn with its cell's calibrated
probability. Only the cells take part in the iterations: their number depends on the categories and not on the documents.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.llm.common import GAP, durable, text_of

DIMENSIONS = ("source", "lang", "topic")
#: Without given targets, the target share of a category is its own share to this power, normalised.
TEMPER = 0.7
#: Raking ends when no factor of a sweep is further than this from 1, or after so many sweeps.
CLOSE, SWEEPS = 1e-4, 20
#: Up to so many cells are raked in one task, so many sweeps a query: no shuffles, and no small tables built in the driver's memory.
FEW, TOGETHER = 100_000, 5
#: share of all tokens to draw
FRACTION = 0.6


def register(text: Column) -> Column:
    """A topic where none is given: the form of a text by its telling characters."""
    part = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / F.greatest(F.length(text), F.lit(1))
    return (
        F.when(part("|") > 0.02, "table")
        .when(part("{};=<>") > 0.01, "code")
        .when(part("!?") > 0.02, "chat")
        .when(part("#*$%&") > 0.05, "noise")
        .when(F.length(text) < 1000, "short prose")
        .otherwise("long prose")
    )


def labels(topic: Column | None = None, tokens: Column | None = None) -> list[Column]:
    """source, lang, topic, n_tokens (words, unless given) and a uniform number in [0, 1) from doc_id and text."""
    text = text_of()
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)
    words = F.size(F.array_remove(F.split(text, GAP), "")).cast("long")
    return [
        known("source"),
        known("lang"),
        (register(text) if topic is None else F.coalesce(topic.cast("string"), F.lit("unknown"))).alias("topic"),
        (words if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))).alias("n_tokens"),
        (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", text), 11) / F.lit(2.0**53)).alias("drawn"),
    ]


def labelled(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """doc_id and the labels of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *labels(topic, tokens))


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """(dimension, target): shares to a power."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("part"))
    return sums.crossJoin(sums.agg(F.sum("part").alias("whole"))).select(dimension, (F.col("part") / F.nullif("whole", F.lit(0.0))).alias("target"))


def first_of(d: str) -> Column:
    """Whether a cell is the first of its category of d."""
    return F.row_number().over(W.partitionBy(d).orderBy(*[x for x in DIMENSIONS if x != d])) == 1


def targeted(cells: DataFrame, d: str, power: float = TEMPER) -> DataFrame:
    """cells in one task with to_d: the share of their category to a power, as rake() has it of tempered(), without joins."""
    every = W.partitionBy()
    once = lambda c: F.nullif(F.sum(F.when(F.col("first"), F.col(c))).over(every), F.lit(0.0))
    cells = cells.withColumns({"part": F.pow(F.sum("tokens").over(W.partitionBy(d)).cast("double"), F.lit(power)), "first": first_of(d)})
    cells = cells.withColumn("target", F.coalesce(F.col("part") / once("part"), F.lit(0.0)))
    return cells.withColumn(f"to_{d}", F.col("target") / once("target")).drop("part", "first", "target")


def swept(cells: DataFrame, few: bool) -> DataFrame:
    """cells after one sweep over the dimensions, with the most that a factor of each moved."""
    cells = cells.withColumn("moved", F.lit(0.0))
    for d in DIMENSIONS:
        if few:
            cells = cells.withColumn("now", F.sum("weight").over(W.partitionBy(d)))
        else:
            cells = cells.join(cells.groupBy(d).agg(F.sum("weight").alias("now")), d)
        factor = F.coalesce(F.col(f"to_{d}") / F.nullif("now", F.lit(0.0)), F.lit(1.0))
        cells = cells.withColumn("factor", factor).drop("now")
        cells = cells.withColumns({"weight": F.col("weight") * F.col("factor"), "moved": F.greatest("moved", F.abs(F.col("factor") - 1))}).drop("factor")
    return cells


def rake(cells: DataFrame, targets: dict[str, DataFrame], close: float = CLOSE, sweeps: int = SWEEPS) -> DataFrame:
    """cells with weight, whose sums have the target shares of every dimension; of a dimension without targets, those of tempered().

    Categories without target keep no weight; targets of categories without cells are ignored and the others rescaled. A warning
    tells how far a factor still moves after the last sweep: where empty cells leave no solution, the sums only come close.
    """
    few = cells.count() <= FEW
    share = F.coalesce(F.col("tokens") / F.nullif(F.col("all").cast("double"), F.lit(0.0)), F.lit(0.0))
    given = cells
    if few:
        cells = cells.coalesce(1).withColumn("all", F.sum("tokens").over(W.partitionBy()))
    else:
        cells = cells.crossJoin(cells.agg(F.sum("tokens").alias("all")))
    cells = cells.withColumn("weight", share).drop("all")
    for d in DIMENSIONS:
        if few and targets.get(d) is None:
            cells = targeted(cells, d)
            continue
        goal = tempered(given, d) if targets.get(d) is None else targets[d]
        own = given.select(d).distinct().join(goal, d, "left").select(d, F.coalesce("target", F.lit(0.0)).alias("target"))
        goal = own.crossJoin(own.agg(F.sum("target").alias("whole"))).select(d, (F.col("target") / F.nullif("whole", F.lit(0.0))).alias(f"to_{d}"))
        cells = cells.join(goal, d)
    cells = cells.dropna(subset=list(DIMENSIONS)) if few else durable(cells)
    done, moved = 0, [0.0]
    while done < sweeps:
        together = min(TOGETHER if few else 1, sweeps - done)
        rows = cells.coalesce(1) if few else cells
        for k in range(together):
            rows = swept(rows, few).withColumns({f"weight_{k}": F.col("weight"), f"moved_{k}": F.col("moved")})
        rows = durable(rows.drop("weight", "moved"))
        most = rows.agg(*[F.max(F.when(F.col(f"weight_{k}") > 0, F.col(f"moved_{k}"))) for k in range(together)]).first()
        moved = [x or 0.0 for x in most]
        # the sweeps after the first that moves no factor don't count
        last = next((k for k, x in enumerate(moved) if x <= close), together - 1)
        cells = rows.select(*cells.drop("weight").columns, F.col(f"weight_{last}").alias("weight"))
        if moved[last] <= close:
            break
        done += together
    else:
        warnings.warn(f"raking did not converge in {sweeps} sweeps: a factor still moves by {moved[-1]:.2g}", stacklevel=2)
    return cells.select(*DIMENSIONS, "tokens", "weight")


def calibrated(cells: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """cells with probability: proportional to weight over tokens, at most 1, of so many tokens in expectation.

    A cell that would need more than all its documents is drawn whole, and the rest share what is left.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    cells = cells.withColumn("ratio", ratio)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = None
    while True:
        whole = F.lit(False) if scale is None else F.col("ratio") * scale >= 1
        full, rest = cells.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("weight")))).first()
        new = (fraction * total - (full or 0)) / rest if rest else scale or 0.0
        if scale is not None and new <= scale * (1 + 1e-12):
            break
        scale = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * scale)).drop("ratio")


def mixed_cells(rows: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, **raking: float) -> DataFrame:
    """The cells of labelled() rows with weight (per token) and probability, as a small written table."""
    cells = durable(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    per_token = (F.col("weight") / F.greatest("tokens", F.lit(1))).alias("weight")
    return durable(calibrated(rake(cells, targets or {}, **raking), fraction).select(*DIMENSIONS, per_token, "probability"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, topic: Column | None = None, tokens: Column | None = None, **raking: float) -> DataFrame:
    """Each row's cell, tokens, weight, probability and whether it is drawn. raking: close and sweeps of rake().

    A null text is empty (no tokens, so weight 0 unless its cell has other texts); a null source or language is the category
    "unknown"; a null doc_id stays null; repeated rows are drawn alike; other columns are not read; no rows give no rows.
    """
    rows = durable(labelled(docs, topic, tokens))
    drawn = rows.join(mixed_cells(rows, targets, fraction, **raking), list(DIMENSIONS)).withColumn("sampled", F.col("drawn") < F.col("probability"))
    return drawn.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "sampled")


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, topic: Column | None = None, tokens: Column | None = None, **raking: float) -> DataFrame:
    """The rows of docs that are drawn, in docs' columns.

    The rows are written with their labels once; only the cells are joined, so texts stay where they are.
    """
    names = docs.columns
    rows = durable(docs.select(F.struct(*names).alias("row"), *labels(topic, tokens)))
    cells = mixed_cells(rows.select(*DIMENSIONS, "n_tokens"), targets, fraction, **raking)
    kept = rows.select("row", *DIMENSIONS, "drawn").join(cells, list(DIMENSIONS)).filter(F.col("drawn") < F.col("probability"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in names])
