"""Hard negatives by distributed radix selection over the whole scores of anchors.

What is asked for is always the first k rows of a window of scores, by falling score and rising id: an anchor's positives among the
rows of its label, then for each positive the rows of other labels in the window that its score opens. The pair (score, id) is read
as a number of a few digits. Each round every cell counts the rows of each open window by one digit; the sums tell the digit of
the kth row, and the next round looks within it only. Scores are never kept: a round moves counts, at most k of them for a window and
cell, since a digit beyond a cell's own kth row cannot be the kth of all. Once a digit holds few rows a window is settled, and
one last round gathers the rows up to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm import vectors as V
from auditloom.llm.common import durable

#: bits of a digit; windows that a cell holds at a time
DIGIT, TILE = 10, 256
#: A window whose kth row shares its digits with so many rows at most is settled.
FEW = 16
#: fields of a window: its number, whether labels must be equal, first and last distance of a score from the largest possible one,
#: rows still needed, digits known of distance and id, and the last (distance, id) once it is settled
FIELDS = ("w", "same", "near", "far", "need", "distance", "id", "last_distance", "last_id")
SHARD = f"{V.PACKED}, labels binary"
BLOCK = f"{SHARD}, owners binary, windows binary"
COUNTS = "anchor_id long, w long, digit long, n long"
ROWS = "anchor_id long, w long, vec_id long, score long"


def labelled(table: pa.Table, dim: int) -> dict:
    return V.plain(table, dim) | {"labels": table["label"].to_numpy().astype(np.int64)}


def asked(table: pa.Table, dim: int) -> dict:
    """A block: its anchors, and each window with the place of its anchor."""
    lists = table["windows"].combine_chunks()
    flat, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    fields = np.stack([flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in FIELDS], axis=1)
    return labelled(table, dim) | {"owners": np.repeat(np.arange(len(counts)), counts), "windows": fields}


def inside(shard: dict, block: dict, top: int):
    """Tiles of (ids of the windows' anchors, fields by name as columns, distances, ids, which rows are in each window)."""
    rows, ids, labels = V.vectors_of(shard), V.numbers(shard["ids"]), V.numbers(shard["labels"])
    anchors, own, own_labels = V.vectors_of(block), V.numbers(block["ids"]), V.numbers(block["labels"])
    owners, fields = V.numbers(block["owners"]), V.numbers(block["windows"]).reshape(-1, len(FIELDS))
    for start in range(0, len(owners), TILE):
        owner, tile = owners[start : start + TILE], fields[start : start + TILE]
        f = {name: tile[:, k, None] for k, name in enumerate(FIELDS)}
        places, which = np.unique(owner, return_inverse=True)
        distance = (top - V.scores(anchors[places], rows))[which]
        held = (labels == own_labels[owner][:, None]) == (f["same"] == 1)
        held &= (ids != own[owner][:, None]) & (distance >= f["near"]) & (distance <= f["far"])
        yield own[owner], f, distance, ids, held


def offsets(ids: np.ndarray, least: int) -> np.ndarray:
    """Ids as unsigned distances from the least one."""
    return ids.astype(np.uint64) - np.uint64(least & (2**64 - 1))


def tally(by_id: bool, shift: int, top: int, least: int):
    """Work of a cell: for each window the counts of its next digit, up to the digit of the need-th row here."""
    beyond = 1 << DIGIT

    def known(values: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        above = shift + DIGIT
        return (values >> np.uint64(above)) == (prefix.astype(np.uint64) >> np.uint64(above)) if above < 64 else np.True_

    def work(shard: dict, block: dict) -> pa.Table:
        out = []
        for own, f, distance, ids, held in inside(shard, block, top) if shard else ():
            if by_id:
                held &= distance == f["distance"]
                values = np.broadcast_to(offsets(ids, least), held.shape)
                held &= known(values, f["id"])
            else:
                values = distance.astype(np.uint64)
                held &= known(values, f["distance"])
            digit = np.where(held, ((values >> np.uint64(shift)) & np.uint64(beyond - 1)).astype(np.int32), beyond)
            need = f["need"][:, 0]
            most = min(int(need.max()), digit.shape[1])
            firsts = np.sort(np.partition(digit, most - 1, axis=1)[:, :most], axis=1)
            kth = firsts[np.arange(len(firsts)), np.minimum(need, most) - 1]
            window, place = np.nonzero((firsts < kth[:, None]) & (firsts < beyond))
            keys, counts = np.unique(np.stack([window, firsts[window, place]], axis=1), axis=0, return_counts=True)
            ends = np.flatnonzero(kth < beyond)
            window = np.concatenate([keys[:, 0], ends])
            out.append((own[window], f["w"][window, 0], np.concatenate([keys[:, 1], kth[ends]]), np.concatenate([counts, (digit[ends] == kth[ends, None]).sum(1)])))
        return pa.table({c: np.concatenate([x[k] for x in out]).astype(np.int64) if out else np.array([], np.int64) for k, c in enumerate(("anchor_id", "w", "digit", "n"))})

    return work


def gather(top: int, least: int):
    """Work of a cell: the rows of each settled window up to its last (distance, id)."""

    def work(shard: dict, block: dict) -> pa.Table:
        out = []
        for own, f, distance, ids, held in inside(shard, block, top) if shard else ():
            held &= (distance < f["last_distance"]) | ((distance == f["last_distance"]) & (offsets(ids, least) <= f["last_id"].astype(np.uint64)))
            window, place = np.nonzero(held)
            out.append((own[window], f["w"][window, 0], ids[place], top - distance[window, place]))
        return pa.table({c: np.concatenate([x[k] for x in out]).astype(np.int64) if out else np.array([], np.int64) for k, c in enumerate(("anchor_id", "w", "vec_id", "score"))})

    return work


class Selection:
    """Shards of all rows and blocks of anchors, ready for rounds."""

    def __init__(self, points: DataFrame, anchors: DataFrame):
        length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        longest = points.agg(F.max(length("v")), F.min("vec_id"), F.max("vec_id")).first()
        reach = longest[0] or 0.0
        # no score is further from 0 than this
        self.top = int(min(float(V.LIMIT), reach * reach * 1.001 + 1))
        self.least = longest[1] or 0
        dealt, self.n_shards = V.dealt(points)
        self.shards = durable(V.packed(dealt, labelled, SHARD))
        dealt, self.n_blocks = V.dealt(anchors)
        self.anchors = durable(dealt)
        digits = lambda bits: [DIGIT * k for k in reversed(range(-(-bits // DIGIT)))]
        span = (longest[2] or 0) - self.least
        self.levels = [(False, shift) for shift in digits(max(1, (2 * self.top).bit_length()))] + [(True, shift) for shift in digits(max(1, span.bit_length()))]

    def round(self, windows: DataFrame, work, schema: str) -> DataFrame:
        """What the cells make of windows (anchor_id and FIELDS)."""
        lists = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(*FIELDS)).alias("windows"))
        blocks = V.packed(self.anchors.join(lists, "vec_id"), asked, BLOCK)
        return V.cells(self.shards, self.n_shards, blocks, self.n_blocks, work, schema)

    def first(self, windows: DataFrame, k: int) -> DataFrame:
        """anchor_id, w, rank, vec_id, score: the first k rows of each window (anchor_id, w, same, near, far), all if there are fewer."""
        none, every = F.lit(0).cast("long"), F.lit(-1).cast("long")  # -1: all bits, the largest unsigned number
        fields = {"need": F.lit(k).cast("long"), "distance": none, "id": none, "last_distance": F.col("far"), "last_id": every}
        going, settled = durable(windows.withColumns(fields)), []
        for number, (by_id, shift) in enumerate(self.levels):
            if going.isEmpty():
                break
            counts = self.round(going, tally(by_id, shift, self.top, self.least), COUNTS).groupBy("anchor_id", "w", "digit").agg(F.sum("n").alias("n"))
            until = F.sum("n").over(Window.partitionBy("anchor_id", "w").orderBy("digit"))
            told = going.join(counts.withColumn("until", until), ["anchor_id", "w"], "left")
            # the digit of the row that is needed; a window with fewer rows in all keeps its end
            rank = Window.partitionBy("anchor_id", "w").orderBy((F.col("until") < F.col("need")).asc_nulls_last(), F.col("digit"))
            told = told.withColumn("turn", F.row_number().over(rank)).filter("turn = 1")
            short = F.col("until").isNull() | (F.col("until") < F.col("need"))
            digit, rest = F.shiftleft(F.col("digit"), shift), F.lit((1 << shift) - 1 if shift < 63 else (1 << 63) - 1)
            known = "id" if by_id else "distance"
            told = told.withColumns({known: F.when(short, F.col(known)).otherwise(F.col(known).bitwiseOR(digit)), "need": F.when(short, F.col("need")).otherwise(F.col("need") - F.col("until") + F.col("n"))})
            end = F.col(known).bitwiseOR(rest)
            last = {"last_distance": F.col("distance"), "last_id": end} if by_id else {"last_distance": F.least(end, F.col("far"))}
            told = told.withColumns({c: F.when(short, F.col(c)).otherwise(x) for c, x in last.items()})
            over = short | (F.col("n") <= FEW) | F.lit(number == len(self.levels) - 1)
            told = durable(told.select("anchor_id", *FIELDS, over.alias("over")))
            settled.append(told.filter("over").drop("over"))
            going = told.filter("not over").drop("over")
        ends = windows.withColumns(fields).filter("false") if not settled else settled[0]
        for more in settled[1:]:
            ends = ends.unionByName(more)
        order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
        rows = self.round(ends, gather(self.top, self.least), ROWS).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return durable(rows.select("anchor_id", "w", "rank", "vec_id", "score"))


def hard_negatives(
    rows: DataFrame, asking: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, vector: Column | None = None, label: Column | None = None
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that asking is true of; an anchor's positives are the first rows of its label, and each one's negatives the
    first rows of other labels whose score is from low to high per cent of the positive's. First is a higher score (inner product of
    components floor(scale * x)), then a smaller vec_id; an anchor is no row of its own. Where fewer rows qualify all are returned:
    none for a positive of negative score.

    Rows without id, label or vector, or with a null or non-finite component, take no part; repeated rows count once, and of several
    rows of an id the least (label, vector) counts; vectors meet those of their own length only; other columns are not read; no rows
    give no rows. Scores of any size are exact, but cut to 61 bits.
    """
    points = durable(V.whole(rows, scale, vector, F.col("label") if label is None else label))
    chosen = Selection(points, points.filter(asking))
    whole = {"w": F.lit(0), "same": F.lit(1), "near": F.lit(0), "far": F.lit(2 * chosen.top)}
    of_label = chosen.first(chosen.anchors.select(F.col("vec_id").alias("anchor_id"), *[x.cast("long").alias(c) for c, x in whole.items()]), positives)
    score = F.col("score")
    # whole hundreds and the rest apart, so that no product leaves 64 bits
    least, most = F.expr(f"{low} * (score div 100) + ({low} * (score % 100) + 99) div 100"), F.expr(f"{high} * (score div 100) + ({high} * (score % 100)) div 100")
    opened = of_label.filter((score >= 0) & (least <= most)).select("anchor_id", F.col("vec_id").alias("w"), F.lit(0).cast("long").alias("same"), (F.lit(chosen.top) - most).alias("near"), (F.lit(chosen.top) - least).alias("far"))
    of_others = chosen.first(opened, negatives).withColumnsRenamed({"w": "positive_id", "vec_id": "negative_id", "score": "negative_score"})
    scored = of_label.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return of_others.join(scored, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pairs as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score
  from v a join v c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id,
  positive_score, score as negative_score
from positives join pairs using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 3
"""
