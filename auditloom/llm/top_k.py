"""Exact search of the largest inner products: a ball tree in each shard, branch and bound, and a kth score that shards share.

Every shard holds a balanced tree of balls; no vector of a ball has a larger product with a query q than q . centre + |q| * radius.
A query meets a shard's leaves in the order of that bound and leaves them once the bound is below its kth score. Shards are taken in
waves, each eight times as many as all before: what a wave finds raises the kth score that the next one starts from. As shards
are random parts of the rows, a wave finds about eight times k rows for a query that beat its kth score, however many shards it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm import vectors as V
from auditloom.llm.common import durable

LEAF = 128
#: shards of the first wave, and how many times all before the next one has
FIRST, WAVE = 2, 8
TREE = f"{V.PACKED}, starts binary, ends binary, left_child binary, centres binary, radii binary"
BLOCK = f"{V.PACKED}, floors binary, lasts binary"
FOUND = "query_id long, vec_id long, score long"


def ball_tree(ids: np.ndarray, rows: np.ndarray) -> dict:
    """Rows in the order of the leaves, and the nodes: the rows each holds, its left child (0: a leaf; the right one follows), its ball."""
    order, spans, left, centres, radii = np.arange(len(rows)), [(0, len(rows))], [], [], []
    for start, end in spans:
        own = rows[order[start:end]]
        centre = own.mean(0)
        away = ((own - centre) ** 2).sum(1)
        centres.append(centre)
        radii.append(np.sqrt(away.max()))
        if end - start <= LEAF:
            left.append(0)
            continue
        one = own[away.argmax()]
        two = own[((own - one) ** 2).sum(1).argmax()]
        middle = (end - start) // 2
        order[start:end] = order[start:end][np.argpartition(own @ (two - one), middle)]
        left.append(len(spans))
        spans += [(start, start + middle), (start + middle, end)]
    starts, ends = np.array(spans, np.int64).T.copy()
    return {"ids": ids[order], "vectors": rows[order], "starts": starts, "ends": ends, "left_child": np.array(left, np.int64), "centres": np.array(centres), "radii": np.array(radii)}


def planted(table: pa.Table, dim: int) -> dict:
    part = V.plain(table, dim)
    return ball_tree(part["ids"], part["vectors"])


def asked(table: pa.Table, dim: int) -> dict:
    """A block: its queries with the kth score and id that a row must beat."""
    return V.plain(table, dim) | {"floors": table["floor"].to_numpy().astype(np.int64), "lasts": table["last"].to_numpy().astype(np.int64)}


def better(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row by falling score, then rising id."""
    place = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, place, 1), np.take_along_axis(ids, place, 1)


def search(tree: dict, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, lasts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of rows of the tree that beat (floor, last) and are among the query's first k of this tree."""
    size = np.sqrt((queries * queries).sum(1))
    reach = tree["radii"] + 1e-9 * (tree["radii"] + np.sqrt((tree["centres"] ** 2).sum(1)))  # more than rounding can take away
    upper = np.maximum(queries @ tree["centres"].T + np.outer(size, reach), -V.LIMIT)
    # a node lives for the queries that its parent lives for and whose kth score its bound reaches
    alive = np.zeros(upper.shape, bool)
    alive[:, 0] = upper[:, 0] >= floors
    for node, child in enumerate(tree["left_child"]):
        if child and alive[:, node].any():
            alive[:, child : child + 2] = alive[:, node, None] & (upper[:, child : child + 2] >= floors[:, None])
    leaves = np.flatnonzero(tree["left_child"] == 0)
    upper = np.where(alive[:, leaves], upper[:, leaves], -np.inf)
    turn = np.argsort(-upper, axis=1, kind="stable")
    best, names = np.full((len(queries), k), -(2**62)), np.full((len(queries), k), 2**63 - 1)
    floors, lasts = floors.copy(), lasts.copy()
    for step in range(len(leaves)):
        bound = upper[np.arange(len(queries)), turn[:, step]]
        going = np.flatnonzero((bound >= floors) & (bound > -np.inf))
        if not len(going):
            break
        at = turn[going, step]
        for leaf in np.unique(at):
            here, node = going[at == leaf], leaves[leaf]
            start, end = tree["starts"][node], tree["ends"][node]
            ids = np.broadcast_to(tree["ids"][start:end], (len(here), end - start))
            got = V.scores(queries[here], tree["vectors"][start:end])
            beats = (got > floors[here, None]) | ((got == floors[here, None]) & (ids < lasts[here, None]))
            beats &= ids != own[here, None]
            some = beats.any(1)
            here, got, ids, beats = here[some], got[some], ids[some], beats[some]
            if not len(here):
                continue
            got, ids = np.where(beats, got, -(2**62)), np.where(beats, ids, 2**63 - 1)
            best[here], names[here] = better(np.hstack([best[here], got]), np.hstack([names[here], ids]), k)
            full = here[best[here, -1] > -(2**62)]
            floors[full], lasts[full] = best[full, -1], names[full, -1]
    place, rank = np.nonzero(best > -(2**62))
    return place, names[place, rank], best[place, rank]


def visit(k: int):
    def work(shard: dict, block: dict) -> pa.Table:
        if not shard:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        n = len(shard["radii"]) // 8
        tree = {c: V.numbers(shard[c]) for c in ("ids", "starts", "ends", "left_child")} | {"vectors": V.vectors_of(shard), "radii": V.numbers(shard["radii"], np.float64), "centres": V.numbers(shard["centres"], np.float64).reshape(n, shard["dim"])}
        own = V.numbers(block["ids"])
        place, ids, score = search(tree, V.vectors_of(block), own, V.numbers(block["floors"]), V.numbers(block["lasts"]), k)
        return pa.table({"query_id": own[place], "vec_id": ids, "score": score})

    return work


def top_k(rows: DataFrame, asking: Column, k: int = 10, scale: int = 1024, vector: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of the largest inner product with every row that asking is true of.

    Components count as floor(scale * x). A query's own id is no candidate; ties go to the smaller vec_id; with fewer than k other
    rows all of them are returned. Rows without id or vector, or with a null or non-finite component, take no part; repeated rows
    count once, and of several rows of an id the least vector counts; vectors meet those of their own length only; columns but vec_id
    and the vector are not read; no rows give no rows. Products of any size are exact, but cut to 61 bits.
    """
    points, n_shards = V.dealt(durable(V.whole(rows, scale, vector)))
    trees = durable(V.packed(points, planted, TREE))
    queries, n_blocks = V.dealt(durable(points.filter(asking).select("vec_id", "v")))
    best = rows.sparkSession.createDataFrame([], FOUND)
    done, until = 0, min(FIRST, n_shards)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while done < n_shards:
        # a query's floor is the kth that the waves before found: a row must beat it
        kth = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"), F.col("vec_id").alias("last")) if done else None
        told = queries.join(kth, "vec_id", "left") if done else queries.withColumns({"floor": F.lit(None), "last": F.lit(None)})
        told = told.withColumns({"floor": F.coalesce("floor", F.lit(-V.LIMIT - 1)), "last": F.coalesce("last", F.lit(2**63 - 1))})
        blocks = V.packed(told, asked, BLOCK)
        found = V.cells(trees, until, blocks, n_blocks, visit(k), FOUND, first=done)
        both = found if not done else found.unionByName(best.select("query_id", "vec_id", "score"))
        best = durable(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        done, until = until, min(n_shards, until * (1 + WAVE))
    return best.select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, [floor(1024 * cast(x as double)) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
