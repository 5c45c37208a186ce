"""Whole-number vectors in shards and blocks, and the work of every block of asked vectors on every shard.

Vectors are dealt by a hash of their id into shards of a few megabytes, asked ones into blocks of as much, and each is packed into
one row. A cell is one block against one shard: what it needs is bounded whatever the data, and cells are what Spark deals to tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes of components in a shard, and in a block
SHARD_BYTES = 4 << 20
#: Scores beyond this are cut to it: 64 bits hold twice as much.
LIMIT = 1 << 61
EXACT = float(1 << 53)
CELLS = 20_000
PACKED = "dim int, part int, ids binary, vectors binary"


def whole(rows: DataFrame, scale: int, vector: Column | None = None, label: Column | None = None) -> DataFrame:
    """vec_id, label and v, the components floor(scale * x), of the rows that have an id, a vector of finite components, and a label.

    Without a label column every label is 0. Of rows that share an id the least counts, so equal rows count once. Scaled components
    beyond 64 bits are cut to them.
    """
    vector = F.col("embedding") if vector is None else vector
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.lit(0) if label is None else label).cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select("vec_id", "label", scaled.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with dim and part, and the number of parts: by bytes, so that a part of any dimension is bounded."""
    bytes_ = rows.agg(F.sum(F.size("v").cast("long") * 8 + 16)).first()[0] or 0
    parts = max(1, -(-bytes_ // SHARD_BYTES))
    return rows.select("*", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")), parts


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """An array column of dim components a row, as a matrix."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def packed(rows: DataFrame, pack: Callable[[pa.Table, int], dict], schema: str) -> DataFrame:
    """One row for each part of dealt() rows: what pack makes of the part's rows in the order of their ids, beside dim and part."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        dim, part = (x.as_py() for x in key)
        made = pack(table.sort_by("vec_id"), dim)
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int32()), **{k: pa.array([v if isinstance(v, bytes) else v.tobytes()], pa.binary()) for k, v in made.items()}})

    return rows.groupBy("dim", "part").applyInArrow(one, schema)


def plain(table: pa.Table, dim: int) -> dict:
    return {"ids": table["vec_id"].to_numpy().astype(np.int64), "vectors": matrix(table["v"], dim)}


def cells(shards: DataFrame, n_shards: int, blocks: DataFrame, n_blocks: int, work: Callable[[dict, dict], pa.Table], schema: str, first: int = 0) -> DataFrame:
    """The rows that work makes of every pair of a shard, from the first to before n_shards, and a block of the same dimension.

    work gets both packed rows as dictionaries.
    """
    chosen = shards.filter(F.col("part").between(first, n_shards - 1)).withColumnRenamed("part", "shard")
    left = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    right = blocks.withColumnRenamed("part", "block").select("*", F.explode(F.sequence(F.lit(first), F.lit(n_shards - 1))).alias("shard"))
    key = ["dim", "shard", "block"]
    number = min(CELLS, 2 * (n_shards - first) * n_blocks)

    def cell(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not len(shard) or not len(block):
            return work({}, {})
        return work(shard.to_pylist()[0], block.to_pylist()[0])

    return left.repartition(number, *key).groupBy(*key).cogroup(right.repartition(number, *key).groupBy(*key)).applyInArrow(cell, schema)


def numbers(blob: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(blob, kind)


def vectors_of(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]) if row["dim"] else np.zeros((len(row["ids"]) // 8, 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exactly.

    Where the product of two norms is below 2^53, so is every partial sum, and a product of matrices is exact; the few other pairs
    are summed in numbers of any size.
    """
    out = a @ b.T
    one, two = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    if len(one) and len(two) and one.max() * two.max() * 1.001 >= EXACT:
        far = np.outer(one, two) * 1.001 >= EXACT
        out = np.where(far, 0.0, out).astype(np.int64)
        for i, j in zip(*np.nonzero(far), strict=True):
            out[i, j] = max(-LIMIT, min(LIMIT, sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))))
        return out
    return out.astype(np.int64)
