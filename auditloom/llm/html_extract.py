"""Main-text extraction: gradient-boosted trees over DOM nodes, and hierarchical decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm import html_training
from auditloom.llm.html_nodes import features, main_text, parse

#: trees, their depth, and characters of pages whose nodes are scored together
TREES, DEPTH, AT_ONCE = 25, 5, 4_000_000
Trees = list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def flat(weight: float, tree) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A fitted tree as arrays: feature (-1 at leaves), threshold or value, left and right child."""
    feature: list[int] = []
    value: list[float] = []
    left: list[int] = []
    right: list[int] = []

    def add(node) -> int:
        k = len(feature)
        leaf = node.subtreeDepth() == 0
        feature.append(-1 if leaf else node.split().featureIndex())
        value.append(node.prediction() if leaf else node.split().threshold())
        left.append(k)
        right.append(k)
        if not leaf:
            left[k] = add(node.leftChild())
            right[k] = add(node.rightChild())
        return k

    add(tree._call_java("rootNode"))
    return weight, np.array(feature), np.array(value), np.array(left), np.array(right)


@lru_cache(maxsize=2)
def fitted(spark: SparkSession, pages: int = html_training.PAGES, seed: int = html_training.SEED) -> Trees:
    """The model, fitted by Spark once a session on so many generated pages; their nodes are made and kept on the executors."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                page, label = html_training.labelled_page(seed * 1_000_003 + k)
                x = features([page])
                yield pa.RecordBatch.from_arrays([pa.array(list(x)), pa.array(np.array(label, float))], names=["x", "label"])

    rows = spark.range(pages).repartition(8).mapInArrow(nodes, "x array<double>, label double")
    rows = rows.select(array_to_vector("x").alias("features"), "label").persist()
    try:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed, maxBins=64).fit(rows)
    finally:
        rows.unpersist()
    return [flat(w, t) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def chances(trees: Trees, x: np.ndarray) -> np.ndarray:
    """The chance of each node to hold main text."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for weight, feature, value, left, right in trees:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            at = np.where((f < 0) | (x[rows, f] <= value[at]), left[at], right[at])
        total += weight * value[at]
    return 1 / (1 + np.exp(-2 * total))


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row.

    A null or empty html, or one without main text, has an empty text; a null page_id or url stays null; repeated rows are
    extracted each; other columns are not read; no rows give no rows. A narrow, row-wise job: nothing is shuffled.
    """
    trees = trees or fitted(pages.sparkSession)
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                parsed, held, at = [], 0, first
                while at < batch.num_rows and held < AT_ONCE:
                    html = batch.column(2)[at].as_py()
                    parsed.append(parse(html))
                    held += len(html) + 1
                    at += 1
                chance = chances(trees, features(parsed))
                ends = np.cumsum([len(p.parent) for p in parsed])
                texts = [main_text(p, chance[e - len(p.parent) : e]) for p, e in zip(parsed, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, at - first) for c in batch.columns[:2]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )
                first = at

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(extracted, schema)
