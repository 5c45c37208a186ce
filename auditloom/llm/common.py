"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009..U+000D.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: folders of the tables that durable() wrote in this session
WRITTEN: list[str] = []
#: Whether the files that a query's shuffles leave on the executors' disks go when it ends; else they stay until the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which a cluster must name.

    Only where driver and executors are one process, a folder of this machine stands in for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The rows of df from a table written to the shared folder, so that a lost executor costs no recomputation.

    Unlike checkpoint() this makes the rows once, and keeps column pruning, compression and a known size. Nothing reads the
    shuffles of the query that made the rows any more, so their files go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    WRITTEN.append(path)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, first: int = 0, keep: int = 0) -> None:
    """Deletes the tables that durable() wrote in this session, from the first-th on but for the last ones to keep; frames that
    read them can't be used any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = WRITTEN[first : len(WRITTEN) - keep]
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    WRITTEN[:] = [x for x in WRITTEN if x not in gone]


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text, in order."""
    return F.array_remove(F.split(text, GAP), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of one key are dealt by a number below this.
SALTS = 4096


def salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int").alias("salt")


def told_of(parts: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """values by keys for every (keys, salt) of parts: rows then meet them by keys and salt, so a frequent key is no large task."""
    return parts.select(*keys, "salt").join(values, keys)
