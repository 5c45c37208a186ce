"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a cluster must name; only where driver and executors are one process a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows of df from a table in the shared folder: made once, and kept if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
