"""What operators leave on disk while they go on: neither shuffles of finished queries nor tables that nothing reads again."""

import time

from pyspark.sql import functions as F

from auditloom.llm import substrings
from auditloom.llm.common import SHUFFLES_GO, WRITTEN, durable


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(files.size()) if (n := files.apply(k).getName()).startswith("shuffle_")}


def test_shuffles_go_with_the_query_of_a_table(spark):
    was, before = spark.conf.get(SHUFFLES_GO), shuffle_files(spark)
    rows = durable(spark.range(50_000).groupBy((F.col("id") % 9000).alias("k")).count())
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert rows.count() == 9000
    assert spark.conf.get(SHUFFLES_GO) == was


def test_repeats_leave_one_table(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, "x" + text), (3, text[7:200] + "!"), (4, "few")], "doc_id long, text string")
    before = len(WRITTEN)
    out = substrings.remove_repeats(docs)
    assert len(WRITTEN) == before + 1
    removed = {r.doc_id: r.n_removed for r in out.collect()}
    assert removed == {1: 0, 2: len(text), 3: 193, 4: 0}
