"""Records that arrive over time, in any order, give the findings of the whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditloom.plans.validate import all_findings
from auditloom.sources.ledger import open_files
from auditloom.streaming import keyed

from .test_sources import GOOD, audit_file
from .test_validate import CLAIR2, OPENING

DUPLICATES = ["XAF6001", "XAF6002", "XAF6003", "XAF6004", "XAF6007", "XAF6008", "XAF6009"]
COLUMNS = ["code", "severity", "message", "file", "line", "path", "value"]


def ran(spark, found, mode: str, name: str, folder) -> list[tuple]:
    query = found.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(200) and query.exception() is None
        assert len({p["batchId"] for p in query.recentProgress}) >= 4
    finally:
        query.stop()
    return sorted(map(repr, spark.table(name).select(*COLUMNS).collect()))


@pytest.fixture
def store(spark):
    for k, v in keyed.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in keyed.STORE:
        spark.conf.unset(k)


def arriving(spark, rows, folder):
    """The rows dealt to five micro-batches by a hash, so that later records come before earlier ones."""
    for k in range(5):
        rows.filter(F.pmod(F.xxhash64("file", "ord", F.lit(11)), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def batch(files, codes) -> list[tuple]:
    return sorted(map(repr, all_findings(files).filter(F.col("code").isin(*codes)).select(*COLUMNS).collect()))


def test_stream_and_batch_tell_the_same(spark, store, tmp_path):
    clean = audit_file(GOOD).replace("<transactions>", OPENING + "<transactions>").replace("><", ">\n<")
    body = clean[clean.index("<transaction>\n") : clean.index("</transaction>") + len("</transaction>")]
    account = clean[clean.index("<ledgerAccount>") : clean.index("</ledgerAccount>") + len("</ledgerAccount>")]
    source = tmp_path / "files"
    source.mkdir()
    (source / "a.xaf").write_text(clean)
    (source / "b.xaf").write_text(clean.replace(body, body * 3).replace(account, account * 3))
    (source / "c.xaf").write_text(clean.replace("<totalDebit>10.00", "<totalDebit>12.00").replace("<amnt>5.00", "<amnt>5.50", 1))
    files = open_files(spark, str(source))
    rows = arriving(spark, files.rows, tmp_path / "rows")
    want = batch(files, DUPLICATES)
    assert sum("XAF6004" in x for x in want) == 2 and sum("XAF6002" in x for x in want) == 2
    assert ran(spark, keyed.duplicates(rows), "append", "arriving_duplicates", tmp_path) == want
    for section, (_, codes) in keyed.SECTIONS.items():
        want = batch(files, [c for c in codes if c])
        assert want and ran(spark, keyed.declared_totals(rows, section), "complete", f"arriving_{section}", tmp_path) == want


def test_the_older_form(spark, store, tmp_path):
    (tmp_path / "a.xml").write_text(CLAIR2.replace("<debitAmount>3.50", "<debitAmount>3.75"))
    files = open_files(spark, str(tmp_path / "a.xml"))
    rows = arriving(spark, files.rows, tmp_path / "rows")
    want = batch(files, ["XAF5007", "XAF5008", "XAF5009", "XAF5012"])
    assert want and ran(spark, keyed.declared_totals(rows), "complete", "older_totals", tmp_path) == want
    assert ran(spark, keyed.duplicates(rows, older=True), "append", "older_duplicates", tmp_path) == batch(files, DUPLICATES)
