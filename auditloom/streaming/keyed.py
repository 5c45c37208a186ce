"""Rules that need what earlier micro-batches held: duplicate ids and declared totals of files whose records arrive over time.

Rows are those of sources.records. Once all of a file's records have arrived, in whatever order and batches, the findings are those
of plans.validate over the same rows. State is kept by key in the checkpoint, so it outlives an executor and a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from auditloom.functions.values import clean, parse_amount, parse_int
from auditloom.operators import findings as O
from auditloom.plans.validate import ERROR, MASTERS, SECTIONS, WARNING, WIDE, of_declared, say
from auditloom.sources.ledger import field

#: The state store that keyed state of this kind needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
PLACE = "ord long, line int, path string"
KEY, AT = ["code", "file", "scope", "id"], ["ord", "line", "path"]


class Later(StatefulProcessor):
    """Every row of a key but the one that comes first in its file.

    The state is the first place met so far: a row before it takes its place, and the one that was held is told instead. So the
    rows told in the end don't depend on the order of arrival, and a key holds one place however often it occurs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", PLACE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = tuple(self.first.get()) if self.first.exists() else None
        for r in rows:
            place = (r["ord"], r["line"], r["path"])
            if held is None:
                held = place
                continue
            held, told = (place, held) if place[0] < held[0] else (held, place)
            yield Row(**dict(zip([*KEY, *AT], [*key, *told], strict=True)))
        self.first.update(held)

    def close(self) -> None:
        pass


def keys_of(rows: DataFrame, older: bool = False) -> DataFrame:
    """(code, file, scope, id, ord, line, path) of all that must not be defined twice within a scope of its file.

    Transactions are numbered within the journal of their id, or, in the older XML family, within the file; the journal of a transaction
    may arrive after it.
    """
    at = ["file", *AT]
    none = F.lit("")
    each = [F.when(F.col("kind") == kind, F.struct(F.lit(code).alias("code"), field(*names.split()).alias("id"))) for kind, names, code, _ in MASTERS]
    each.append(F.when(F.col("kind") == "ledgerAccount", F.struct(F.lit("XAF6003").alias("code"), field("RGScode").alias("id"))))
    if older:
        each.append(F.when(F.col("kind") == "transaction", F.struct(F.lit("XAF6004").alias("code"), field("nr", "transactionID").alias("id"))))
    made = rows.select(*at, F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.code", "file", none.alias("scope"), "x.id", "ord", "line", "path")
    if not older:
        journals = rows.filter("kind = 'journal'").select("file", F.col("ord").alias("up"), F.coalesce(field("jrnID", "journalID"), none).alias("scope"))
        numbers = rows.filter("kind = 'transaction'").select(*at, "up", field("nr", "transactionID").alias("id")).filter("id is not null")
        made = made.unionByName(numbers.join(journals, ["file", "up"]).select(F.lit("XAF6004").alias("code"), "file", "scope", "id", "ord", "line", "path"))
    return made.filter("id is not null")


def duplicates(rows: DataFrame, older: bool = False) -> DataFrame:
    """Findings of ids that arriving records define again (6001-6004, 6007-6009); append mode.

    The session must keep state in RocksDB (STORE). What a key holds is one place; transactions and journals are also kept by the
    join that tells a transaction its journal.
    """
    types = "code string, file string, scope string, id string, " + PLACE
    told = keys_of(rows, older).groupBy(*KEY).transformWithState(Later(), types, "append", "none")
    id_, code = F.col("id"), F.col("code")
    rules = [(code == c, c, severity, say(f"{kind} defined again:", id_), id_) for kind, _, c, severity in MASTERS]
    rules.append((code == "XAF6003", "XAF6003", WARNING, say("reference code used again:", id_), id_))
    rules.append((code == "XAF6004", "XAF6004", ERROR, say("transaction number occurs again:", id_), id_))
    pathless = F.when(~code.isin("XAF6003", "XAF6004"), F.col("path"))
    return O.several(told, rules, file=F.col("file"), line=F.col("line"), path=pathless)


def declared_totals(rows: DataFrame, section: str = "transactions") -> DataFrame:
    """Findings of a section's declared totals against all that has arrived; update or complete mode.

    One row of state a file: sums of either side to eight decimals, the count, and the first declaration. The last findings of a file
    hold, and before all its records are there they may be of the part that is. A built-in aggregate, so that partial sums are made
    before the shuffle.
    """
    kinds, codes = SECTIONS[section]
    text = lambda name: clean(F.try_element_at("fields", F.lit(name)))
    is_line = F.col("kind").isin(*kinds)

    def side(mark: str, own: str) -> Column:
        zero = F.lit(0).cast(WIDE)
        amounts = F.when(F.upper(text("amntTp")) == mark, parse_amount(text("amnt"))), parse_amount(text(own))
        return F.coalesce(F.sum(F.when(is_line, F.coalesce(amounts[0].cast(WIDE), zero) + F.coalesce(amounts[1].cast(WIDE), zero))), F.lit(0)).cast(WIDE)

    head = F.struct("ord", "line", parse_int(field("linesCount", "numberEntries")).alias("count"), parse_amount(field("totalDebit")).alias("debit"), parse_amount(field("totalCredit")).alias("credit"))
    both = rows.filter(is_line | (F.col("kind") == section)).groupBy("file").agg(
        F.min(F.when(F.col("kind") == section, head)).alias("head"), F.count(F.when(is_line, 1)).alias("n"), side("D", "debitAmount").alias("d"), side("C", "creditAmount").alias("c")
    )
    return of_declared(both.filter("head is not null").select("file", "head.*", "n", "d", "c"), section, codes)
