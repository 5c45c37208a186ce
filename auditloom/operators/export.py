"""Sinks: the tables of a ledger as CSV, JSON lines or Parquet, one folder for each table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.operators import tables
from auditloom.plans.frames import Ledger

FORMATS = ("csv", "jsonl", "parquet")


#: what rows of a table are written in the order of
ORDER = {"line_vat": ["line_seq", "index"], "addresses": ["owner_type", "owner_id", "seq"]}


def tables_of(ledger: Ledger) -> dict[str, DataFrame]:
    """The tables that the frames of any ledger give; those of parsed files, with all their columns, are FileTables.all()."""
    return {
        "header": ledger.header.drop("file", "ord"),
        "accounts": tables.accounts(ledger),
        "relations": tables.relations(ledger),
        "vat_codes": ledger.vat_codes.drop("file", "line"),
        "periods": tables.periods(ledger),
        "journals": tables.journals(ledger),
        "transactions": tables.transactions(ledger),
        "lines": tables.lines(ledger),
        "line_vat": tables.line_vat(ledger),
    }


def text_decimals(df: DataFrame) -> DataFrame:
    """Decimals as exact text, for formats without them."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


def write(df: DataFrame, path: str, kind: str, one_file: bool = False, order: list[str] | None = None) -> None:
    """null is an empty CSV field and a JSON null; rows stay in as many files as Spark has partitions unless one is asked for.

    With an order the files, by name, and the rows in them are in that order: Spark sorts by ranges.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}, not one of {FORMATS}")
    if order:
        df = df.coalesce(1).sortWithinPartitions(*order) if one_file else df.orderBy(*order)
    elif one_file:
        df = df.coalesce(1)
    writer = (df if kind == "parquet" else text_decimals(df)).write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True, nullValue="", emptyValue="", escape='"', lineSep="\r\n")
    elif kind == "jsonl":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)


def export(source: Ledger | dict[str, DataFrame], folder: str, kind: str = "csv", names: Iterable[str] | None = None, one_file: bool = False) -> list[str]:
    """Writes the named tables (all by default) below folder; an unknown name is a KeyError before anything is written.

    source: a ledger, or tables by name such as the twelve of FileTables.all(). Tables with ordinals are written in their order.
    """
    all_ = source if isinstance(source, dict) else tables_of(source)
    chosen = list(all_) if names is None else list(names)
    if missing := [n for n in chosen if n not in all_]:
        raise KeyError(f"unknown tables: {missing}")
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}, not one of {FORMATS}")
    for name in chosen:
        columns = all_[name].columns
        order = ["seq"] if columns[0] == "seq" else ORDER.get(name, []) if isinstance(source, dict) else []
        write(all_[name], f"{folder}/{name}", kind, one_file, order)
    return chosen
