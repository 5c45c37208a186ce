"""Command line: detect, info, validate and export audit files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from auditloom import __version__
from auditloom.operators.export import FORMATS, export
from auditloom.operators.totals import control_totals
from auditloom.plans.file_tables import FileTables
from auditloom.plans.validate import validate
from auditloom.sources.catalogue import catalogue
from auditloom.sources.ledger import open_files


def main(arguments: list[str] | None = None) -> int:
    """0: fine; 1: findings; 2: wrong use; 3: a file that can't be read."""
    parser = argparse.ArgumentParser(prog="auditloom")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("detect", "info", "validate", "export"):
        command = commands.add_parser(name)
        command.add_argument("paths", nargs="+")
        command.add_argument("--encoding")
        command.add_argument("--repair", action="append", default=[])
        if name == "validate":
            command.add_argument("--rules", choices=["vts"])
            command.add_argument("--strict", action="store_true", help="warnings count as well")
            command.add_argument("--max-findings", type=int, default=100, help="listed for each code")
            command.add_argument("-o", "--output", help="a file for the report")
            command.add_argument("--text", action="store_true", help="a report as text")
            command.add_argument("--schema", action="append", default=[], metavar="VERSION=FILE", help="the schema file of a version")
        if name == "export":
            command.add_argument("-o", "--output", required=True)
            command.add_argument("-f", "--format", choices=FORMATS, default="csv")
            command.add_argument("-t", "--table", action="append")
            command.add_argument("--one-file", action="store_true", help="one file for each table")
            command.add_argument("--negative-amounts", choices=["flip", "abs"], default="flip")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("auditloom").getOrCreate()
    given = dict(x.partition("=")[::2] for x in getattr(args, "schema", []))
    files = open_files(spark, args.paths, encoding=args.encoding, repair=frozenset(args.repair), elements=bool(given))
    kinds = files.files.collect()
    bad = files.notes.filter("code in ('XAF1021', 'XAF2002')").limit(1000).collect()
    if args.command == "detect":
        print(json.dumps([r.asDict() for r in kinds], indent=1))
        return 3 if bad or not kinds else 0
    if bad or not kinds:
        print(json.dumps([r.asDict() for r in bad]), file=sys.stderr)
        return 3
    fixed = {r.family for r in kinds} == {"ADF"}
    if args.command == "validate":
        report = validate(files, rules=args.rules, per_code=args.max_findings, fixed_width=fixed, schemas={v: catalogue(spark, path) for v, path in given.items()})
        said = report.to_text() if args.text else report.to_json()
        if args.output:
            Path(args.output).write_text(said, "utf-8")
        else:
            print(said)
        return int((report.max_severity or 0) >= (20 if args.strict else 30))
    ledger = files.fixed_width() if fixed else files.ledger()
    if args.command == "info":
        row = control_totals(ledger.lines).first().asDict()
        print(json.dumps({"files": [r.asDict() for r in kinds], "transactions": ledger.transactions.count()} | {k: str(v) for k, v in row.items()}))
        return 0
    print(*export(ledger if fixed else FileTables(files, args.negative_amounts).all(), args.output, args.format, args.table, args.one_file))
    return 0


if __name__ == "__main__":
    sys.exit(main())
