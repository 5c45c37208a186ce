"""Audit files as a Spark data source: spark.read.format("auditfile").load(path).

Filters on kind and file are pushed into the source. A file that no filter allows is not opened; where only what files are is asked
for, the first bytes of a plain file are read; and with kinds, the parser collects text inside records of these kinds only and
makes no other rows. The files are listed and read by Arrow's file systems, one a task; what a very large document needs is
records.read, which parses it in ranges.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from auditloom.sources import content, formats, records

HEAD = 1 << 16


@dataclass
class OneFile(InputPartition):
    name: str
    path: str


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before the path in a file's name)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.abspath(path), "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else path.partition("://")[0] + "://"


def listed(path: str) -> list[tuple[str, str]]:
    """(name, path in its file system) of a file, of the files of a folder, or of those that a pattern matches."""
    system, inside, before = opened(path)
    if any(c in inside for c in "*?["):
        fixed = inside[: min(inside.index(c) for c in "*?[" if c in inside)].rpartition("/")[0]
        deep = inside.count("/")
        found = system.get_file_info(fs.FileSelector(fixed, recursive=True, allow_not_found=True))
        names = [x.path for x in found if x.is_file and x.path.count("/") == deep and fnmatch.fnmatchcase(x.path, inside)]
    else:
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        names = [inside] if info.is_file else [x.path for x in system.get_file_info(fs.FileSelector(inside)) if x.is_file]
    return sorted((before + n, n) for n in names if not posixpath.basename(n).startswith(("_", ".")))


class AuditReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("auditfile needs a path")
        self.encoding = options.get("encoding")
        self.repair = frozenset(x.strip() for x in options.get("repair", "").split(",") if x.strip())
        if unknown := self.repair - content.REPAIRS:
            raise ValueError(f"unknown repairs: {sorted(unknown)}")
        self.most = int(options["max_decompressed_size"]) if "max_decompressed_size" in options else None
        self.elements = options.get("elements", "false").lower() == "true"
        self.allowed: dict[str, frozenset[str] | None] = {"kind": None, "file": None}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities and lists of values of kind and file; gives the others back."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column not in self.allowed:
                yield f
                continue
            before = self.allowed[column]
            self.allowed[column] = frozenset(values) if before is None else before & values

    def partitions(self) -> list[OneFile]:
        files = self.allowed["file"]
        found = [OneFile(name, inside) for name, inside in listed(self.path) if files is None or name in files]
        if self.allowed["kind"] == frozenset():
            found = []
        return found or [OneFile("", "")]  # Spark asks for a partition at least

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        kinds = self.allowed["kind"]
        system, _, _ = opened(partition.name)
        with system.open_input_file(partition.path) as stream:
            head = stream.read(HEAD)
            plain = head[:2] not in (b"\x1f\x8b", b"PK") and head[:4] != content.CABINET and not partition.name.lower().endswith(content.ENCRYPTED)
            if kinds == {records.FILE} and plain:
                rows: Iterator[records.Row] = self.only_head(partition.name, head)
            else:
                data = head + stream.read()
                wanted = None if kinds is None or records.LEAF in kinds else frozenset(kinds)
                rows = records.parse_file(partition.name, data, self.encoding, self.repair, self.most, self.elements, None, wanted)
        yield from records.batches_of(r for r in rows if kinds is None or r[1] in kinds)

    def only_head(self, name: str, head: bytes) -> Iterator[records.Row]:
        adf = formats.ADF_MARK in head[:64]
        text, used, _ = (head, self.encoding or "cp1252", []) if adf else content.utf8(head, self.encoding, self.repair)
        kind = formats.detect(text, "cp1252" if adf else "utf-8") | {"encoding": used}
        yield name, records.FILE, -1, None, None, None, {k: v for k, v in kind.items() if v is not None}


class AuditFiles(DataSource):
    """The rows of records.SCHEMA. Options: path, encoding, repair (names with commas), max_decompressed_size, elements."""

    @classmethod
    def name(cls) -> str:
        return "auditfile"

    def schema(self) -> str:
        return records.SCHEMA

    def reader(self, schema) -> AuditReader:
        return AuditReader({k.lower(): v for k, v in dict(self.options).items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AuditFiles)
