"""From the bytes of a file to its text: decompression with a guard, encodings, and repairs that are asked for."""

from __future__ import annotations

import codecs
import gzip
import io
import re
import zipfile
import zlib

# FIXED VALUES: bounds on decompression, suffixes and magic of encrypted containers, repairs
RATIO, GRACE = 100, 1 << 20
ENCRYPTED = (".xac", ".xsc", ".xfc", ".adc")
CABINET = b"MSCF"
REPAIRS = frozenset({"control-chars", "bare-ampersand", "latin1-as-cp1252"})
CONTROL = bytes([*range(9), 11, 12, *range(14, 32)])
BARE = re.compile(rb"&(?!(?:[A-Za-z_:][A-Za-z0-9._:-]*|#[0-9]+|#x[0-9A-Fa-f]+);)")
DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")
MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


class Refused(Exception):
    """A file that can't be read further; code tells why."""

    def __init__(self, code: str, message: str, line: int | None = None):
        super().__init__(message)
        self.code, self.line = code, line


def decompressed(data: bytes, name: str, most: int | None = None) -> tuple[bytes, str | None]:
    """The content of a plain, gzip or single-member zip file, never larger than the bound."""
    if name.lower().endswith(ENCRYPTED) or data[:4] == CABINET:
        raise Refused("XAF1021", "an encrypted container can't be read")
    bound = most or len(data) * RATIO + GRACE

    def bounded(stream: io.BufferedIOBase) -> bytes:
        out = stream.read(bound + 1)
        if len(out) > bound:
            raise Refused("XAF2003", f"the content is larger than {bound} bytes")
        return out

    try:
        if data[:2] == b"\x1f\x8b":
            return bounded(gzip.GzipFile(fileobj=io.BytesIO(data))), "gzip"
        if data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                members = [m for m in archive.infolist() if not m.is_dir() and not m.filename.startswith("__MACOSX")]
                if len(members) != 1:
                    raise Refused("XAF1021", f"an archive must hold one file, not {len(members)}")
                with archive.open(members[0]) as stream:
                    return bounded(stream), "zip"
    except (OSError, EOFError, zlib.error, zipfile.BadZipFile) as e:
        raise Refused("XAF1021", f"corrupt archive: {e}") from e
    if most and len(data) > most:
        raise Refused("XAF2003", f"the content is larger than {most} bytes")
    return data, None


def sniff(data: bytes) -> tuple[str, bool, str | None]:
    """(encoding, whether a byte-order mark says so, declared encoding)."""
    declared = DECLARED.match(data[:1024].removeprefix(codecs.BOM_UTF8))
    name = declared[1].decode() if declared else None
    for mark, encoding in MARKS:
        if data.startswith(mark):
            return encoding, True, name
    if data[:4] in (b"<\0?\0", b"<\0a\0"):
        return "utf-16-le", False, name
    if data[:4] in (b"\0<\0?", b"\0<\0a"):
        return "utf-16-be", False, name
    return name or "utf-8", False, name


def settled(head: bytes, encoding: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(encoding to read with, what was noted about it as (code, message)), from the first bytes of a file."""
    used, marked, _ = sniff(head)
    notes = [("XAF1001", "the file has a byte-order mark")] if marked else []
    if encoding:
        used = encoding
        notes.append(("XAF1004", f"read as {encoding}, as asked for"))
    try:
        return codecs.lookup(used).name, notes
    except LookupError:
        return "utf-8", [*notes, ("XAF1003", f"unknown encoding {used}")]


def without_mark(data: bytes, used: str) -> bytes:
    for mark, name in MARKS:
        if data.startswith(mark) and used in (name, "utf-8", "utf-16"):
            data = data[len(mark) :]
    return data


def converted(data: bytes, used: str, repair: frozenset[str]) -> tuple[bytes, dict[str, int]]:
    """(UTF-8 bytes of data or of any part of it that begins and ends between characters, counts of what was met and mended)."""
    counts = dict.fromkeys(("c1", "lost", "control", "bare"), 0)
    if used == "iso8859-1" and re.search(rb"[\x80-\x9f]", data):
        counts["c1"] = 1
        used = "cp1252" if "latin1-as-cp1252" in repair else used
    text = data.decode(used, "replace")
    counts["lost"] = max(0, text.count("\ufffd") - (data.count("\ufffd".encode()) if used == "utf-8" else 0))
    out = text.encode()
    if "control-chars" in repair:
        kept = out.translate(None, CONTROL)
        counts["control"] = len(out) - len(kept)
        out = kept
    if "bare-ampersand" in repair:
        out, counts["bare"] = BARE.subn(b"&amp;", out)
    return out, counts


def counted(counts: dict[str, int], repair: frozenset[str]) -> list[tuple[str, str]]:
    """Notes from the counts of a whole file."""
    c1 = ("XAF1011", "read as windows-1252") if "latin1-as-cp1252" in repair else ("XAF1005", "declared ISO-8859-1, but holds bytes that only windows-1252 has")
    said = {
        "c1": c1,
        "lost": ("XAF1006", f"{counts['lost']} undecodable bytes were replaced"),
        "control": ("XAF1010", f"removed {counts['control']} control characters"),
        "bare": ("XAF1012", f"escaped {counts['bare']} bare ampersands"),
    }
    return [note for name, note in said.items() if counts[name]]


def utf8(data: bytes, encoding: str | None, repair: frozenset[str]) -> tuple[bytes, str, list[tuple[str, str]]]:
    """(UTF-8 bytes without mark, encoding used, what was noted on the way as (code, message))."""
    used, notes = settled(data, encoding)
    out, counts = converted(without_mark(data, used), used, repair)
    return out, "cp1252" if counts["c1"] and "latin1-as-cp1252" in repair else used, notes + counted(counts, repair)
