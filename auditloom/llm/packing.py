"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest length as fit, then one piece
for each set bit of the rest. Every piece is a sequence of its own and belongs to the bucket of its length, so no sequence
crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from auditloom.llm.common import text_of

#: id that ends each document
END = 0
#: texts that the two libraries are held against each other by: letters, numbers, marks, white space and special strings
PROBES = ["", "It's they'll WE'VE 'd", "  two  spaces\t\n\n x \u00a0\u2003y", "1234567 3.14e-10 ½ ٣", "naïve Straße 東京 🙂👍🏽 e\u0301", "{}[]();:==!=->//***", "<|endoftext|> <s></s> [PAD]", "internationalization " * 3, "\x00\x7f\u0085\u2028\ufeff"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


class ByteEncoder:
    """Ids of a tokenizers byte-level BPE file, special strings inside texts taken as that library takes them by default.

    tiktoken makes the same ids several times faster from the same vocabulary, so it goes first where the file is of that
    kind and its ids of some probes are those of tokenizers; a text that its pattern engine gives up on is encoded by tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.fast = self._tiktoken()
        if self.fast is not None and any(self.encode(t).tolist() != self.exact.encode(t, add_special_tokens=False).ids for t in PROBES):
            self.fast = None

    def _tiktoken(self) -> Any:
        import json

        import tiktoken

        spec = json.loads(self.exact.to_str())
        step, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (
            step.get("type") == "ByteLevel"
            and not step.get("add_prefix_space")
            and step.get("use_regex", True)
            and model.get("type") == "BPE"
            and not spec.get("normalizer")
            and not model.get("ignore_merges")
        )
        if not plain:
            return None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable}
        shown |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        try:
            ranks = {bytes(shown[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
            # FIXED VALUES: the pattern of byte-level BPE
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        except (KeyError, ValueError):
            return None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
            except BaseException as e:  # a panic of the pattern engine is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n tokens, longest first."""
    out, start = [(i * most, most) for i in range(n // most)], n - n % most
    bit = most >> 1
    while bit:
        if n & bit:
            out.append((start, bit))
            start += bit
        bit >>= 1
    return out


def pack(docs: DataFrame, tokenizer_file: str, max_length: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds the piece's ids.

    A null or empty text is its end id alone; a null doc_id stays null; repeated rows are packed each; other columns are not
    read. sequence_id is unique: the task's number in the high bits, a running number in the low 33, as Spark numbers rows.
    bucket is the binary logarithm of the length; writing partitioned by it gives one folder for each length. Nothing is
    shuffled, and no sequence depends on another row.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file).encode
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            tokens: list[np.ndarray] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), END).astype("<u4")
                raw, n = ids.tobytes(), len(ids)
                for start, length in pieces(n, max_length):
                    rows.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, length.bit_length() - 1))
                    if with_ids:
                        tokens.append(ids[start : start + length].astype(np.int32))
            doc, start, length, crc, n, bucket = zip(*rows, strict=True) if rows else ((),) * 6
            made = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, n, range(number, number + len(rows)), [0] * len(rows))]
            made.append(pa.array(bucket, pa.int32()))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                made.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            number += len(rows)
            yield pa.RecordBatch.from_arrays(made, names=names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(packed, SCHEMA + (", ids array<int>" if with_ids else ""))
