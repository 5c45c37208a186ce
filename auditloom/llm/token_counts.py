"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial symbols minus the merges made; no identifiers are emitted. Symbols are the characters of the
normalised text, in a linked list; the heap holds the adjacent pairs that the vocabulary knows, and its best pair (leftmost
among equals) is merged until none is left. A character that the vocabulary lacks counts as its UTF-8 bytes (byte fallback).
No piece holds a space mark behind another character, so merges never cross from one such segment into the next: segments are counted
apart, and the counts of frequent ones are kept in a bounded table in each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from auditloom.llm.common import text_of

SPACE = "▁"
#: Segments whose counts a worker keeps; beyond it the table is emptied and fills anew.
KEPT_SEGMENTS = 600_000
#: texts that a model's own counts are held against: normalisation, special strings, byte fallback and white space would show
PROBES = ["", " a  b\tc\n\nd ", "ﬁ Å ½ Ａ e\u0301 \u00a0\u3000x", "<s></s> <unk> <pad> <0x41>", "▁ ▁▁x", "🙂👍🏽 東京 \x00\x7f\ufeff", "internationalization 1234567 3.14"]


class SegmentCounts(dict):
    """segment -> tokens, counted when it is first asked for."""

    def __init__(self, ranks: dict[str, float], single: set[str]):
        super().__init__()
        self.ranks, self.single = ranks, single

    def __missing__(self, segment: str) -> int:
        n = self[segment] = self.count(segment)
        return n

    def count(self, segment: str) -> int:
        single = self.single
        size = len(segment)
        symbols = size if single.issuperset(segment) else sum(1 if c in single else len(c.encode()) for c in segment)
        if size == 1:
            return symbols
        rank = self.ranks.get
        heap = [(r, i, pair) for i in range(size - 1) if (r := rank(pair := segment[i : i + 2])) is not None]
        if not heap:
            return symbols
        heapify(heap)
        text = list(segment)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            _, left, pair = heappop(heap)
            right = after[left]
            if right >= size or not text[left] or text[left] + text[right] != pair:
                continue  # one of the two was merged meanwhile
            symbols -= 1
            text[left], text[right] = pair, ""
            follow = after[left] = after[right]
            if follow < size:
                before[follow] = left
                longer = pair + text[follow]
                if (r := rank(longer)) is not None:
                    heappush(heap, (r, left, longer))
            ahead = before[left]
            if ahead >= 0:
                longer = text[ahead] + pair
                if (r := rank(longer)) is not None:
                    heappush(heap, (r, ahead, longer))
        return symbols


class TokenCounter:
    """Counts as sentencepiece's encode() gives them for a BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        plain = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        pieces = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space mark behind another character; segments would not be independent")
        self.segments = SegmentCounts({p: r for p, r in pieces.items() if len(p) > 1}, {p for p in pieces if len(p) == 1})
        inner = "" if any("\n" in p for p in pieces) else "\n"
        self.find = re.compile(f"{SPACE}*[^{SPACE}{inner}]+|{SPACE}+" + (f"|{inner}" if inner else "")).findall

        if wrong := [t for t in PROBES if self.count(t) != len(model.encode(t))]:
            raise ValueError(f"the model does more to a text than these counts do: {wrong[0]!r}")

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.segments) > KEPT_SEGMENTS:
            self.segments.clear()
        return sum(map(self.segments.__getitem__, self.find(SPACE + text.replace(" ", SPACE))))


@lru_cache(maxsize=2)
def counter(model_file: str) -> TokenCounter:
    return TokenCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted each; other columns
    are not read. A narrow, row-wise job: nothing is shuffled and a lost task is simply run again.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
