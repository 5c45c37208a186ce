"""What a task of suffix-array deduplication does with the bytes it holds; Spark partitions and shuffles the work."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import xxhash

#: bytes of the strings that anchors are chosen by
GRAM = 20
#: bytes that are hashed at a time, segments that a task counts at a time, and strings in a sorted run
AT_ONCE, COUNTED, IN_RUN = 2_000_000, 800_000, 150_000
POSITION = np.uint64((1 << 24) - 1)
#: what a task says of an anchor: it has one here; or several, that are each sent on, with one mark for the anchor
SINGLE, SURE, MARK = range(3)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(first: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A segment's first window (36 bits), number of windows (8) and its anchor's offset (8) in one number."""
    return (first << 16) | (windows << 8) | offset


def anchors(data: bytes, edges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment of data: hash of its anchor, first window, number of windows, offset of the anchor.

    A window of so many bytes that lies between two edges is served by the leftmost of its grams with the least hash: equal
    windows have their anchor at the same place. A segment is a run of windows that one anchor serves.
    """
    n = len(data) - length + 1
    word = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    grams = len(data) - GRAM + 1
    h = word[:grams] * np.uint64(0x9E3779B97F4A7C15)
    for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (GRAM - 8, 0x165667B19E3779F9)):
        h ^= h >> np.uint64(29)
        h += word[k : k + grams]
        h *= np.uint64(odd)
    h = mixed(h)
    least = (h & ~POSITION) | np.arange(grams, dtype=np.uint64)
    span, wide = length - GRAM + 1, 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if span > wide:
        least = np.minimum(least[: -(span - wide)], least[span - wide :])
    at = least & POSITION
    valid = np.ones(n, bool)
    for e in edges[1:-1]:
        valid[max(0, e - length + 1) : e] = False
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[1:] |= valid[1:] != valid[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, n))
    ok = valid[starts]
    starts, counts = starts[ok], counts[ok]
    where = at[starts].astype(np.int64)
    return h[where], starts, counts, where - starts


def segments(texts: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, document, row key, packed place) of the segments of (document, row key, bytes), in arrays.

    Longer documents than AT_ONCE are cut into parts that share length - 1 bytes, so each window is in one part.
    """
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def emit() -> tuple[np.ndarray, ...]:
        data = b"".join(x[3] for x in held)
        edges = np.cumsum([0, *(len(x[3]) for x in held)])
        h, first, count, offset = anchors(data, edges, length)
        part = np.searchsorted(edges, first, "right") - 1
        doc, key, base = (np.array([x[k] for x in held], np.int64)[part] for k in range(3))
        return h.view(np.int64), doc, key, packed(first - edges[part] + base, count, offset)

    for doc, key, text in texts:
        for at in range(0, max(1, len(text) - length + 1), AT_ONCE):
            part = text[at : at + AT_ONCE + length - 1]
            if len(part) < length:
                continue
            held.append((doc, key, at, part))
            size += len(part)
            if size >= AT_ONCE:
                yield emit()
                held, size = [], 0
    if held:
        yield emit()


def group_sizes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: where each group of equals starts, and the size of each value's group."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(h)))[np.cumsum(new) - 1]


def dealt(x: np.ndarray) -> np.ndarray:
    return (mixed(x.view(np.uint64)) >> np.uint64(33)).astype(np.int32)


def counted(h: np.ndarray, doc: np.ndarray, key: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a task passes on, as (to, kind, h, doc, key, p).

    An anchor that it has once goes where the anchor goes. One that it has more often is repeated for sure: its places are dealt
    out by document, and one mark goes where the anchor goes, so no anchor sends more than a row for each call.
    """
    order = np.argsort(h, kind="stable")
    h, doc, key, p = h[order], doc[order], key[order], p[order]
    starts, sizes = group_sizes(h)
    sure = sizes > 1
    marks = h[starts[sure[starts]]]
    zero = np.zeros(len(marks), np.int64)
    to = np.where(sure, dealt(doc ^ p), dealt(h))
    columns = [(to, dealt(marks)), (np.where(sure, SURE, SINGLE).astype(np.int8), np.full(len(marks), MARK, np.int8)), (np.where(sure, 0, h), marks), (doc, zero), (key, zero), (p, zero)]
    return tuple(np.concatenate(c) for c in columns)


def repeated(kind: np.ndarray, h: np.ndarray, doc: np.ndarray, key: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, row key, place) of the anchors that are not alone, of the rows of whole anchors."""
    order = np.argsort(h, kind="stable")
    _, sizes = group_sizes(h[order])
    k = order[(sizes > 1) & (kind[order] == SINGLE)]
    return doc[k], key[k], p[k]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which so much is known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


#: string, document, row key, place
Row = tuple[bytes, int, int, int]
Block = tuple[int, bytes, bytes, bytes, bytes, bytes, bytes]


def numbers(values: list[int]) -> bytes:
    return np.array(values, np.int64).tobytes()


def block(bucket: int, part: list[Row]) -> Block:
    """Sorted strings front-coded: bucket, common lengths, lengths, tails, documents, row keys, places."""
    shared = [0, *(common(a[0], b[0]) for a, b in zip(part, part[1:], strict=False))]
    tails = b"".join(r[0][n:] for r, n in zip(part, shared, strict=True))
    return (bucket, bytes(shared), bytes(len(r[0]) for r in part), tails, *(numbers([r[k] for r in part]) for k in (1, 2, 3)))


def sorted_blocks(rows: list[Row], splitters: list[bytes], subs: int, collapse: Callable[[list[Row]], tuple[list[Row], list[Row]]]) -> Iterator[Block]:
    """A sorted run as front-coded blocks; a bucket is a range between splitters, and in it the strings of equal hashes of their
    first bytes modulo subs.

    Of equal strings of a run, collapse says which are sent, and which are told: what is known of those needs no other run. They go
    out in a block with a bucket below zero, with the length of each string.
    """
    rows.sort()
    sent: list[Row] = []
    told: list[Row] = []
    at = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k][0] != rows[at][0]:
            if k == at + 1:
                sent.append(rows[at])
            else:
                send, tell = collapse(rows[at:k])
                sent += send
                told += tell
            at = k
    if told:
        yield (-1 - (told[0][1] + told[0][3]) % 2**20, b"", bytes(len(r[0]) for r in told), b"", *(numbers([r[k] for r in told]) for k in (1, 2, 3)))
    at = 0
    while at < len(sent):
        part = bisect_right(splitters, sent[at][0])
        end = len(sent) if part == len(splitters) else bisect_left(sent, splitters[part], at, key=lambda r: r[0])
        if subs == 1:
            yield block(part, sent[at:end])
        else:
            dealt_out: dict[int, list[Row]] = {}
            for r in sent[at:end]:
                dealt_out.setdefault(xxhash.xxh3_64_intdigest(r[0][:GRAM]) % subs, []).append(r)
            for sub, some in dealt_out.items():
                yield block(part * subs + sub, some)
        at = end


Merged = tuple[int, bytes, int, int, int]


def read_block(columns: tuple[bytes, bytes, bytes, bytes, bytes, bytes]) -> Iterator[Merged]:
    """(common length with the row before, string, document, row key, place) of a block's rows."""
    shared, lengths, tails, *rest = columns
    text, at = b"", 0
    for n, size, doc, key, place in zip(shared, lengths, *(np.frombuffer(c, np.int64).tolist() for c in rest), strict=True):
        text = text[:n] + tails[at : at + size - n]
        at += size - n
        yield n, text, doc, key, place


def merge(runs: list[Iterator[Merged]]) -> Iterator[Merged]:
    """The rows of sorted runs in order, each with the length of its common prefix with the row before.

    A tree of losers: every run's current string carries the length of its common prefix with the string that last won over it.
    Of two strings the one that shares more with the last winner is smaller; only equals are compared, from that length on.
    """
    k = len(runs)
    now: list[Merged | None] = [next(r, None) for r in runs]
    shared = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two runs."""
        a, b = now[i], now[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        x, y = a[1], b[1]
        n = common(x, y, shared[i])
        if x[n : n + 1] <= y[n : n + 1]:
            shared[j] = n
            return i, j
        shared[i] = n
        return j, i

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, losers[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if k > 1 else 0
    while k and now[win] is not None:
        row = now[win]
        yield shared[win], *row[1:]
        new = now[win] = next(runs[win], None)
        shared[win] = new[0] if new else 0
        node = (win + k) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2
