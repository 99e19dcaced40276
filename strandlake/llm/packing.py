"""Packing by minimum bin slack.

Each document becomes its ids and one end id. As many whole windows as it fills are cut
off first; what remains, shorter than a window, goes to a bounded pool. A window is
seeded with the longest remainder, and a subset-sum programme over a bitset finds the
multiset of the other remaining lengths that fills the rest closest to its capacity; the
counts are found by going back through the bitsets. Where a gap stays, one remainder is
cut to fill it. The last tokens of a task fill windows of falling powers of two, which
need no padding. Pools are a task's own, so nothing is shuffled; sequence numbers hold the
task's number in their upper bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import id_text, map_arrow

WINDOW = 2048
END = 1
POOL = 1024  # remainders
WORDS = 250_000  # of a generation of the word cache

Piece = tuple  # (document, start, ids as bytes)


def fill(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take: the multiset whose sum is closest to, and at most, the capacity."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for size in sorted(counts, reverse=True):
        if size > capacity:
            continue
        steps.append((size, reach))
        for _ in range(min(counts[size], capacity // size)):
            grown = (reach | reach << size) & mask
            if grown == reach:
                break
            reach = grown
        if reach >> capacity & 1:
            break
    left, out = reach.bit_length() - 1, {}
    for size, before in reversed(steps):
        n = 0
        while not before >> (left - n * size) & 1:
            n += 1
        if n:
            out[size] = n
            left -= n * size
    return out


class Pool:
    """Remainders by their length in tokens."""

    def __init__(self) -> None:
        self.by: dict[int, list[Piece]] = defaultdict(list)
        self.n = self.tokens = 0

    def add(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        self.by[size].append(piece)
        self.n += 1
        self.tokens += size

    def take(self, size: int) -> Piece:
        held = self.by[size]
        piece = held.pop()
        if not held:
            del self.by[size]
        self.n -= 1
        self.tokens -= size
        return piece

    def window(self, capacity: int) -> list[Piece]:
        """Pieces that fill the capacity exactly; the pool must hold as many tokens."""
        out, room = [], capacity
        longest = max(self.by)
        if longest > room:
            longest = max((s for s in self.by if s <= room), default=0)
        if longest:
            out.append(self.take(longest))
            room -= longest
        for size, n in fill(room, {s: len(p) for s, p in self.by.items()}).items():
            out += [self.take(size) for _ in range(n)]
            room -= n * size
        if room:  # every remainder is longer than the gap
            doc, start, ids = self.take(min(self.by))
            out.append((doc, start, ids[: 4 * room]))
            self.add((doc, start + room, ids[4 * room :]))
        return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): one row a piece.

    ids are little-endian 32-bit numbers; start counts the document's ids before the piece,
    doc_tokens all of them with the end id; pieces of a sequence follow each other by offset
    without a gap. Sequences have `window` ids, but for the last few of a task, whose
    numbers of ids are powers of two. Null and empty texts have the end id only. Rows that
    repeat an id are packed each; null ids are carried along; other columns are not read;
    an empty table gives no rows.
    """
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, last = bpe.encoder(path, WORDS, library=True).packed, end.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 40
        pool, rows = Pool(), []

        def sequence(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for (doc, total), start, ids in pieces:
                rows.append((doc, start, ids, total, number, offset))
                offset += len(ids) // 4
            number += 1

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = packed(text) + last
                total = len(ids) // 4
                at = 0
                while total - at >= window:
                    sequence([((doc, total), at, ids[4 * at : 4 * (at + window)])])
                    at += window
                if at < total:
                    pool.add(((doc, total), at, ids[4 * at :]))
                if pool.n >= POOL:
                    while pool.n >= POOL // 2 and pool.tokens >= window:
                        sequence(pool.window(window))
                if len(rows) >= 2048:
                    yield told()
        size = window
        while pool.tokens:
            while pool.tokens < size:
                size = 1 << (pool.tokens.bit_length() - 1)
            sequence(pool.window(size))
        if rows:
            yield told()

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def described(pieces: DataFrame) -> DataFrame:
    """pack()'s rows with the length and the CRC-32 of the ids instead of the ids."""
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
