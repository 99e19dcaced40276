"""Exact dedup over a cuckoo-filter index of live digests.

The index keeps a 32-bit fingerprint of each live digest in one of two buckets of four
slots, beside the number of the record that it stands for. A fingerprint hit is verified
against the digest stored with the bucketed record, so answers are exact. Digests can be
inserted and deleted; when an insertion finds no place after `KICKS` moves, the table
doubles and is filled again from the stored digests.

Over a table, each task first folds its own rows into such an index (a third of all rows
may be copies of one text: they leave a task as one record), then records meet by digest
and are folded again, a bounded run of digests at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, partitions

SLOTS = 4
KICKS = 200
LIVE = 250_000  # records that one index holds before they are passed on


class CuckooIndex:
    """Live 32-byte digests, each with a record number."""

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes] = []  # by record number; b"" once deleted
        self.free: list[int] = []
        self.live = 0
        self._resize(buckets)

    def _resize(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = [0] * (buckets * SLOTS)
        self.records = [-1] * (buckets * SLOTS)
        for number, key in enumerate(self.keys):
            if key and not self._place(key, number):
                return self._resize(buckets * 2)

    def _spots(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:4], "little") or 1
        one = int.from_bytes(key[4:12], "little") & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def _slot(self, key: bytes) -> int:
        mark, one, two = self._spots(key)
        marks = self.marks
        for bucket in (one, two):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                # a hit of the fingerprint is verified against the stored digest
                if marks[at] == mark and self.keys[self.records[at]] == key:
                    return at
        return -1

    def find(self, key: bytes) -> int:
        """The record number of a live digest, or -1."""
        at = self._slot(key)
        return -1 if at < 0 else self.records[at]

    def _place(self, key: bytes, number: int) -> bool:
        mark, one, two = self._spots(key)
        bucket = one
        for kick in range(KICKS):
            for b in (bucket, two) if kick == 0 else (bucket,):
                for at in range(b * SLOTS, b * SLOTS + SLOTS):
                    if self.marks[at] == 0:
                        self.marks[at], self.records[at] = mark, number
                        return True
            at = bucket * SLOTS + kick % SLOTS
            mark, self.marks[at] = self.marks[at], mark
            number, self.records[at] = self.records[at], number
            bucket = self._other(bucket, mark)
        return False

    def insert(self, key: bytes) -> int:
        """The record number of the digest, which is live from now on."""
        if (number := self.find(key)) >= 0:
            return number
        if self.free:
            number = self.free.pop()
            self.keys[number] = key
        else:
            number = len(self.keys)
            self.keys.append(key)
        self.live += 1
        if self.live > self.buckets * SLOTS * 0.9 or not self._place(key, number):
            self._resize(self.buckets * 2)  # overflow: from the stored digests, the new one among them
        return number

    def delete(self, key: bytes) -> bool:
        at = self._slot(key)
        if at < 0:
            return False
        number = self.records[at]
        self.marks[at], self.records[at], self.keys[number] = 0, -1, b""
        self.free.append(number)
        self.live -= 1
        return True


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, digest): code points of the original text, SHA-256 of the text without white space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("size"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"))


_RECORD = "digest binary, size long, keep_id long, n long"


def _fold(batches: Iterator[pa.RecordBatch], ordered: bool) -> Iterator[pa.RecordBatch]:
    """Fold records (digest, size, keep_id, n) of equal digests into one; the larger size, then the smaller id stays.

    ordered: equal digests come together, so an index can be passed on between two digests.
    """
    index, best, count = CuckooIndex(1024), [], []

    def out() -> pa.RecordBatch:
        sizes, ids = zip(*best) if best else ((), ())
        ids = [None if i == _LAST else i for i in ids]
        return pa.RecordBatch.from_arrays([pa.array(index.keys, pa.binary()), pa.array([-s for s in sizes], pa.int64()), pa.array(ids, pa.int64()), pa.array(count, pa.int64())], ["digest", "size", "keep_id", "n"])

    last = None
    for batch in batches:
        for key, size, doc, n in zip(*(batch[c].to_pylist() for c in ("digest", "size", "keep_id", "n"))):
            if index.live >= LIVE and (not ordered or key != last):
                yield out()
                index, best, count = CuckooIndex(1024), [], []
            last = key
            number = index.insert(key)
            rank = (-size, _LAST if doc is None else doc)
            if number == len(best):
                best.append(rank)
                count.append(n)
            else:
                count[number] += n
                if rank < best[number]:
                    best[number] = rank
    if best:
        yield out()


_LAST = 1 << 63  # an id that is null comes after all others


def groups(rows: DataFrame) -> DataFrame:
    """(digest, size, keep_id, n): one record for each digest of digests()' rows."""
    ones = rows.select("digest", "size", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    local = ones.mapInArrow(lambda b: _fold(b, False), _RECORD)
    met = local.repartition(partitions(rows.sparkSession), "digest").sortWithinPartitions("digest")
    return met.mapInArrow(lambda b: _fold(b, True), _RECORD)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of `docs`.

    Texts are equal without their white space; null and empty texts are one group. The
    longest original text, then the smallest doc_id stays; null ids come last and stay
    only in a group without others. Rows that repeat an id and a text count and are kept
    or dropped alike. Other columns are not read; an empty table gives no rows.
    """
    rows = digests(docs, id_col, text_col)
    found = groups(rows).select(F.col("digest").alias("d"), "keep_id", F.col("n").alias("group_size"))
    out = rows.join(found, F.col("digest") == F.col("d"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
