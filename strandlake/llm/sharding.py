"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it starts at
an offset and goes on by a step, both from hashes of its name. The shards take turns, each
claiming its first slot that is still free, until the table is full; so each shard holds
an equal number of slots, give or take one, and taking a shard away moves few others.
A row's key is hashed to a slot; the table is broadcast, so placement takes constant time.
The table's size is a parameter, not one of the data; rows are placed by native functions.
"""

from __future__ import annotations

from functools import cache
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

SHARDS = 64
SLOTS = 6_529  # prime, about a hundred slots a shard
MOST_SLOTS = 1 << 20


def names(shards: int) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(shards))


@cache
def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or slots < len(shards) or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots is needed, at least one a shard and at most 2^20")
    place = [crc32(f"offset:{s}".encode()) % slots for s in shards]
    step = [crc32(f"step:{s}".encode()) % (slots - 1) + 1 for s in shards]
    table, claimed = [-1] * slots, 0
    while claimed < slots:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            table[place[i]] = i
            claimed += 1
            if claimed == slots:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key's text: 60 bits of its MD5 modulo the table's size; null counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots


def table(spark: SparkSession, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a DataFrame of `slots` rows, made from one literal of two bytes or four a slot."""
    held = b"".join(i.to_bytes(4, "big") for i in fill(shards, slots))
    at = (F.col("id") * 4 + 1).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot"), F.conv(F.hex(F.lit(bytearray(held)).substr(at, F.lit(4))), 16, 10).cast("int").alias("shard"))


def place(df: DataFrame, key_col: str = "doc_id", shards: tuple[str, ...] = names(SHARDS), slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) for each row of `df`, the key under its own name.

    Rows of one key go to one shard; null keys go where the empty text goes. Other
    columns are not read; an empty table gives no rows. A hot source is spread as its
    rows' keys differ.
    """
    rows = df.select(F.col(key_col).alias(key_col), slot_of(F.col(key_col), slots).alias("slot"))
    held = F.broadcast(table(df.sparkSession, tuple(shards), slots))
    return rows.join(held, "slot").select(key_col, "slot", "shard")


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", shards: tuple[str, ...] = names(SHARDS), slots: int = SLOTS) -> None:
    """Write whole rows into a folder a shard, `shard=` and its number, or `_shard=` where `df` has such a column; an empty table gives no folder."""
    shard, slot = unused(df, "shard", "slot")
    held = F.broadcast(table(df.sparkSession, tuple(shards), slots)).select(F.col("slot").alias(slot), F.col("shard").alias(shard))  # of `slots` rows
    rows = df.withColumn(slot, slot_of(F.col(key_col), slots)).join(held, slot).drop(slot)
    rows.repartition(shard, F.pmod(F.xxhash64(key_col), F.lit(4))).write.partitionBy(shard).parquet(path)
