"""Helpers shared by the corpus operators: tables, lineage cuts, Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of every contract here: blank and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"
#: Rows of two or three numbers that a table may have to be broadcast: a few MB.
BROADCAST = 100_000
#: Bytes of an Arrow batch, held once in the JVM, outside its heap, and once in the Python worker of a task.
BATCH = 8 << 20
#: Rows of a slice that an Arrow function takes at one time.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all run in one process."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
        d = sc.getCheckpointDir()
    return d.rstrip("/")


class Tables:
    """Written tables of one run of an operator: each cuts the lineage of what it holds.

    They lie as Parquet in the shared folder. `drop` removes those that are used up; the
    rest goes when the application ends, as lazy plans may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/strandlake-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        atexit.register(remove, self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path, None)
        return out

    def rows(self, df: DataFrame) -> int:
        """The number of rows of a kept table, from its files' footers."""
        out, path, n = self.held[id(df)]
        if n is None:
            n = out.count()
            self.held[id(df)] = (out, path, n)
        return n

    def small(self, df: DataFrame) -> DataFrame:
        """A kept table, to be broadcast if it has at most BROADCAST rows of a few numbers."""
        return F.broadcast(df) if self.rows(df) <= BROADCAST else df

    def drop(self, *used: DataFrame) -> None:
        for df in used:
            if got := self.held.pop(id(df), None):
                remove(self.spark, got[1])


def materialize(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read again."""
    return Tables(df.sparkSession).keep(df)


def narrow(df: DataFrame, rows: int, each: int) -> DataFrame:
    """`df` in no more tasks than `rows` rows need at `each` a task."""
    return df.coalesce(max(1, -(-rows // each)))


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by then
        pass


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that `df` has, whatever their case."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name = "_" + name
        out.append(name)
    return out


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow by slices of ROWS rows, so few texts are Python objects at one time.

    Workers outlive their tasks: what a task has freed goes back to the system at its end,
    or it would count against an executor's memory in the stages that follow.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))
        give_back()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """From here on the session sends Arrow batches of at most BATCH bytes: long texts come by the thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def give_back() -> None:
    """Return the memory that this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's own
    if trim is not None:
        trim(0)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns only, so that no other column's name can clash; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def held_out(id_col: Column) -> Column:
    """The fold that labels are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SIEVE = 26  # bits: a bitmap takes 8 MB, whatever it is made of


def bitmap(df: DataFrame, column: str) -> Broadcast:
    """A broadcast bitmap with the bit of each value of a long column set, the value taken modulo 2^SIEVE.

    Misses nothing; what else passes is for an exact join behind it.
    """
    bit = F.pmod(F.col(column), F.lit(1 << SIEVE)).cast("long") + 1  # the functions count from 1
    rows = df.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros((1 << SIEVE) // 8, np.uint8)
    for r in rows:
        at = (r["at"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bits: np.ndarray, value):
    """Whether the bit of an integer, or of each of an array of integers, is set."""
    at = value & ((1 << SIEVE) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) if isinstance(at, np.ndarray) else int(bits[at >> 3]) >> (at & 7)) & 1
