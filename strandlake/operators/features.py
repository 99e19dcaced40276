"""From sequences to features: k-mers, selections of them, frequencies, counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from strandlake.functions import kernels
from strandlake.functions import scalars as S


LEAST = 67  # bases of a sequence that gets features: 2 k + w_min - 1


def _exploded(df: DataFrame, seq: str, names: list[str], types: list[str], kernel: Callable[[np.ndarray], tuple[np.ndarray, ...]], least: int) -> DataFrame:
    """A row for each element of kernel(bases): the other columns of `df` and the kernel's arrays; null and short sequences give none."""
    keep = [f for f in df.schema.fields if f.name != seq]
    schema = T.StructType([*keep, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, types))])
    kinds = [{"int": pa.int32(), "long": pa.int64()}[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [kernel(kernels.encode(x)) for x in batch[seq].to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]), pa.int64())
                own = [pa.array(np.concatenate(c).astype(k.to_pandas_dtype(), copy=False), k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([*(batch[f.name].take(row) for f in keep), *own], schema.names)

    rows = df.select(*(f.name for f in keep), seq).where(F.length(seq) >= least)
    return rows.mapInArrow(run, schema)


def features(df: DataFrame, seq: str = "seq") -> DataFrame:
    """pos, from 1, and hash of a sequence's order-2 strobemers over syncmers: the 56 bits that their content has."""

    def kernel(bases: np.ndarray) -> tuple[np.ndarray, ...]:
        content, at = kernels.contents(bases)
        return at + 1, (content >> np.uint64(8)).view(np.int64)

    return _exploded(df, seq, ["pos", "hash"], ["int", "long"], kernel, LEAST)


def strobemers(df: DataFrame, seq: str = "seq") -> DataFrame:
    """ordinal and hash of the strobemers, hashed once more with the fixed seed; bit patterns of unsigned numbers."""

    def kernel(bases: np.ndarray) -> tuple[np.ndarray, ...]:
        out = kernels.strobemers(bases)
        return np.arange(len(out)), out.view(np.int64)

    return _exploded(df, seq, ["ordinal", "hash"], ["int", "long"], kernel, LEAST)


def syncmer_rows(df: DataFrame, seq: str = "seq") -> DataFrame:
    """pos, from 1, and hash of the open syncmers; bit patterns of unsigned numbers."""

    def kernel(bases: np.ndarray) -> tuple[np.ndarray, ...]:
        h, at = kernels.syncmers(bases)
        return at + 1, h.view(np.int64)

    return _exploded(df, seq, ["pos", "hash"], ["int", "long"], kernel, 28)


def anchors(df: DataFrame, k: int = 15, w: int = 10, seq: str = "seq") -> DataFrame:
    """key, pos from 1, and strand of the minimizers."""

    def kernel(bases: np.ndarray) -> tuple[np.ndarray, ...]:
        code, at, strand = kernels.minimizers(bases, k, w)
        return code.view(np.int64), at + 1, strand

    return _exploded(df, seq, ["key", "pos", "strand"], ["long", "int", "int"], kernel, k)


def long_enough(df: DataFrame, seq: str, k: int = 28, w_min: int = 12, least: int = 0) -> DataFrame:
    return df.where(F.length(seq) >= max(least, 2 * k + w_min - 1))


def kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """A row for each k-mer: the other columns, pos from 1 and kmer; shorter sequences give none.

    Bytes are cut out by their places; a text would be counted through from its start for each k-mer.
    """
    keep = [c for c in df.columns if c != seq]
    at = F.sequence(F.lit(1), F.length(seq) - (k - 1))
    out = df.where(F.length(seq) >= k).select(*keep, F.col(seq).cast("binary").alias(seq), F.explode(at).alias("pos"))
    return out.select(*keep, "pos", F.substring(F.col(seq), F.col("pos"), F.lit(k)).cast("string").alias("kmer"))


def syncmers(df: DataFrame, by: list[str], order: str, smer_hash: str, span: int) -> DataFrame:
    """Rows whose s-mer hash, at the middle of a window of `span` s-mers, is the window's least."""
    own = W.partitionBy(*by).orderBy(order)
    half = span // 2
    around = own.rowsBetween(-half, span - 1 - half)
    return df.withColumn("__least", F.min(smer_hash).over(around)).withColumn("__n", F.count("*").over(around)).where((F.col(smer_hash) == F.col("__least")) & (F.col("__n") == span)).drop("__least", "__n")


def minimizers(df: DataFrame, by: list[str], order: str, rank: str, w: int) -> DataFrame:
    """Distinct (by, pos): in each w places in a row the leftmost with the least rank."""
    own = W.partitionBy(*by).orderBy(order)
    best = F.min(F.struct(F.col(rank).alias("r"), F.col(order).alias("p"))).over(own.rowsBetween(-(w - 1), 0))
    out = df.select(*by, order, best.alias("b"), F.row_number().over(own).alias("n")).where(F.col("n") >= w)
    out = out.withColumn("before", F.lag("b.p").over(own)).where(F.col("before").isNull() | (F.col("before") != F.col("b.p")))
    return out.select(*by, F.col("b.p").alias("pos"), F.col("b.r").alias("rank"))


def partners(df: DataFrame, by: list[str], order: str, hash_: str, lo: int, hi: int, reach: int) -> DataFrame:
    """Adds `partner`: the hash lo to hi places on, at most `reach` away, that differs in fewest low bits; else its own."""
    own = W.partitionBy(*by).orderBy(order)
    ahead = F.collect_list(F.struct(F.col(order).alias("p"), F.col(hash_).alias("h"))).over(own.rowsBetween(lo, hi))
    near = F.filter(ahead, lambda x: x["p"] <= F.col(order) + reach)
    bits = F.transform(near, lambda x: F.struct(F.bit_count(x["h"].bitwiseXOR(F.col(hash_)).bitwiseAND(F.lit(255))).alias("b"), x["p"].alias("p"), x["h"].alias("h")))
    return df.withColumn("partner", F.coalesce(F.array_min(bits)["h"], F.col(hash_)))


def strobe_content(one: Column, two: Column) -> Column:
    """Upper bits of the first hash, lower ones of the second, the last eight cleared."""
    main = -(1 << 26)
    return one.bitwiseAND(F.lit(main)).bitwiseOR(two.bitwiseAND(F.lit(~main))).bitwiseAND(F.lit(~255))


def frequency(feats: DataFrame) -> DataFrame:
    """(h22, df): occurrences of each class of equal low 22 bits."""
    return feats.groupBy(F.col("hash").bitwiseAND(F.lit(4194303)).alias("h22")).agg(F.count("*").alias("df"))


def threshold(freq: DataFrame, unique_degree: int = 1, quantile: float = 0.999) -> DataFrame:
    """(threshold, enabled): the power of two from which the most frequent counters make up the tail.

    Every class has four counters; the log2 histogram is walked from its top.
    """
    hist = freq.groupBy(F.floor(F.log2("df")).cast("int").alias("bucket")).agg((4 * F.count("*")).alias("n"), F.max("df").alias("most"))
    total = hist.agg(F.sum("n").alias("v"), F.max("most").alias("most"))
    walk = hist.withColumn("held", F.sum("n").over(W.orderBy(F.desc("bucket"))))  # at most 64 rows
    hit = walk.drop("most").crossJoin(F.broadcast(total)).withColumn("need", F.ceil((1 - quantile) * F.col("v")))  # one row
    out = hit.agg(F.max(F.when(F.col("held") >= F.col("need"), F.col("bucket"))).alias("bucket"), F.max("most").alias("most"))
    value = F.pow(F.lit(2.0), F.col("bucket")).cast("long")
    return out.select(value.alias("threshold"), ((value > unique_degree) & (F.col("most") > unique_degree)).alias("enabled"))


def with_frequency(feats: DataFrame, freq: DataFrame) -> DataFrame:
    return feats.withColumn("h22", F.col("hash").bitwiseAND(F.lit(4194303))).join(freq, "h22").drop("h22")


def kept(feats: DataFrame, freq: DataFrame, limits: DataFrame, unique_degree: int = 1) -> DataFrame:
    """Features below the frequency threshold, if it is enabled; uniq: seen at most `unique_degree` times."""
    rows = with_frequency(feats, freq).crossJoin(F.broadcast(limits.select("threshold", "enabled")))  # one row
    return rows.where(~F.col("enabled") | (F.col("df") < F.col("threshold"))).withColumn("uniq", F.col("df") <= unique_degree).drop("threshold", "enabled")


def bases(seqs: DataFrame, by: str) -> DataFrame:
    """(by, sequences, bp): the sequences of a taxon and their bases."""
    return seqs.groupBy(by).agg(F.count("*").alias("sequences"), F.sum(F.length("seq")).alias("bp"))


def counters(kept: DataFrame, seqs: DataFrame, by: str) -> DataFrame:
    """Per taxon: bases of all sequences, features kept, those that are unique."""
    return joined(bases(seqs, by), _counted(kept, by), by)


def joined(lengths: DataFrame, tallies: DataFrame, by: str) -> DataFrame:
    """counters() from bases() and from (by, total, unique) of any stretches of classes."""
    own = tallies.groupBy(by).agg(F.sum("total").alias("total"), F.sum("unique").alias("unique"))
    return lengths.select(by, "bp").join(own, by, "left").na.fill(0, ["total", "unique"])


def _counted(kept: DataFrame, by: str) -> DataFrame:
    return kept.groupBy(by).agg(F.count("*").alias("total"), F.sum(F.col("uniq").cast("long")).alias("unique"))


def stretch(feats: DataFrame, k: int, n: int) -> DataFrame:
    """The features of every n-th class of hashes, from the k-th on; classes stay whole."""
    return feats.where(F.pmod(F.col("hash").bitwiseAND(F.lit(4194303)), F.lit(n)) == k) if n > 1 else feats


def tallied(feats: DataFrame, seqs: DataFrame, limits: DataFrame, by: str) -> DataFrame:
    """counters() of the features that kept() keeps."""
    return joined(bases(seqs, by), tally(feats, limits, by), by)


def tally(feats: DataFrame, limits: DataFrame, by: str) -> DataFrame:
    """(by, total, unique) of the features that kept() keeps, in one shuffle of their classes and taxa: a class's rows count its frequency."""
    rows = feats.select(F.col("hash").bitwiseAND(F.lit(4194303)).cast("int").alias("h22"), by)
    rows = rows.withColumn("df", F.count("*").over(W.partitionBy("h22"))).crossJoin(F.broadcast(limits.select("threshold", "enabled")))  # one row
    rows = rows.where(~F.col("enabled") | (F.col("df") < F.col("threshold")))
    return _counted(rows.withColumn("uniq", F.col("df") <= 1), by)


def coverage(count: DataFrame, span: int, read: int = 150) -> DataFrame:
    """Density of unique features and how many a read of the reference holds."""
    density = F.when(F.col("bp") > 0, F.col("unique") / F.col("bp")).otherwise(F.lit(0.0))
    return count.withColumn("unique_density", density).withColumn("expected", density * max(1, read - span + 1))
