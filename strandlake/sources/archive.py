"""The index archive: what a build writes once and every classification reads.

Tables below one folder, all Parquet: `features` (tid, genus, species, bin, pos, hash),
`frequency` (h22, df), `occurrences` (hash, df), `index` (hash, bin, tid, species, genus) in
the order of its hashes, `anchors` (tid, key, pos, strand), `coverage` (a row a species), `bases`
(species, sequences, bp), `taxa` (species, genus, sources) and
`limits` (one row: threshold, enabled, counters). A table is written when it is first asked
for, or all at once by `build`; a folder that has one is read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import features, probe

from .shared import shuffles_dropped

SPAN = 67  # bases that a feature's hashing needs
EACH, MOST = 10_000_000, 3  # rows that are dealt out at a time, and stretches that a table is read for them
TABLES = ("taxa", "bases", "features", "frequency", "limits", "occurrences", "index", "coverage", "anchors")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to the end; asked through Hadoop, so any store will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Store:
    """Named tables below `path`, each written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def held(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, written by make() if it isn't there."""
        return self.spark.read.parquet(self._written(name, make))

    def dealt(self, name: str, rows: DataFrame, make: Callable[[int, int], DataFrame]) -> DataFrame:
        """The table of that name, put together of make(k, n) for each k below n, so of the shuffle files only an n-th lie on disk at a time.

        n follows the number of `rows`, which every stretch reads, and is small.
        """
        n = max(1, min(MOST, -(-rows.count() // EACH)))
        return self.spark.read.parquet(*(self._written(f"{name}/{k}-of-{n}", lambda k=k: make(k, n)) for k in range(n)))

    def _written(self, name: str, make: Callable[[], DataFrame]) -> str:
        at = f"{self.path}/{name}"
        if not exists(self.spark, at):
            with shuffles_dropped(self.spark):
                make().write.mode("overwrite").parquet(at)  # what a run that was cut off has left is written anew
        return at


class Archive(Store):
    """An index at `path`; `refs` (tid, genus, species, seq) are needed for tables that aren't written yet."""

    def __init__(self, spark: SparkSession, path: str, refs: DataFrame | None = None, bins: int = 64):
        super().__init__(spark, path)
        self._refs, self.bins = refs, bins

    @property
    def refs(self) -> DataFrame:
        if self._refs is None:
            raise FileNotFoundError(f"{self.path} lacks a table of the index")
        return self._refs

    def build(self) -> Archive:
        for name in TABLES:
            getattr(self, name)
        return self

    @cached_property
    def taxa(self) -> DataFrame:
        return self.held("taxa", lambda: self.refs.groupBy("species", "genus").agg(F.count("*").alias("sources")))

    @cached_property
    def bases(self) -> DataFrame:
        """(species, sequences, bp), so sequences are measured once."""
        return self.held("bases", lambda: features.bases(self.refs, "species"))

    @cached_property
    def features(self) -> DataFrame:
        return self.held("features", lambda: features.features(self.refs).withColumn("bin", F.pmod("tid", F.lit(self.bins))))

    @cached_property
    def frequency(self) -> DataFrame:
        return self.held("frequency", lambda: features.frequency(self.features))

    @cached_property
    def limits(self) -> DataFrame:
        """One row: threshold, enabled, counters."""
        n = self.frequency.agg((4 * F.count("*")).alias("counters"))
        return self.held("limits", lambda: features.threshold(self.frequency).crossJoin(n))  # one row each

    @cached_property
    def occurrences(self) -> DataFrame:
        return self.held("occurrences", lambda: self.features.groupBy("hash").agg(F.count("*").alias("df")))

    @cached_property
    def kept(self) -> DataFrame:
        """Features below the frequency threshold, with df and uniq."""
        return features.kept(self.features, self.frequency, self.limits)

    @cached_property
    def index(self) -> DataFrame:
        return self.held("index", lambda: probe.index(self.kept).sort("hash"))

    @cached_property
    def coverage(self) -> DataFrame:
        """(species, bp, total, unique, unique_density, expected)."""

        def make() -> DataFrame:
            own = self.dealt("tallies", self.features, lambda k, n: features.tally(features.stretch(self.features, k, n), self.limits, "species"))
            return features.coverage(features.joined(self.bases, own, "species"), SPAN)

        return self.held("coverage", make)

    @cached_property
    def anchors(self) -> DataFrame:
        return self.held("anchors", lambda: features.anchors(self.refs.select("tid", "seq")))

    @cached_property
    def counters(self) -> int:
        return self.limits.first()["counters"]
