"""Build an index from reference sequences, classify reads with it, write the tables.

`Chain` is what reads go through, from features to scores; what it finds on the way lies in
a spool beside the output, so a run that was cut off goes on where it stopped.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandlake.operators import features, probe, score
from strandlake.sources import files
from strandlake.sources.archive import Archive, Store

BINS, DISPERSION = 64, 0.25


class Chain:
    """Reads (read, seq) against an archive; `spool` holds the evidence and the scores."""

    spark: SparkSession
    archive: Archive
    spool: Store
    reads: DataFrame

    @cached_property
    def sources(self) -> DataFrame:
        """(species, genus, sources), a row a taxon."""
        return self.archive.taxa

    @cached_property
    def taxa(self) -> DataFrame:
        return self.archive.taxa.select("species", "genus")

    @cached_property
    def numbers(self) -> DataFrame:
        """(species, genus, taxon): the taxa by number, as evidence holds them; 65,536 times the species' number, and the place of the genus."""
        kin, place = F.dense_rank().over(W.orderBy("species")) - 1, F.row_number().over(W.partitionBy("species").orderBy("genus")) - 1  # a row a taxon
        return self.taxa.withColumn("taxon", kin.cast("long") * 65536 + place)

    @cached_property
    def dfeat(self) -> DataFrame:
        return self.archive.features

    @cached_property
    def rfeat(self) -> DataFrame:
        return features.features(self.reads)

    @cached_property
    def df(self) -> DataFrame:
        return self.archive.occurrences

    @cached_property
    def index(self) -> DataFrame:
        return self.archive.index

    @cached_property
    def hits(self) -> DataFrame:
        return probe.probe(self.rfeat, self.index)

    @cached_property
    def parts(self) -> DataFrame:
        return self.spool.held("parts", lambda: score.contributions(self.rfeat, self.index, self.df, self.numbers, self.archive.counters, BINS, DISPERSION))

    @cached_property
    def scores(self) -> DataFrame:
        return self.spool.dealt("scored", self.parts, lambda k, n: score.scores(score.stretch(self.parts, k, n), self.numbers))

    @cached_property
    def lengths(self) -> DataFrame:
        """One row: the number of reads and their bases."""
        return self.spool.held("lengths", lambda: self.reads.agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases")))

    @cached_property
    def sampled(self) -> DataFrame:
        return probe.sample(self.rfeat, self.df)


class Run(Chain):
    def __init__(self, spark: SparkSession, archive: Archive, reads: DataFrame, spool: str):
        self.spark, self.archive, self.reads, self.spool = spark, archive, reads, Store(spark, spool)


def references(spark: SparkSession, target: str, tax_info: str) -> DataFrame:
    """(tid, genus, species, seq) of the FASTA files that a manifest (file, node) lists; the taxonomy's ranks name species and genus.

    The manifest names files by whole paths. A sequence's number is a hash of its file and
    name; a node without a genus above it is its own.
    """
    from strandlake.operators import taxonomy

    nodes = files.tax_info(spark.read.text(tax_info))
    listed = files.manifest(spark, target)
    paths = [r["file"] for r in listed.select("file").distinct().collect()]  # a name a file
    plain = lambda c: F.regexp_replace(c, "^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")  # noqa: E731  a path, with or without its scheme
    seqs = files.fasta(spark, paths).withColumn("file", plain(F.input_file_name()))
    seqs = seqs.join(F.broadcast(listed.withColumn("file", plain(F.col("file"))).distinct()), "file").select("file", "taxid", "seq_id", "seq")  # a row a file
    line = taxonomy.closure(nodes.select(F.col("node").alias("taxid"), "parent"))
    at = line.join(nodes.select(F.col("node").alias("anc"), "rank"), "anc")
    rank = lambda r: F.min_by(F.when(F.col("rank") == r, F.col("anc")), F.when(F.col("rank") == r, F.col("dist")))
    named = at.groupBy("taxid").agg(rank("species").alias("species"), rank("genus").alias("genus"))
    out = seqs.join(F.broadcast(named), "taxid", "left")  # a row a node
    species = F.coalesce("species", "taxid")
    return out.select(F.xxhash64("file", "seq_id").bitwiseAND(F.lit((1 << 62) - 1)).alias("tid"), F.coalesce("genus", species).alias("genus"), species.alias("species"), F.translate("seq", "RWMDHVNYSBKU", "AAAAAAACCCGT").alias("seq"))


def build(spark: SparkSession, refs: DataFrame, path: str, bins: int = BINS) -> Archive:
    """Write the index of `refs` (tid, genus, species, seq) below `path`."""
    return Archive(spark, path, refs, bins).build()


def reads_of(spark: SparkSession, path: str) -> DataFrame:
    """(read, seq) of FASTQ or FASTA files, by name."""
    fast = any(path.rstrip("/").endswith(x) for x in (".fa", ".fasta", ".fna", ".fa.gz", ".fasta.gz", ".fna.gz"))
    rows = files.fasta(spark, path) if fast else files.fastq(spark, path)
    return rows.select(F.col("seq_id").alias("read"), F.translate("seq", "RWMDHVNYSBKU", "AAAAAAACCCGT").alias("seq"))


def classify(spark: SparkSession, archive: Archive, reads: DataFrame, out: str) -> dict[str, DataFrame]:
    """The read table, profile, CAMI profile and read trace of `reads` (read, seq), written below `out` and given back."""
    from strandlake.operators import profile
    from strandlake.plans import model as steps

    run = Run(spark, archive, reads, f"{out}/spool")
    decided = steps.readout(run)
    lines = steps.read_lines(decided, steps._top(steps.pruned(run)), steps._top(steps.blended(run)), reads)
    rows = run.spool.held("abundance", lambda: steps.abundance(run))
    made = {"Profile": profile.table(rows).orderBy("place").drop("place"), "Cami": profile.cami(rows), "Trace": profile.read_trace(decided, rows)}
    files.write_ragged(lines, f"{out}/Classify.tsv", "line")
    for name, df in made.items():
        files.write_tsv(df, f"{out}/{name}.tsv")
    return {"Classify": lines} | made
