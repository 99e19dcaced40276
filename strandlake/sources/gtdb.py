"""Genome taxonomy metadata: representatives of species clusters, lineages of accessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import scalars as S

#: fixed values: what counts as true in a metadata column
TRUE = ("t", "true", "1", "yes")
USED = ("accession", "gtdb_representative", "gtdb_taxonomy", "ncbi_organism_name", "ncbi_assembly_name")


def truthy(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*TRUE)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The used columns of metadata files, plain or gzip, whatever else they hold; a missing column is null."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in USED))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(accession, taxonomy) of species cluster files, from the columns that name a representative genome and a taxonomy."""
    raw = spark.read.csv(path, sep="\t", header=True)
    by = {c.lower(): c for c in raw.columns}
    rep = next((by[c] for c in ("representative genome", "representative_genome", "representative") if c in by), None) or next((by[c] for c in by if "representative" in c and "genome" in c), None)
    if rep is None:
        raise ValueError(f"{path}: no column of representative genomes")
    tax = next((by[c] for c in by if "gtdb" in c and "tax" in c), None) or next((by[c] for c in by if c.endswith("taxonomy")), None)
    taxonomy = F.trim(F.col(f"`{tax}`")) if tax else F.lit("")
    return raw.select(F.trim(F.col(f"`{rep}`")).alias("accession"), F.coalesce(taxonomy, F.lit("")).alias("taxonomy")).where(F.coalesce(F.col("accession"), F.lit("")) != "")


def kingdom(lineage: Column) -> Column:
    return F.when(lineage.startswith("d__Archaea"), "archaea").when(lineage.startswith("d__Bacteria"), "bacteria")


def bare(accession: Column) -> Column:
    """An accession without the prefix of its collection."""
    return F.regexp_replace(F.trim(accession), "^(RS_|GB_)", "")


def lineages(meta: DataFrame, targets: DataFrame) -> DataFrame:
    """(accession, node, name) of the target accessions: the deepest entry of their lineage and its name; the first row in the order of lineages wins."""
    rows = meta.select(bare(F.col("accession")).alias("accession"), S.deepest(F.col("gtdb_taxonomy")).alias("node")).where("node is not null")
    found = rows.join(targets.select("accession").distinct(), "accession", "left_semi").groupBy("accession").agg(F.min("node").alias("node"))
    return found.select("accession", "node", F.substring("node", 4, 1_000_000).alias("name"))


def representatives(meta: DataFrame, cluster: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(accession, taxonomy, kingdom, organism, assembly_name): a row a representative genome.

    Rows of the metadata that are marked as representatives, of the allowed kingdoms, and, if
    clusters are given, named there; then the clusters' genomes that the metadata lacks. Of
    rows that repeat an accession the one with the least taxonomy stays.
    """
    own = cluster.select(bare(F.col("accession")).alias("accession"), F.col("taxonomy").alias("cluster_taxonomy")).groupBy("accession").agg(F.min("cluster_taxonomy").alias("cluster_taxonomy"))
    text = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.trim(c))
    rows = meta.where(truthy(F.col("gtdb_representative"))).withColumn("kingdom", kingdom(F.col("gtdb_taxonomy")))
    if allowed:
        rows = rows.where(F.col("kingdom").isNull() | F.col("kingdom").isin(*allowed))
    rows = rows.select(bare(F.col("accession")).alias("accession"), text("gtdb_taxonomy").alias("taxonomy"), "kingdom", text("ncbi_organism_name").alias("organism"), text("ncbi_assembly_name").alias("assembly_name"))
    one = rows.where("accession <> ''").groupBy("accession").agg(F.min(F.struct(*(c for c in rows.columns if c != "accession"))).alias("x")).select("accession", "x.*")
    some = own.agg(F.count("*").alias("clusters"))  # one row
    named = one.join(own, "accession", "left").crossJoin(F.broadcast(some)).where((F.col("clusters") == 0) | F.col("cluster_taxonomy").isNotNull())
    taxonomy = F.coalesce("taxonomy", F.nullif("cluster_taxonomy", F.lit("")), "accession")
    first = named.select("accession", taxonomy.alias("taxonomy"), F.coalesce("kingdom", F.lit("bacteria")).alias("kingdom"), F.coalesce("organism", taxonomy).alias("organism"), F.coalesce("assembly_name", F.lit("")).alias("assembly_name"))
    name = F.coalesce(F.nullif("cluster_taxonomy", F.lit("")), F.col("accession"))
    rest = own.join(first, "accession", "left_anti").select("accession", name.alias("taxonomy"), F.coalesce(kingdom(F.col("cluster_taxonomy")), F.lit("bacteria")).alias("kingdom"), name.alias("organism"), F.lit("").alias("assembly_name"))
    return first.unionAll(rest)
