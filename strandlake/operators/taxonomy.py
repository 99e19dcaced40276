"""Taxonomy trees as tables: closure, ancestors at a rank, lowest common ancestors, lineage strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandlake.sources.shared import cut

def closure(nodes: DataFrame) -> DataFrame:
    """(taxid, anc, dist) of each node (taxid, parent) with itself and all its ancestors.

    Paths double each round, so a tree of depth d takes log2(d) joins; a root is its own
    parent or has one that isn't a node. A cycle is an error.
    """
    nodes_ = nodes.count()
    step = nodes.where("taxid <> parent").select("taxid", F.col("parent").alias("anc"), F.lit(1).alias("dist"))
    known = nodes.select("taxid")
    step = step.join(known.select(F.col("taxid").alias("anc")), "anc", "left_semi").select("taxid", "anc", "dist")
    step = cut(step)
    all_, reach = step, 1
    while True:
        ahead = all_.select(F.col("taxid").alias("anc"), F.col("anc").alias("far"), F.col("dist").alias("more"))
        longer = all_.where(F.col("dist") == reach).join(ahead, "anc").select("taxid", F.col("far").alias("anc"), (F.col("dist") + F.col("more")).alias("dist"))
        longer = cut(longer)
        if longer.isEmpty():
            break
        if reach > nodes_:
            raise ValueError("the taxonomy has a cycle")
        all_, reach = all_.unionAll(longer), reach * 2
    return known.select("taxid", F.col("taxid").alias("anc"), F.lit(0).alias("dist")).unionAll(all_)


def at_rank(lineage: DataFrame, ranks: DataFrame, rank: str, own: bool) -> DataFrame:
    """(taxid, at): the nearest ancestor of a rank; without one, itself if `own`, else 0."""
    hit = lineage.join(ranks.where(F.col("rank") == rank).select(F.col("taxid").alias("anc")), "anc").groupBy("taxid").agg(F.min_by("anc", "dist").alias("at"))
    return ranks.select("taxid").join(hit, "taxid", "left").select("taxid", F.coalesce("at", F.col("taxid") if own else F.lit(0)).alias("at"))


def lca(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """(a, b, lca) of pairs (a, b): the common ancestor nearest to a."""
    left = lineage.select(F.col("taxid").alias("a"), "anc", F.col("dist").alias("d"))
    right = lineage.select(F.col("taxid").alias("b"), "anc")
    return pairs.join(left, "a").join(right, ["b", "anc"]).groupBy("a", "b").agg(F.min_by("anc", "d").alias("lca"))


def lineages(lineage: DataFrame, names: DataFrame) -> DataFrame:
    """(taxid, lineage_taxids, lineage_names): from the root down, joined by semicolons."""
    rows = lineage.join(names.select(F.col("taxid").alias("anc"), "name"), "anc").groupBy("taxid").agg(F.sort_array(F.collect_list(F.struct("dist", "anc", "name")), False).alias("x"))
    return rows.select("taxid", F.array_join(F.transform("x", lambda x: x["anc"].cast("string")), ";").alias("lineage_taxids"), F.array_join(F.transform("x", lambda x: x["name"]), ";").alias("lineage_names"))


def first_tid(taxa: DataFrame, species: str = "species", tid: str = "tid") -> DataFrame:
    """Adds rep: the smallest tid of the species."""
    return taxa.withColumn("rep", F.min(tid).over(W.partitionBy(species)))
