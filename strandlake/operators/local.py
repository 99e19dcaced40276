"""Local resolution: anchors, chains, panels of representatives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def rare_keys(anchors: DataFrame, most: int = 500) -> DataFrame:
    """Anchors whose key has at most `most` postings; counted by key and joined back, so a broad key isn't gathered."""
    few = anchors.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("key")
    return anchors.join(few, "key")


def anchor_hits(query: DataFrame, target: DataFrame) -> DataFrame:
    """(read, tid, qpos, tpos, orient) of equal keys."""
    q = query.select("read", "key", F.col("pos").alias("qpos"), F.col("strand").alias("qs"))
    t = target.select("tid", "key", F.col("pos").alias("tpos"), F.col("strand").alias("ts"))
    return q.join(t, "key").select("read", "tid", "qpos", "tpos", F.col("qs").bitwiseXOR(F.col("ts")).cast("int").alias("orient"))


def chains(hits: DataFrame, width: int = 256, least: int = 4) -> DataFrame:
    """(read, tid, orient, diag, n, score): anchors on a diagonal bin, cut towards zero; 50 an anchor and the span over 20."""
    shift = F.when(F.col("orient") == 0, F.col("tpos") - F.col("qpos")).otherwise(F.col("tpos") + F.col("qpos"))
    diag = (shift / width).cast("int")
    out = hits.groupBy("read", "tid", "orient", diag.alias("diag")).agg(F.count("*").alias("n"), (F.max("qpos") - F.min("qpos")).alias("qspan"), (F.max("tpos") - F.min("tpos")).alias("tspan"))
    span = F.floor(F.least("qspan", "tspan") / 20)
    return out.where(F.col("n") >= least).withColumn("score", (50 * F.col("n") + span).cast("long"))


def even_tokens(rows: DataFrame, by: str, order: str, budget: int = 256) -> DataFrame:
    """The rows at places floor(i n / budget), all of them if there are no more than the budget."""
    n = F.count("*").over(W.partitionBy(by))
    at = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    first = F.ceil(F.col("at") * budget / F.col("n"))  # the least i whose place can be this one
    hit = (F.col("n") <= budget) | ((first < budget) & (F.floor(first * F.col("n") / budget) == F.col("at")))
    return rows.withColumn("n", n).withColumn("at", at).where(hit).drop("n", "at")


def kept_targets(rows: DataFrame, most: int = 32, sources: int = 8) -> DataFrame:
    """Targets of a species, adding their place: those with most anchors, then the longest, then by name.

    Of a species the first sources to come up in that order stay, of each source its first targets.
    """
    part = W.partitionBy("species")
    order = [F.desc("anchors"), F.desc("length"), F.col("target")]
    r = rows.withColumn("rn", F.row_number().over(part.orderBy(*order)))
    r = r.withColumn("first", F.min("rn").over(W.partitionBy("species", "source"))).withColumn("s", F.dense_rank().over(part.orderBy("first"))).where(F.col("s") <= sources)
    r = r.withColumn("own", F.row_number().over(W.partitionBy("species", "source").orderBy("rn"))).where(F.col("own") <= most)
    return r.withColumn("place", F.row_number().over(part.orderBy("rn"))).drop("rn", "first", "s", "own")


def round_robin(rows: DataFrame) -> DataFrame:
    """Adds rank in the genus: the species' firsts, then their seconds, and so on."""
    r = rows.withColumn("turn", F.row_number().over(W.partitionBy("genus", "species").orderBy("place")))
    return r.withColumn("rank", F.row_number().over(W.partitionBy("genus").orderBy("turn", "species")))


def panel(rows: DataFrame, genera: int = 32, species: int = 8, targets: int = 32) -> DataFrame:
    """The targets to resolve with: of the heaviest genera the heaviest species, some targets a genus."""
    g = rows.groupBy("genus").agg(F.sum("mass").alias("gm"))
    g = g.withColumn("g", F.row_number().over(W.orderBy(F.desc(F.round("gm", 9)), "genus"))).where(F.col("g") <= genera)
    s = rows.groupBy("genus", "species").agg(F.sum("mass").alias("sm"))
    s = s.withColumn("s", F.row_number().over(W.partitionBy("genus").orderBy(F.desc(F.round("sm", 9)), "species"))).where(F.col("s") <= species)
    r = rows.join(F.broadcast(g.select("genus", "g")), "genus").join(s.select("genus", "species", "s"), ["genus", "species"])  # at most `genera` rows
    return r.withColumn("t", F.row_number().over(W.partitionBy("genus").orderBy("s", "target"))).where(F.col("t") <= targets)


def within_budget(rows: DataFrame, by: str, order: str, size: str, budget: int, schema: str) -> DataFrame:
    """Rows of each group that fit a byte budget, in order; one that doesn't fit is passed over. Groups are panels, so small."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        pdf = pdf.sort_values(order)
        for n in pdf[size]:
            keep.append(n <= left)
            left -= n if n <= left else 0
        return pdf[keep]

    return rows.groupBy(by).applyInPandas(take, schema)


def post_topk(post: DataFrame) -> DataFrame:
    """One row: reads, mean candidates, shares of reads with one candidate and of ambiguous ones, mean top posterior."""
    per = post.groupBy("read").agg(F.count("*").alias("n"), F.max("q").alias("top"))
    return per.agg(F.count("*").alias("reads"), F.avg("n").alias("items"), F.avg((F.col("n") == 1).cast("double")).alias("singleton"), F.avg((F.col("top") < 0.9).cast("double")).alias("ambiguous"), F.avg("top").alias("top1"))


def eligible(stats: DataFrame) -> DataFrame:
    return stats.withColumn("eligible", (F.col("items") >= 3) & (F.col("singleton") <= 0.5) & (F.col("top1") <= 0.85) & (F.col("ambiguous") >= 0.5))


def overridden(decisions: DataFrame, calls: DataFrame) -> DataFrame:
    """Decisions replaced by the best local call; a call without candidates makes a read unclassified."""
    best = calls.groupBy("read").agg(F.max(F.struct("score", F.col("taxon"))).alias("c"))
    out = decisions.join(best, "read", "left")
    return out.select("read", F.when(F.col("c").isNull(), F.col("species")).otherwise(F.coalesce("c.taxon", F.lit("unclassified"))).alias("species"), F.when(F.col("c").isNotNull() & F.col("c.taxon").isNull(), "local_resolution_absent").alias("reason"))


def batches(reads: Iterator, size: int = 400) -> Iterator[list]:
    """Lists of at most `size` reads, for imperative callers."""
    held: list = []
    for r in reads:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
