"""Probing the feature index: joins, sampling, routing and coarse evidence of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def index(feats: DataFrame) -> DataFrame:
    """The feature index: distinct (hash, bin, tid, species, genus)."""
    return feats.select("hash", "bin", "tid", "species", "genus").distinct()


def probe(reads: DataFrame, idx: DataFrame) -> DataFrame:
    """Each read feature with all its index entries; an equi-join, so a bucketed index isn't moved."""
    return reads.join(idx, "hash")


def route(reads: DataFrame, idx: DataFrame) -> DataFrame:
    return probe(reads.select("read", "hash"), idx.select("hash", "bin")).select("read", "hash", "bin").distinct()


def subset(hits: DataFrame, bins: DataFrame) -> DataFrame:
    """Hits in the bins chosen for their read."""
    return hits.join(bins, ["read", "bin"], "left_semi")


def sample(reads: DataFrame, df: DataFrame, lo: int = 16, hi: int = 96) -> DataFrame:
    """(read, hash) of at most `budget` features: half of them the rarest of a stride, then an even stride.

    The budget is half the features, within [lo, hi]; up to that many, all are taken.
    """
    n = F.count("*").over(W.partitionBy("read"))
    rows = reads.withColumn("n", n).withColumn("place", F.row_number().over(W.partitionBy("read").orderBy("pos")) - 1)
    target = F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor(F.col("n") / 2)))
    rows = rows.withColumn("budget", F.least(target, F.col("n"))).join(df.select("hash", "df"), "hash", "left").na.fill(0, ["df"])
    over = F.least(F.col("n"), 8 * F.col("budget"))
    rows = rows.withColumn("in_stride", F.col("place") % F.floor(F.col("n") / over) == 0)
    rows = rows.withColumn("rare", F.row_number().over(W.partitionBy("read").orderBy(F.desc("in_stride"), "df", "hash", "pos")))
    quota = F.greatest(F.lit(1), F.floor(F.col("budget") / 2))
    even = F.col("place") % F.greatest(F.lit(1), F.floor(F.col("n") / F.col("budget"))) == 0
    rows = rows.withColumn("first", (F.col("n") <= F.col("budget")) | (F.col("in_stride") & (F.col("rare") <= quota)))
    rows = rows.where(F.col("first") | even).groupBy("read", "hash").agg(F.max("first").alias("first"), F.max("budget").alias("budget"))
    rank = F.row_number().over(W.partitionBy("read").orderBy(F.desc("first"), "hash"))
    return rows.withColumn("r", rank).where("r <= budget").select("read", "hash")


def rarest_half(sampled: DataFrame, df: DataFrame) -> DataFrame:
    """The rarer half, rounded, of each read's sampled features."""
    rows = sampled.join(df.select("hash", "df"), "hash", "left").na.fill(0, ["df"])
    n = F.count("*").over(W.partitionBy("read"))
    r = F.row_number().over(W.partitionBy("read").orderBy("df", "hash"))
    return rows.withColumn("n", n).withColumn("r", r).where(F.col("r") <= F.round(0.5 * F.col("n"))).select("read", "hash")


def coarse(sampled: DataFrame, idx: DataFrame, level: str) -> DataFrame:
    """(read, level, evidence): distinct (hash, bin, tid) hits of the sampled features by bin, species or genus."""
    hits = probe(sampled, idx).select("read", "hash", "bin", "tid", "species", "genus").distinct()
    return hits.groupBy("read", level).agg(F.count("*").alias("evidence"))


def rare_support(routed: DataFrame, idx: DataFrame, df: DataFrame, level: str) -> DataFrame:
    """(read, level, support): features with at most two bins or two occurrences that hit it."""
    hits = probe(routed, idx)
    few = hits.groupBy("read", "hash").agg(F.countDistinct("bin").alias("bins")).join(df.select("hash", "df"), "hash", "left").where("bins <= 2 or df <= 2")
    return hits.join(few.select("read", "hash"), ["read", "hash"]).groupBy("read", level).agg(F.countDistinct("hash").alias("support"))


def mass_prefix(rows: DataFrame, by: str, value: str, tie: str, share: float) -> DataFrame:
    """The largest rows that first reach a share of their group's mass."""
    own = W.partitionBy(by).orderBy(F.desc(value), tie).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(value).over(W.partitionBy(by))
    return rows.withColumn("held", F.sum(value).over(own)).withColumn("goal", share * total).where(F.col("held") - F.col(value) < F.col("goal")).drop("held", "goal")


def simpson(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Adds share, effective number and rank of each row in its group."""
    part = W.partitionBy(by)
    out = rows.withColumn("p", F.col(value) / F.sum(value).over(part))
    return out.withColumn("eff", 1 / F.sum(F.col("p") * F.col("p")).over(part))


def core_cap(rows: DataFrame, by: str, value: str, tie: str, base: int, most: int) -> DataFrame:
    """Rows up to the cap that the mass outside the core leaves: base + (most - base)(1 - core)^2, rounded up."""
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc(value), tie))
    out = simpson(rows, by, value).withColumn("r", r)
    core = F.sum(F.when(F.col("r") <= F.ceil(F.round("eff", 9)), F.col("p")).otherwise(0.0)).over(W.partitionBy(by))
    cap = F.ceil(F.round(base + (most - base) * F.pow(1 - core, F.lit(2.0)), 9))
    return out.withColumn("cap", F.greatest(F.lit(1), cap)).where("r <= cap").drop("p", "eff")


def weighted_cap(rows: DataFrame, by: str, score: str, low_degree: str, tie: str, most: int) -> DataFrame:
    weight = 4 * F.col(score) + F.lit(4294967296) * F.col(low_degree)
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc("weight"), tie))
    return rows.withColumn("weight", weight.cast("long")).withColumn("r", r).where(F.col("r") <= most)


def caps(bins: int, s: float) -> tuple[int, int]:
    """The least and the most bins that a read is evaluated in, for an index of so many bins and a dispersion."""
    return min(bins, round(256 + 64 * s)), min(bins, round(512 + 128 * s))


def adaptive_surface(coarse: DataFrame, rare: DataFrame, genus_rare: DataFrame, lengths: DataFrame, s: float) -> DataFrame:
    """(read, species, place): the representatives that a read is evaluated against, if few genera hold its evidence.

    `coarse` (read, species, genus, evidence), `rare` (read, species, support), `genus_rare`
    (read, genus, support), `lengths` (read, n). First the strongest; then others of the
    dominant genus and the best of other genera, those with rare features first, up to a
    limit each; then by evidence. Reads whose evidence is spread give no rows.
    """
    part = W.partitionBy("read")
    rows = coarse.join(lengths, "read").join(rare.withColumnRenamed("support", "rare"), ["read", "species"], "left").join(genus_rare.withColumnRenamed("support", "grare"), ["read", "genus"], "left").na.fill(0, ["rare", "grare"])
    rows = rows.withColumn("short", F.col("n") <= 600).withColumn("total", F.sum("evidence").over(part)).withColumn("gm", F.sum("evidence").over(W.partitionBy("read", "genus")))
    rows = rows.withColumn("r", F.row_number().over(part.orderBy(F.desc("evidence"), "species"))).withColumn("g", F.dense_rank().over(part.orderBy(F.desc("gm"), "genus")))
    rows = rows.withColumn("share", F.max("gm").over(part) / F.col("total")).withColumn("head", F.sum(F.when(F.col("r") <= 10, F.col("evidence")).otherwise(0)).over(part) / F.col("total"))
    rows = rows.withColumn("best", F.max("evidence").over(part))
    rows = rows.withColumn("crowd", F.sum(((F.col("g") == 1) & (10 * F.col("evidence") >= 4 * F.col("best"))).cast("int")).over(part))
    spread = F.when(F.col("short"), s > 0.2).otherwise(s > 0.35)
    dense = (F.col("share") >= 0.72) | (F.col("short") & (F.col("share") >= 0.6)) | ((F.col("head") >= 0.55) & (F.col("share") >= 0.65)) | (F.col("crowd") >= 3)
    rows = rows.where(spread & dense)
    first = F.col("r") == 1
    home = F.row_number().over(W.partitionBy("read", "genus").orderBy(first.cast("int"), F.desc("rare"), F.desc("evidence"), "species"))  # the strongest is in already
    best = F.row_number().over(W.partitionBy("read", "genus").orderBy(F.desc("rare"), F.desc("evidence"), "species"))
    rows = rows.withColumn("home", home).withColumn("pick", ~first & (F.col("g") > 1) & (best == 1))
    away = F.row_number().over(part.orderBy(F.desc("pick"), F.desc("grare"), F.desc("gm"), "genus", "species"))
    rows = rows.withColumn("away", away)
    most_home, most_away = F.when(F.col("short"), 4).otherwise(2), F.when(F.col("short"), 5).otherwise(2)
    tier = F.when(first, 0).when((F.col("g") == 1) & (F.col("home") <= most_home), 1).when(F.col("pick") & (F.col("away") <= most_away), 2).otherwise(3)
    rows = rows.withColumn("tier", tier)
    within = F.when(F.col("tier") == 1, F.col("home")).when(F.col("tier") == 2, F.col("away")).otherwise(F.col("r"))
    rows = rows.withColumn("place", F.row_number().over(part.orderBy("tier", within)))
    return rows.where(F.col("place") <= F.when(F.col("short"), 16).otherwise(6)).select("read", "species", "genus", "place")


def completed(chosen: DataFrame, dictionary: DataFrame) -> DataFrame:
    """All bins of the chosen representatives of each read."""
    return chosen.join(dictionary, "species").select("read", "bin").distinct()
