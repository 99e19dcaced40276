"""From decisions to abundance profiles, and the tables that are written of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec


def whole() -> WindowSpec:
    """All rows of a table of one row a taxon."""
    return W.partitionBy(F.lit(1))


def normalised(rows: DataFrame, by: str, count: str, length: str, callable_: str, unique: str) -> DataFrame:
    """(by, four shares): counts over the median length, its root, callable and unique signatures, each adding up to one."""
    per = rows.groupBy(by).agg(F.sum(count).cast("double").alias("n"), F.median(length).alias("len"), F.median(callable_).alias("call"), F.median(unique).alias("uni"))
    kinds = {"by_length": F.col("n") / F.col("len"), "by_root": F.col("n") / F.sqrt("len"), "by_callable": F.col("n") / F.greatest("call", F.lit(1.0)), "by_unique": F.col("n") / F.greatest("uni", F.lit(1.0))}
    out = per.select(by, *(v.alias(k) for k, v in kinds.items()))
    return out.select(by, *((F.col(k) / F.sum(k).over(whole())).alias(k) for k in kinds))


def shared_mass(post: DataFrame, genus: str = "genus") -> DataFrame:
    """(species, mass): each read's mass among the species of its best one's genus, by the root of their posteriors."""
    rows = post.groupBy("read", "species", genus).agg(F.max("q").alias("q"))
    best = F.max(F.struct(F.round("q", 9).alias("q"), F.col(genus).alias("g"))).over(W.partitionBy("read"))
    rows = rows.withColumn("best", best).where(F.col(genus) == F.col("best.g")).withColumn("r", F.sqrt("q"))
    return rows.withColumn("p", F.col("r") / F.sum("r").over(W.partitionBy("read"))).groupBy("species").agg(F.sum("p").alias("mass"))


def floor_percent(eff: Column) -> Column:
    """The least percentage that is reported, between a hundredth and a twentieth of one per cent."""
    return F.greatest(F.lit(0.01), F.least(F.lit(0.05), 0.5 / eff))


def least_support(reads: Column) -> Column:
    return F.least(reads, F.greatest(F.lit(3), F.ceil(0.01 * F.sqrt(reads))))


def reportable(rows: DataFrame, value: str, support: str, sources: str, callable_: str, reads: Column, response: Column | None = None) -> DataFrame:
    """Adds raw_abundance, kept, reportability and relative_abundance to a row a taxon.

    The first reason that holds: no callable signatures, too few of `reads`, a share of the
    whole below the floor in per cent; the rest is kept if it has a response (by default its
    share), and the responses of those kept add up to one.
    """
    total = F.sum(value).over(whole())
    out = rows.withColumn("raw_abundance", F.when(total > 0, F.col(value) / total).otherwise(0.0))
    out = out.withColumn("eff", 1 / F.sum(F.col("raw_abundance") * F.col("raw_abundance")).over(whole()))
    answer = F.col("raw_abundance") if response is None else F.coalesce(response, F.lit(0.0))
    name = (
        F.when(~F.coalesce(F.col(callable_) > 0, F.lit(False)), "nuisance_no_callable_exposure")
        .when(F.col(support) < least_support(reads), "nuisance_low_runtime_support")
        .when(100 * F.col("raw_abundance") < floor_percent(F.col("eff")), "nuisance_below_dynamic_detection_floor")
        .when(~(answer > 0), "nuisance_no_abundance_response")
        .when(F.col(sources) <= 1, "single_source_limited_reportable")
        .otherwise("classifier_response_reportable")
    )
    out = out.withColumn("reportability", name).withColumn("kept", ~F.col("reportability").startswith("nuisance"))
    mass = F.when(F.col("kept"), answer).otherwise(0.0)
    return out.withColumn("relative_abundance", F.coalesce(mass / F.nullif(F.sum(mass).over(whole()), F.lit(0.0)), F.lit(0.0))).drop("eff")


def species_in_genus(rows: DataFrame, genus: str, species: str) -> DataFrame:
    return rows.groupBy(genus).agg(F.countDistinct(species).alias("species"))


def observed(decisions: DataFrame, coverage: DataFrame, taxa: DataFrame) -> DataFrame:
    """A row a species decided on: its counts, reads, callable signatures, sources, and the counts a callable signature."""
    per = decisions.where("species <> 'unclassified'").groupBy("species").agg(F.sum("count").alias("mass"), F.countDistinct("read").alias("read_support"))
    out = per.join(coverage.select("species", F.col("total").alias("callable")), "species", "left").join(taxa, "species", "left")
    return out.withColumn("observation", F.when(F.col("callable") > 0, F.col("mass") / F.col("callable")).otherwise(0.0))


def table(rows: DataFrame) -> DataFrame:
    """The profile as it is written, seventeen columns and the place that orders them: by abundance, what is kept, raw share, name."""
    place = F.row_number().over(W.orderBy(F.desc(F.round("relative_abundance", 9)), F.desc("kept"), F.desc(F.round("raw_abundance", 9)), "species"))  # a row a taxon
    line = F.concat_ws(";", F.lit("root"), "genus", "species")
    return rows.select(
        place.alias("place"), F.lit("species").alias("rank"), F.col("species").alias("taxid"), F.col("species").alias("name"), F.round("relative_abundance", 6).alias("relative_abundance"), F.round(100 * F.col("relative_abundance"), 4).alias("percentage"),
        "read_support", F.round("mass", 6).alias("assigned_mass"), F.col("callable").alias("effective_yield"), F.col("sources").alias("measurement_unit_support"), F.col("genus").alias("parent_taxid"), F.col("genus").alias("parent_name"),
        F.col("genus").alias("genus_taxid"), F.col("genus").alias("genus_name"), line.alias("lineage_taxids"), line.alias("lineage_names"), (F.col("sources") <= 1).alias("single_source_limited"), "reportability",
    )


def cami(rows: DataFrame) -> DataFrame:
    """Taxa that are reported, by species and by genus, with their paths."""
    rows = rows.where("kept").withColumn("percent", 100 * F.col("relative_abundance"))
    path = F.concat_ws("|", "genus", "species")
    own = rows.select(F.col("species").alias("taxid"), F.lit("species").alias("rank"), path.alias("taxpath"), path.alias("taxpathsn"), F.round("percent", 4).alias("percentage"))
    up = rows.groupBy("genus").agg(F.round(F.sum("percent"), 4).alias("percentage"))
    return own.unionAll(up.select("genus", F.lit("genus"), "genus", "genus", "percentage"))


def read_trace(decisions: DataFrame, profile: DataFrame) -> DataFrame:
    """(read, species, mode, weight, contribution, percentage): what each read adds to its species' abundance; a species' shares add up to it."""
    rows = decisions.join(profile.where("kept").select("species", "relative_abundance", "mass"), "species")
    part = F.col("count") / F.col("mass") * F.col("relative_abundance")
    return rows.select("read", "species", "mode", F.col("count").alias("weight"), part.alias("contribution"), (100 * part).alias("percentage_contribution"))


def active_set(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """The largest taxa that make up a share of the whole."""
    held = F.sum(value).over(W.partitionBy(F.lit(1)).orderBy(F.desc(value), by).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("held", held).withColumn("total", F.sum(value).over(whole())).where(F.col("held") - F.col(value) < share * F.col("total")).drop("total")


def legacy(rows: DataFrame, species: str, count: str) -> DataFrame:
    """Counts by species, `unclassified` where there is none."""
    return rows.groupBy(F.coalesce(species, F.lit("unclassified")).alias("taxon")).agg(F.sum(count).alias("count"))


def krona(rows: DataFrame, taxid: str) -> DataFrame:
    """Counts by taxid, one too many as the format's readers have always had it."""
    return rows.groupBy(taxid).agg((F.count("*") + 1).alias("count"))
