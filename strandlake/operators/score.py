"""Scoring reads against taxa, and choosing candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandlake.functions import scalars as S


LOW = 2047  # the bits of a hash that evidence keeps: it is sampled by its remainders by 8 and 32, bitmaps take that by 2,048


def weighed(rows: DataFrame, counters: int, bins: int, s: float) -> DataFrame:
    """Adds strength and weight to read features (read, pos, hash, deg, dfb, bin, df, taxa); keeps the low bits of the hash alone."""
    own = F.when((F.col("deg") == 1) & (F.col("dfb") > 1), 1).otherwise(F.col("dfb"))
    dfi = S.lerp(F.col("dfb").cast("double"), own.cast("double"), s)
    bonus = 1 + 2 / (1 + F.log2(F.col("dfb")))
    strength = F.when((F.col("deg") == 1) & (F.col("dfb") == 1) & (F.col("df") <= 1), 1.0).when((F.col("deg") == 1) & (F.col("dfb") > 1), s).otherwise(0.0)
    weight = S.idf(F.lit(bins), dfi, s) * S.background(F.lit(counters), F.col("df")) * (1 + strength * (bonus - 1)) / F.log2(2 + F.col("deg"))
    low = F.col("hash").bitwiseAND(F.lit(LOW)).alias("hash")
    return rows.select("read", "pos", low, F.col("deg").cast("long").alias("deg"), F.col("dfb").cast("long").alias("dfb"), "bin", strength.alias("strength"), weight.alias("weight"), "taxa")


def contributions(reads: DataFrame, idx: DataFrame, df: DataFrame, numbers: DataFrame, counters: int, bins: int, s: float) -> DataFrame:
    """One row a read feature occurrence that the index holds: degree, weight, strength, and the numbers of the taxa that it hits.

    What the index holds of a hash is put together before the reads meet it, so an occurrence stays one row.
    """
    per = coded(idx.select("hash", "bin", "species", "genus"), numbers).groupBy("hash")
    per = per.agg(F.size(F.collect_set("species")).alias("deg"), F.size(F.collect_set("bin")).alias("dfb"), F.min("bin").alias("bin"), F.collect_set("taxon").alias("taxa"))
    per = per.join(df.select("hash", "df"), "hash", "left")
    return weighed(reads.select("read", "pos", "hash").distinct().join(per, "hash"), counters, bins, s)


def shared(reads: DataFrame, feats: DataFrame, numbers: DataFrame, limits: dict, bins: int, s: float, offset: int) -> DataFrame:
    """contributions() of `reads` (read, pos, hash) and of the references themselves, each read as `offset` + tid, in one shuffle.

    `feats` (tid, genus, species, bin, pos, hash) are all features of the references. All
    occurrences of a class of hashes meet, so its frequency, the degrees and the taxa come
    from windows there, and no index is written or joined; a row is dealt out without its names.
    """
    own = coded(feats, numbers).select((F.col("tid") + offset).cast("long").alias("read"), "pos", "hash", "taxon")
    rows = unpacked(packed(own.unionAll(reads.select("read", "pos", "hash", F.lit(None).cast("long")))).repartition(_class()))  # others than the references' have no taxon
    rows = rows.sortWithinPartitions("h22", "hash", "read", "pos")
    one, part = F.col("taxon").isNotNull().cast("int"), W.partitionBy("h22", "hash")
    rows = rows.withColumn("seen", F.sum(one).over(W.partitionBy("h22")))
    if limits["enabled"] is not False:  # null without references
        rows = rows.where(F.col("seen") < F.lit(limits["threshold"]).cast("long"))
    rows = rows.drop("seen")
    bin_ = F.when(F.col("taxon").isNotNull(), F.pmod(F.col("read") - offset, F.lit(bins)))
    rows = rows.withColumn("df", F.sum(one).over(part)).withColumn("taxa", F.collect_set("taxon").over(part)).withColumn("dfb", F.size(F.collect_set(bin_).over(part))).withColumn("bin", F.min(bin_).over(part))
    before = F.lag(F.struct("read", "pos")).over(part.orderBy("read", "pos"))  # rows of an id that occurs twice are one read's
    rows = rows.withColumn("again", before.eqNullSafe(F.struct("read", "pos"))).where(~F.col("again") & (F.col("df") > 0))
    species = F.size(F.array_distinct(F.transform("taxa", lambda x: F.shiftright(x, 16))))  # the upper bits are the species'
    deg = F.when(F.size("taxa") == 1, 1).otherwise(species)
    return weighed(rows.withColumn("deg", deg), limits["counters"], bins, s)


def _class() -> Column:
    """The class of a packed row's hash, its lower 22 bits."""
    return F.col("key").bitwiseAND(F.lit(4194303)).cast("int")


def packed(rows: DataFrame) -> DataFrame:
    """(read, at, key) of rows (read, pos, hash, taxon), for a shuffle: what differs between a read's features is in one number, its hash of 56 bits and the low eight of pos."""
    at = F.shiftleft(F.coalesce("taxon", F.lit(-1)) + 1, 23).bitwiseOR(F.shiftright("pos", 8))
    key = F.shiftleft(F.col("pos").cast("long"), 56).bitwiseOR(F.col("hash"))
    return rows.select("read", at.alias("at"), key.alias("key"))


def unpacked(rows: DataFrame) -> DataFrame:
    """(read, pos, hash, taxon) and h22, the class of the hash, again."""
    pos = F.shiftleft(F.col("at").bitwiseAND(F.lit(8388607)), 8).bitwiseOR(F.shiftrightunsigned("key", 56)).cast("int")
    taxon = F.shiftright("at", 23) - 1
    return rows.select("read", pos.alias("pos"), F.col("key").bitwiseAND(F.lit((1 << 56) - 1)).alias("hash"), F.when(taxon >= 0, taxon).alias("taxon"), _class().alias("h22"))


def coded(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Adds taxon, the number of (species, genus) in `numbers`."""
    n = F.broadcast(numbers.select(F.col("species").alias("__s"), F.col("genus").alias("__g"), "taxon"))  # a row a taxon
    return rows.join(n, F.col("species").eqNullSafe(F.col("__s")) & F.col("genus").eqNullSafe(F.col("__g"))).drop("__s", "__g")


def named(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Species and genus instead of taxon."""
    return rows.join(F.broadcast(numbers), "taxon").drop("taxon")  # a row a taxon


def scores(parts: DataFrame, numbers: DataFrame) -> DataFrame:
    """(read, species, genus, score, uniq, hits, evaluated, n): summed over occurrences, each counted once to `evaluated`; sums don't depend on the order."""
    part = W.partitionBy("read")
    rows = parts.select("read", "weight", F.when(F.col("deg") == 1, F.col("strength")).otherwise(0.0).alias("strength"), "taxa")
    rows = rows.withColumn("evaluated", S.added("weight", lambda x: F.sum(x).over(part))).withColumn("n", F.count("*").over(part))
    rows = rows.withColumn("taxon", F.explode("taxa")).groupBy("read", "taxon").agg(S.added("weight").alias("score"), F.sum("strength").alias("uniq"), F.count("*").alias("hits"), F.first("evaluated").alias("evaluated"), F.first("n").alias("n"))
    return named(rows, numbers).select("read", "species", "genus", "score", "uniq", "hits", "evaluated", "n")


def stretch(parts: DataFrame, k: int, n: int) -> DataFrame:
    """The evidence of an n-th of the reads; a read's stays whole."""
    return parts.where(F.pmod(F.xxhash64("read"), F.lit(n)) == k) if n > 1 else parts


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rn: by score, then name."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("read").orderBy(F.desc(F.round("score", 9)), "species")))


def top_two(rows: DataFrame) -> DataFrame:
    """(read, species, best, second, gap, ratio, ...) of each read."""
    r = ranked(rows)
    second = F.lead("score").over(W.partitionBy("read").orderBy("rn"))
    out = r.withColumn("second", F.coalesce(second, F.lit(0.0))).where("rn = 1").withColumnRenamed("score", "best")
    return out.withColumn("gap", F.col("best") - F.col("second")).withColumn("ratio", F.when(F.col("second") > 0, F.col("best") / F.col("second")).otherwise(F.lit(99.0)))


def margin(best, second, evaluated):
    """Whether best leads second by a need that grows with what has been evaluated."""
    return best - second >= F.floor(0.35 * F.sqrt(evaluated) + 1)


def confident(tops: DataFrame) -> DataFrame:
    """Adds `confident` to rows of top_two."""
    e, best = F.col("evaluated"), F.col("best")
    uniq = (F.col("uniq") >= 3) | ((F.col("uniq") >= 2) & (F.col("uniq") >= 0.12 * F.col("n")))
    lead = (F.col("gap") >= F.greatest(F.lit(0.5), e / 24)) & (F.col("ratio") >= 1.35)
    return tops.withColumn("confident", (best >= F.ceil(0.7 * e)) & uniq & lead & margin(best, F.col("second"), e))


def thresholds(reads: DataFrame, s: float, shot: float = 0.7, beta: tuple[float, float] = (0.5, 0.45)) -> DataFrame:
    """Adds low, high and thr to rows (read, best, evaluated, n) of reads that go to the mixture."""
    e, n = F.col("evaluated"), F.col("n")
    by_best = F.floor(S.lerp(*beta, s) * F.least(F.col("best"), e))
    by_eval = F.least(F.greatest(F.lit(1), F.ceil(shot * e)), F.greatest(F.lit(1), F.ceil(0.45 * e)))
    least = F.greatest(F.ceil(0.15 * n), F.lit(4))
    high = F.greatest(F.least(by_best, by_eval), F.lit(1), least)
    low = F.greatest(by_eval, F.greatest(F.lit(1), F.floor(0.3 * least)))
    return reads.withColumn("low", low).withColumn("high", high).withColumn("thr", S.lerp(low.cast("double"), high.cast("double"), s))


def retained(rows: DataFrame, thr: DataFrame, s: float, most: int = 128) -> DataFrame:
    """Candidates above their read's threshold, or within the floor that the community leaves."""
    r = ranked(rows).withColumn("cands", F.count("*").over(W.partitionBy("read"))).join(thr.select("read", "thr"), "read")
    floor = F.round((1 - s) * F.least(F.lit(most), F.col("cands")))
    return r.where((F.col("rn") <= floor) | (F.col("score") >= F.col("thr")))


def costly(rows: DataFrame, taxa: int) -> DataFrame:
    """The best, and others that outweigh the cost of one more: half the log of all taxa plus the log of the read's."""
    r = ranked(rows).withColumn("cands", F.count("*").over(W.partitionBy("read")))
    return r.where((F.col("rn") == 1) | (F.col("score") >= 0.5 * F.log(F.lit(float(taxa))) + F.log(F.col("cands").cast("double"))))


def mixture_cap(rows: DataFrame) -> DataFrame:
    """At most the square of the effective number of candidates, rounded up."""
    part = W.partitionBy("read")
    eff = F.pow(F.sum("score").over(part), F.lit(2.0)) / F.sum(F.col("score") * F.col("score")).over(part)
    return ranked(rows.withColumn("eff", eff)).where(F.col("rn") <= F.ceil(F.round(F.col("eff") * F.col("eff"), 6)))


def staged(parts: DataFrame, first: int = 64) -> DataFrame:
    """Adds stage: 0 the first features of a read, 1 those whose hash eight divides, 2 the rest."""
    at = F.row_number().over(W.partitionBy("read").orderBy("pos"))
    return parts.withColumn("stage", F.when(at <= first, 0).when(F.col("hash").bitwiseAND(F.lit(7)) == 0, 1).otherwise(2))


def shrunk(rows: DataFrame) -> DataFrame:
    """Score with completion evidence shrunk by what the genus has in the read: base + comp * S / (S + comp)."""
    s = F.sum("base").over(W.partitionBy("read", "genus"))
    value = F.col("base") + F.when(s + F.col("comp") > 0, F.col("comp") * s / (s + F.col("comp"))).otherwise(0.0)
    return rows.withColumn("value", value)


def competitors(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Per read, other candidates of the best one's genus with at least a share of its score."""
    r = ranked(rows)
    head = F.first(F.struct("genus", "score")).over(W.partitionBy("read").orderBy("rn"))
    hit = (F.col("rn") > 1) & (F.col("rn") <= 64) & (F.col("genus") == F.col("h.genus")) & (F.col("score") >= share * F.col("h.score"))
    return r.withColumn("h", head).groupBy("read").agg(F.sum(hit.cast("long")).alias("competitors"))


def rescued(rows: DataFrame, thr: DataFrame, kept: DataFrame, scan: int = 64) -> DataFrame:
    """(read, species, place): candidates that are rescued besides those `kept` (read, species), by priority, score and name.

    Of the first `scan` those above a floor: of the best one's genus first, then those of
    half its score, then others; as many as 1 + ceil(7 u) less those kept. The uncertainty u
    grows with a narrow lead, competitors in the genus and little unique evidence.
    """
    part = W.partitionBy("read")
    score = F.greatest(F.lit(0.0), F.least(F.greatest(F.lit(1.0), F.col("evaluated")), F.col("score")))
    r = ranked(rows).withColumn("score", score).where(F.col("rn") <= scan)
    at = lambda k, c: F.max(F.when(F.col("rn") == k, F.col(c))).over(part)
    r = r.withColumn("best", at(1, "score")).withColumn("second", F.coalesce(at(2, "score"), F.lit(0.0))).withColumn("home", at(1, "genus")).withColumn("own", at(1, "uniq"))
    r = r.withColumn("rivals", F.sum(((F.col("rn") > 1) & (F.col("genus") == F.col("home"))).cast("int")).over(part))
    unit = lambda x: S.clamp(x, 0.0, 1.0)
    gap = 1 - unit((F.col("best") - F.col("second")) / F.greatest(F.col("best"), F.lit(1e-6)))
    alone = 1 - unit(F.col("own") / F.col("evaluated") / 0.25)
    u = unit(0.45 * gap + 0.35 * unit(F.col("rivals") / 4) + 0.2 * alone)
    r = r.withColumn("u", F.round(u, 9)).join(kept.select("read", "species", F.lit(True).alias("has")), ["read", "species"], "left")
    r = r.withColumn("held", F.count("has").over(part)).join(thr.select("read", "thr"), "read")
    r = r.where(F.col("has").isNull() & (F.col("score") >= F.greatest(0.25 * F.col("best"), 0.5 * F.col("thr"))))
    priority = F.when(F.col("genus") == F.col("home"), 0).when(F.col("score") >= 0.5 * F.col("best"), 1).otherwise(2)
    place = F.row_number().over(part.orderBy(priority, F.desc(F.round("score", 9)), "species"))
    return r.withColumn("place", place).where(F.col("place") <= 1 + F.ceil(7 * F.col("u")) - F.col("held")).select("read", "species", "place")
