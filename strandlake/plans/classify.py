"""Queries of the classification side: probing, sampling, scoring and choosing candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import probe, score


from .base import BINS, DISPERSION, Base, query, r6

S9 = "round(score, 9)"
LEAST_BINS, MOST_BINS = probe.caps(BINS, DISPERSION)


@query("j1_feature_probe", "SELECT read, pos, hash, bin, tid FROM hits")
def _(b: Base):
    return b.hits.select("read", F.col("pos").cast("long").alias("pos"), "hash", "bin", "tid")


@query("j2_route_bins", "SELECT DISTINCT read, hash, bin FROM hits")
def _(b: Base):
    return probe.route(b.rfeat, b.index)


@query("j3_subset_probe", "SELECT read, pos, hash, bin, tid FROM hits h WHERE EXISTS (SELECT 1 FROM c WHERE c.read = h.read AND c.bin = h.bin)", ", c AS (SELECT read, bin FROM (SELECT read, bin, count(*) AS n FROM hits GROUP BY 1, 2) WHERE n >= 2)")
def _(b: Base):
    bins = b.hits.groupBy("read", "bin").agg(F.count("*").alias("n")).where("n >= 2").select("read", "bin")
    return probe.subset(b.hits, bins).select("read", F.col("pos").cast("long").alias("pos"), "hash", "bin", "tid")


@query("j4_bin_dictionary", "SELECT bin, (row_number() OVER (PARTITION BY bin ORDER BY tid) - 1)::INTEGER AS slot, tid FROM (SELECT DISTINCT bin, tid FROM idx)")
def _(b: Base):
    from pyspark.sql.window import Window as W

    return b.index.select("bin", "tid").distinct().withColumn("slot", F.row_number().over(W.partitionBy("bin").orderBy("tid")) - 1)


@query("w11_hash_sampling", "SELECT read, hash FROM sampled")
def _(b: Base):
    return b.sampled


@query("w11_rarest_routing", "SELECT read, hash FROM routed")
def _(b: Base):
    return probe.rarest_half(b.sampled, b.df)


for _level in ("bin", "species", "genus"):

    @query(f"a6_coarse_by_{_level}", f"SELECT read, {_level}, count(*) AS evidence FROM (SELECT DISTINCT s.read, s.hash, i.bin, i.tid, i.species, i.genus FROM sampled s JOIN idx i USING (hash)) GROUP BY 1, 2")
    def _(b: Base, level=_level):
        return probe.coarse(b.sampled, b.index, level)


@query(
    "a7_rare_support",
    "SELECT q.read, i.species, count(DISTINCT q.hash) AS support FROM few q JOIN idx i USING (hash) GROUP BY 1, 2",
    ", few AS (SELECT r.read, r.hash FROM routed r JOIN idx i USING (hash) LEFT JOIN df USING (hash) GROUP BY 1, 2 HAVING count(DISTINCT bin) <= 2 OR max(df) <= 2)",
)
def _(b: Base):
    return probe.rare_support(probe.rarest_half(b.sampled, b.df), b.index, b.df, "species")


@query("a29_bulk_counts", "SELECT bin, count(*) AS n FROM hits GROUP BY 1")
def _(b: Base):
    return b.hits.groupBy("bin").agg(F.count("*").alias("n"))


_COARSE = ", cb AS (SELECT read, bin, count(*) AS evidence FROM (SELECT DISTINCT s.read, s.hash, i.bin, i.tid FROM sampled s JOIN idx i USING (hash)) GROUP BY 1, 2)"


@query(
    "w6_coverage_prefix",
    "SELECT read, bin, evidence FROM (SELECT *, sum(evidence) OVER (PARTITION BY read ORDER BY evidence DESC, bin ROWS UNBOUNDED PRECEDING) AS held, 0.92::DOUBLE * sum(evidence) OVER (PARTITION BY read) AS goal FROM cb) WHERE held - evidence < goal",
    _COARSE,
)
def _(b: Base):
    return probe.mass_prefix(probe.coarse(b.sampled, b.index, "bin"), "read", "evidence", "bin", 0.92)


@query(
    "w7_core_cap",
    f"SELECT read, bin, evidence, r::INTEGER AS r, cap::BIGINT AS cap FROM (SELECT *, greatest(1, ceil(round({LEAST_BINS} + {MOST_BINS - LEAST_BINS} * pow(1 - core, 2), 9))) AS cap FROM (SELECT *, sum(CASE WHEN r <= ceil(round(eff, 9)) THEN p ELSE 0 END) OVER (PARTITION BY read) AS core FROM (SELECT *, 1 / sum(p * p) OVER (PARTITION BY read) AS eff, row_number() OVER (PARTITION BY read ORDER BY evidence DESC, bin) AS r FROM (SELECT *, evidence / sum(evidence) OVER (PARTITION BY read) AS p FROM cb)))) WHERE r <= cap",
    _COARSE,
)
def _(b: Base):
    return probe.core_cap(probe.coarse(b.sampled, b.index, "bin"), "read", "evidence", "bin", LEAST_BINS, MOST_BINS).withColumn("cap", F.col("cap").cast("long"))


@query(
    "w8_weighted_cap",
    f"SELECT read, bin, w AS weight, r::INTEGER AS r FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY w DESC, bin) AS r FROM (SELECT read, bin, (4 * evidence + 4294967296 * (evidence = 1)::BIGINT)::BIGINT AS w FROM cb)) WHERE r <= {MOST_BINS}",
    _COARSE,
)
def _(b: Base):
    rows = probe.coarse(b.sampled, b.index, "bin").withColumn("low", (F.col("evidence") == 1).cast("long"))
    return probe.weighted_cap(rows, "read", "evidence", "low", "bin", MOST_BINS).select("read", "bin", "weight", "r")


_RARE = """, few AS (SELECT r.read, r.hash FROM routed r JOIN idx i USING (hash) LEFT JOIN df USING (hash) GROUP BY 1, 2 HAVING count(DISTINCT bin) <= 2 OR max(df) <= 2),
rs AS (SELECT q.read, i.species, count(DISTINCT q.hash) AS rare FROM few q JOIN idx i USING (hash) GROUP BY 1, 2), rg AS (SELECT q.read, i.genus, count(DISTINCT q.hash) AS grare FROM few q JOIN idx i USING (hash) GROUP BY 1, 2),
cs AS (SELECT read, species, genus, count(*) AS evidence FROM (SELECT DISTINCT s.read, s.hash, i.bin, i.tid, i.species, i.genus FROM sampled s JOIN idx i USING (hash)) GROUP BY 1, 2, 3)"""
_SURFACE = (
    _RARE
    + f""", s0 AS (SELECT cs.*, coalesce(rare, 0) AS rare, coalesce(grare, 0) AS grare, length(seq) <= 600 AS short, sum(evidence) OVER (PARTITION BY read) AS total, sum(evidence) OVER (PARTITION BY read, genus) AS gm,
  max(evidence) OVER (PARTITION BY read) AS best, row_number() OVER (PARTITION BY read ORDER BY evidence DESC, species) AS r FROM cs JOIN reads USING (read) LEFT JOIN rs USING (read, species) LEFT JOIN rg USING (read, genus)),
s1 AS (SELECT *, dense_rank() OVER (PARTITION BY read ORDER BY gm DESC, genus) AS g, row_number() OVER (PARTITION BY read, genus ORDER BY rare DESC, evidence DESC, species) AS b,
  row_number() OVER (PARTITION BY read, genus ORDER BY (r = 1)::INTEGER, rare DESC, evidence DESC, species) AS home FROM s0),
s2 AS (SELECT *, max(gm) OVER w / total AS share, sum(CASE WHEN r <= 10 THEN evidence ELSE 0 END) OVER w / total AS head, sum((g = 1 AND 10 * evidence >= 4 * best)::INTEGER) OVER w AS crowd, (r > 1 AND g > 1 AND b = 1) AS pick FROM s1 WINDOW w AS (PARTITION BY read)),
s3 AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY pick DESC, grare DESC, gm DESC, genus, species) AS away FROM s2
  WHERE {DISPERSION} > (CASE WHEN short THEN 0.2 ELSE 0.35 END) AND (share >= 0.72::DOUBLE OR (short AND share >= 0.6::DOUBLE) OR (head >= 0.55::DOUBLE AND share >= 0.65::DOUBLE) OR crowd >= 3)),
s4 AS (SELECT *, CASE WHEN r = 1 THEN 0 WHEN g = 1 AND home <= (CASE WHEN short THEN 4 ELSE 2 END) THEN 1 WHEN pick AND away <= (CASE WHEN short THEN 5 ELSE 2 END) THEN 2 ELSE 3 END AS tier FROM s3),
surface AS (SELECT * FROM (SELECT read, species, genus, short, row_number() OVER (PARTITION BY read ORDER BY tier, CASE tier WHEN 1 THEN home WHEN 2 THEN away ELSE r END) AS place FROM s4) WHERE place <= (CASE WHEN short THEN 16 ELSE 6 END))"""
)


def surface(b: Base):
    routed = probe.rarest_half(b.sampled, b.df)
    coarse = probe.coarse(b.sampled, b.index, "species").join(F.broadcast(b.taxa), "species")  # a row a taxon
    rare, genus_rare = (probe.rare_support(routed, b.index, b.df, level) for level in ("species", "genus"))
    return probe.adaptive_surface(coarse, rare, genus_rare, b.reads.select("read", F.length("seq").alias("n")), DISPERSION)


@query("w9_adaptive_surface", "SELECT read, species, genus, place::INTEGER AS place FROM surface", _SURFACE)
def _(b: Base):
    return surface(b).select("read", "species", "genus", "place")


@query("j22_adaptive_bins", "SELECT DISTINCT t.read, i.bin FROM surface t JOIN (SELECT DISTINCT species, bin FROM idx) i USING (species)", _SURFACE)
def _(b: Base):
    return probe.completed(surface(b).select("read", "species"), b.index.select("species", "bin").distinct())


@query("j22_surface_completion", "SELECT DISTINCT t.read, i.bin FROM tops t JOIN (SELECT DISTINCT species, bin FROM idx) i USING (species)")
def _(b: Base):
    return probe.completed(score.top_two(b.scores).select("read", "species"), b.index.select("species", "bin").distinct())


@query("a8_feature_scores", "SELECT read, species, round(score, 6) AS score, round(uniq, 6) AS uniq, round(evaluated, 6) AS evaluated, n FROM scores")
def _(b: Base):
    return b.scores.select("read", "species", r6(F.col("score"), "score"), r6(F.col("uniq"), "uniq"), r6(F.col("evaluated"), "evaluated"), "n")


@query("x6_feature_weights", "SELECT read, pos, deg, dfb, round(weight, 6) AS weight, strength FROM per")
def _(b: Base):
    return b.parts.select("read", F.col("pos").cast("long").alias("pos"), "deg", "dfb", r6(F.col("weight"), "weight"), "strength")


@query(
    "a9_genus_shrink",
    "SELECT read, species, round(base + CASE WHEN s + comp > 0 THEN comp * s / (s + comp) ELSE 0 END, 6) AS value FROM (SELECT *, sum(base) OVER (PARTITION BY read, genus) AS s FROM (SELECT read, species, genus, sum(CASE WHEN hash % 32 = 0 THEN weight ELSE 0 END) AS base, sum(CASE WHEN hash % 32 = 0 THEN 0 ELSE weight END) AS comp FROM parts GROUP BY 1, 2, 3))",
)
def _(b: Base):
    base = F.col("hash") % 32 == 0
    rows = b.parts.select("read", "hash", "weight", "taxa").repartition("read").withColumn("taxon", F.explode("taxa")).groupBy("read", "taxon")
    rows = rows.agg(F.sum(F.when(base, F.col("weight")).otherwise(0.0)).alias("base"), F.sum(F.when(base, 0.0).otherwise(F.col("weight"))).alias("comp"))
    rows = score.named(rows, b.numbers)
    return score.shrunk(rows).select("read", "species", r6(F.col("value"), "value"))


@query("w4_candidate_rank", "SELECT read, species, rn::INTEGER AS rn FROM ranked")
def _(b: Base):
    return score.ranked(b.scores).select("read", "species", "rn")


@query("w5_top_two", "SELECT read, species, round(best, 6) AS best, round(second, 6) AS second, round(gap, 6) AS gap, round(ratio, 6) AS ratio FROM tops")
def _(b: Base):
    return score.top_two(b.scores).select("read", "species", *(r6(F.col(c), c) for c in ("best", "second", "gap", "ratio")))


_CONF = "best >= ceil(0.7::DOUBLE * evaluated) AND (uniq >= 3 OR (uniq >= 2 AND uniq >= 0.12::DOUBLE * n)) AND gap >= greatest(0.5, evaluated / 24) AND ratio >= 1.35::DOUBLE AND best - second >= floor(0.35::DOUBLE * sqrt(evaluated) + 1)"


@query("f6_high_confidence", f"SELECT read, species, {_CONF} AS confident FROM tops")
def _(b: Base):
    return score.confident(score.top_two(b.scores)).select("read", "species", "confident")


@query("x12_margin", "SELECT read, best - second >= floor(0.35::DOUBLE * sqrt(evaluated) + 1) AS leads FROM tops")
def _(b: Base):
    t = score.top_two(b.scores)
    return t.select("read", score.margin(F.col("best"), F.col("second"), F.col("evaluated")).alias("leads"))


_THR = f"""
, t1 AS (SELECT read, best, evaluated, n, floor((0.5 + (0.45::DOUBLE - 0.5) * {DISPERSION}) * least(best, evaluated)) AS bb,
   least(greatest(1, ceil(0.7::DOUBLE * evaluated)), greatest(1, ceil(0.45::DOUBLE * evaluated))) AS be, greatest(ceil(0.15::DOUBLE * n), 4) AS lst FROM tops),
t2 AS (SELECT *, greatest(be, greatest(1, floor(0.3::DOUBLE * lst))) AS low, greatest(least(bb, be), 1, lst) AS high FROM t1),
thr AS (SELECT read, low, high, low + (high - low) * {DISPERSION}::DOUBLE AS thr FROM t2)"""


def thresholds(b: Base):
    return score.thresholds(score.top_two(b.scores).select("read", "best", "evaluated", "n"), DISPERSION)


@query("f4_candidate_thresholds", "SELECT read, low::DOUBLE AS low, high::DOUBLE AS high, round(thr, 6) AS thr FROM thr", _THR)
def _(b: Base):
    return thresholds(b).select("read", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), r6(F.col("thr"), "thr"))


_RET = _THR + f", ret AS (SELECT r.*, thr FROM (SELECT *, count(*) OVER (PARTITION BY read) AS cands FROM ranked) r JOIN thr USING (read) WHERE rn <= round({1 - DISPERSION} * least(128, cands)) OR score >= thr)"


def retained(b: Base):
    return b.spool.held("candidates", lambda: score.retained(b.scores, thresholds(b), DISPERSION))


@query("f5_candidate_retention", "SELECT read, species, rn::INTEGER AS rn FROM ret", _RET)
def _(b: Base):
    return retained(b).select("read", "species", "rn")


@query(
    "f7_quick_evaluation",
    "SELECT read, stage, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT read, weight, CASE WHEN row_number() OVER (PARTITION BY read ORDER BY pos) <= 64 THEN 0 WHEN hash & 7 = 0 THEN 1 ELSE 2 END AS stage FROM per) GROUP BY 1, 2",
)
def _(b: Base):
    return score.staged(b.parts).groupBy("read", "stage").agg(F.count("*").alias("n"), r6(F.sum("weight"), "weight"))


@query("f8_cost_filter", "SELECT read, species, rn::INTEGER AS rn FROM (SELECT *, count(*) OVER (PARTITION BY read) AS cands FROM ranked) WHERE rn = 1 OR score >= 0.5::DOUBLE * ln(80.0::DOUBLE) + ln(cands)")
def _(b: Base):
    return score.costly(b.scores, 80).select("read", "species", "rn")


@query("f9_mixture_cap", "SELECT read, species, rn::INTEGER AS rn FROM (SELECT *, pow(sum(score) OVER (PARTITION BY read), 2) / sum(score * score) OVER (PARTITION BY read) AS eff FROM ranked) WHERE rn <= ceil(round(eff * eff, 6))")
def _(b: Base):
    return score.mixture_cap(b.scores).select("read", "species", "rn")


@query(
    "j21_genus_competitors",
    "SELECT read, sum((rn > 1 AND rn <= 64 AND genus = h.genus AND score >= 0.5 * h.score)::BIGINT)::BIGINT AS competitors FROM (SELECT *, first_value({'genus': genus, 'score': score}) OVER (PARTITION BY read ORDER BY rn) AS h FROM ranked) GROUP BY 1",
)
def _(b: Base):
    return score.competitors(b.scores)


_RESCUE = _RET + """
, r0 AS (SELECT * REPLACE (greatest(0.0, least(greatest(1.0, evaluated), score)) AS score) FROM ranked WHERE rn <= 64),
r1 AS (SELECT *, max(score) OVER w AS best, coalesce(max(CASE WHEN rn = 2 THEN score END) OVER w, 0.0) AS second, max(CASE WHEN rn = 1 THEN genus END) OVER w AS home, max(CASE WHEN rn = 1 THEN uniq END) OVER w AS own FROM r0 WINDOW w AS (PARTITION BY read)),
r2 AS (SELECT *, sum((rn > 1 AND genus = home)::INTEGER) OVER (PARTITION BY read) AS rivals FROM r1),
r3 AS (SELECT *, round(greatest(0.0, least(1.0, 0.45::DOUBLE * (1 - greatest(0.0, least(1.0, (best - second) / greatest(best, 1e-6::DOUBLE)))) + 0.35::DOUBLE * least(1.0, rivals / 4) + 0.2::DOUBLE * (1 - greatest(0.0, least(1.0, own / evaluated / 0.25::DOUBLE))))), 9) AS u FROM r2),
r4 AS (SELECT r3.*, k.read IS NOT NULL AS has, count(k.read) OVER (PARTITION BY r3.read) AS held FROM r3 LEFT JOIN (SELECT read, species FROM ret) k ON k.read = r3.read AND k.species = r3.species),
r5 AS (SELECT read, species, u, held, row_number() OVER (PARTITION BY read ORDER BY CASE WHEN genus = home THEN 0 WHEN score >= 0.5 * best THEN 1 ELSE 2 END, round(score, 9) DESC, species) AS place FROM r4 JOIN thr USING (read) WHERE NOT has AND score >= greatest(0.25 * best, 0.5 * thr))"""


@query("w10_local_rescue", "SELECT read, species, place::INTEGER AS place FROM r5 WHERE place <= 1 + ceil(7 * u) - held", _RESCUE)
def _(b: Base):
    return score.rescued(b.scores, thresholds(b), retained(b).select("read", "species"))


@query("a27_uniquely_mapped", "SELECT count(DISTINCT species) AS taxa FROM parts WHERE deg = 1")
def _(b: Base):
    found = b.parts.where("deg = 1").select(F.explode("taxa").alias("taxon")).distinct()
    return score.named(found, b.numbers).agg(F.countDistinct("species").alias("taxa"))


@query("a26_read_lengths", "SELECT min(length(seq))::INTEGER AS shortest, max(length(seq))::INTEGER AS longest, sum(length(seq))::BIGINT AS bases, (sum(length(seq)) // count(*))::BIGINT AS average FROM reads")
def _(b: Base):
    n = F.length("seq")
    return b.reads.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("bases"), F.floor(F.sum(n) / F.count("*")).alias("average"))
