"""Queries of the models, the readout, local resolution and the profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import features, local, model, profile, score

from . import sqlkernels as K
from .base import DISPERSION, Base, query, r6
from .build import _COUNT
from .classify import _RET, retained

ROUNDS, MIX_ROUNDS, POWER, LEAST = 100, 10, 1 + DISPERSION, 5e-4

# --- presence --------------------------------------------------------------------------


def _nth(c: str, q: float) -> str:
    return f"coalesce(list_sort(list({c}))[(floor({q}::DOUBLE * (count({c}) - 1)) + 1)::BIGINT], 0.0)"


def _pct(c: str) -> str:
    return f"coalesce(list_sort(list({c}::DOUBLE))[(floor(0.95::DOUBLE * (count(*) - 1)) + 1)::BIGINT], 0.0)"


_PRES = _COUNT + f"""
, cov AS (SELECT species, bp, total, uni, CASE WHEN bp > 0 THEN uni / bp ELSE 0 END AS density FROM counters),
rl AS (SELECT count(*) AS n, greatest(1, sum(length(seq)) // count(*) - 67 + 1) AS win FROM reads),
pres AS (SELECT species, count(*) AS hits, sum(CASE WHEN deg = 1 THEN strength ELSE 0 END) AS uniq, count(DISTINCT read) AS reads, count(DISTINCT CASE WHEN deg = 1 AND strength > 0 THEN read END) AS unique_reads,
  count(DISTINCT CASE WHEN deg = 1 AND dfb = 1 THEN hash % 2048 END) AS unique_obs, count(DISTINCT CASE WHEN deg = 1 AND dfb = 1 THEN bin END) AS breadth_obs FROM parts GROUP BY 1),
pe0 AS (SELECT p.*, coalesce(uni, 0) AS uni, CASE WHEN density > 0 THEN density * win WHEN total > 0 AND bp > 0 THEN total / bp * win ELSE 0 END AS expected, n FROM pres p LEFT JOIN cov USING (species) CROSS JOIN rl),
pe AS (SELECT *, CASE WHEN expected > 0 THEN expected * n ELSE uni END AS exposure, unique_obs * (CASE WHEN unique_obs > 0 THEN (CASE WHEN breadth_obs > 0 THEN least(1.0, breadth_obs / unique_obs) ELSE 1 END) ELSE 0 END) AS effective, hits::DOUBLE AS score FROM pe0),
pr1 AS (SELECT *, effective / greatest(1, score) AS rate, CASE WHEN reads > 0 THEN unique_reads / reads ELSE 0 END AS read_ratio FROM pe),
cut AS (SELECT {_nth("score", 0.3)} AS faint, {_nth("score", 0.9)} AS strong FROM pr1),
low AS (SELECT coalesce(list_sort(list(exposure))[least(floor(0.1::DOUBLE * count(*)) + 1, count(*))::BIGINT], 0.0) AS lowest FROM pr1 WHERE exposure > 0),
noise AS (SELECT {_pct("unique_obs")} AS c1, {_pct("breadth_obs")} AS c2, {_pct("rate")} AS c3, {_pct("read_ratio")} AS c4 FROM pr1 CROSS JOIN cut WHERE score <= faint),
pr2 AS (SELECT *, CASE WHEN exposure > 0 THEN exposure ELSE greatest(1, score) END AS ex,
  CASE WHEN strong > 0 AND score < strong THEN greatest(0.0, least(1.0, CASE WHEN c1 > 0 THEN unique_obs / c1 ELSE 1 END, CASE WHEN c2 > 0 THEN breadth_obs / c2 ELSE 1 END, CASE WHEN c3 > 0 THEN rate / c3 ELSE 1 END, CASE WHEN c4 > 0 THEN read_ratio / c4 ELSE 1 END)) ELSE 1.0 END AS factor
  FROM pr1 CROSS JOIN cut CROSS JOIN low CROSS JOIN noise),
pr3 AS (SELECT *, effective * (CASE WHEN uni > 0 THEN greatest(1, ex / uni) ELSE 1 END) AS most FROM pr2),
pr4 AS (SELECT *, CASE WHEN most > 0 THEN (CASE WHEN uniq > 0 THEN least(uniq, most) ELSE most END) ELSE uniq END AS capped FROM pr3),
pr5 AS (SELECT *, factor * (CASE WHEN capped > 0 THEN capped WHEN uniq > 0 THEN uniq ELSE score END) AS c, greatest(ex, lowest) AS u FROM pr4),
pr6 AS (SELECT *, greatest(0.0, c / u - 1e-4::DOUBLE) AS lam FROM pr5),
pp AS (SELECT *, (CASE WHEN c > 0 THEN c * ln((lam + 1e-4::DOUBLE) / 1e-4::DOUBLE) ELSE 0 END) - lam * u + ln(0.001::DOUBLE) - ln(0.999::DOUBLE) AS logodds FROM pr6),
level AS (SELECT species, CASE WHEN logodds >= 4.6::DOUBLE THEN 'accept' WHEN logodds <= -4.6::DOUBLE THEN 'reject' ELSE 'unknown' END AS level FROM pp),
scale AS (SELECT species, scale FROM (SELECT species, CASE WHEN logodds IS NULL THEN density * win WHEN density > 0 THEN 0.5 * density * win + 0.5 / (1 + exp(-logodds)) ELSE 1 / (1 + exp(-logodds)) END AS scale FROM cov CROSS JOIN rl LEFT JOIN pp USING (species)) WHERE scale > 0)"""

SPAN = 67


def read_lengths(b: Base):
    """One row: the number of reads and their whole average length."""
    return b.lengths.select("n", F.floor(F.col("bases") / F.col("n")).alias("average"))


def presence(b: Base):
    return model.exposed(model.presence(b.parts, b.scores, b.numbers), b.archive.coverage, read_lengths(b), SPAN)


def posterior(b: Base):
    return b.spool.held("presence", lambda: model.presence_posterior(presence(b)))


def prior(b: Base):
    return model.prior_scale(b.archive.coverage, posterior(b), read_lengths(b), SPAN)


@query("a10_presence_statistics", "SELECT species, hits, round(uniq, 6) AS uniq, reads, unique_reads, unique_obs, breadth_obs FROM pres", _PRES)
def _(b: Base):
    return model.presence(b.parts, b.scores, b.numbers).select("species", "hits", r6(F.col("uniq"), "uniq"), "reads", "unique_reads", "unique_obs", "breadth_obs")


@query("j7_presence_coverage", "SELECT species, hits, round(expected, 6) AS expected, round(exposure, 6) AS exposure FROM pe", _PRES)
def _(b: Base):
    return presence(b).select("species", "hits", r6(F.col("expected"), "expected"), r6(F.col("exposure"), "exposure"))


@query("a11_presence_model", "SELECT species, round(factor, 6) AS local_factor, round(logodds, 6) AS logodds, level FROM pp JOIN level USING (species)", _PRES)
def _(b: Base):
    return posterior(b).select("species", r6(F.col("local_factor"), "local_factor"), r6(F.col("logodds"), "logodds"), "level")


@query("t7_nearest_rank", "SELECT round(faint, 6) AS v FROM cut", _PRES)
def _(b: Base):
    return model.nearest_rank(model.presence(b.parts, b.scores, b.numbers).select(F.col("hits").cast("double").alias("hits")), "hits", 0.3).select(r6(F.col("v"), "v"))


@query("j8_prior_scale", "SELECT species, round(scale, 6) AS scale FROM scale", _PRES)
def _(b: Base):
    return prior(b).select("species", r6(F.col("scale"), "scale"))


# --- mixtures --------------------------------------------------------------------------


def _em_sql(rounds: int, power: float) -> str:
    """The assignment fit as a recursion: em holds the weights after each round, post the responsibilities under those before the last."""
    q = "SELECT *, x / sum(x) OVER (PARTITION BY read) AS q FROM (SELECT *, exp(w - max(w) OVER (PARTITION BY read)) AS x FROM (SELECT {0}.i, ll.read, ll.species, ll.genus, ll.score, ll.evaluated, ln(greatest(pi, 1e-9::DOUBLE)) + loglik AS w FROM ll JOIN {0} USING (species)))"
    return f"""
, ll AS (SELECT read, species, genus, score, evaluated, 1.05::DOUBLE * ln(greatest((c + 1e-9::DOUBLE) / (max(c) OVER w + count(*) OVER w * 1e-9::DOUBLE), 1e-9::DOUBLE)) AS loglik
   FROM (SELECT *, score / evaluated AS c FROM ret) WINDOW w AS (PARTITION BY read)),
mass AS (SELECT species, sum(p) AS mass FROM (SELECT species, score / sum(score) OVER (PARTITION BY read) AS p FROM ret) GROUP BY 1),
p0 AS (SELECT species, greatest(start, CASE WHEN start > 0 THEN 0 ELSE 1e-5::DOUBLE END) AS start FROM (SELECT species, mass * sqrt(coalesce(scale, 1)) AS start FROM mass LEFT JOIN scale USING (species))),
em AS (SELECT 0 AS i, species, start / (SELECT sum(start) FROM p0) AS pi FROM p0 UNION ALL
  SELECT i + 1, species, (CASE WHEN e < 2e-4::DOUBLE * max(e) OVER () THEN 0 ELSE e END + 1e-6::DOUBLE) / (count(*) OVER () * 1e-6::DOUBLE + sum(e) OVER ()) FROM (
    SELECT i, species, sum(evaluated * pow(mq, {power}) * q) AS e FROM (SELECT *, max(q) OVER (PARTITION BY read) AS mq FROM ({q.format("em")})) GROUP BY i, species) WHERE i < {rounds}),
last AS (SELECT * FROM em WHERE i = {rounds - 1}),
pis AS (SELECT species, pi FROM em WHERE i = {rounds}),
post AS (SELECT read, species, genus, evaluated, score, q FROM ({q.format("last")}))"""


_EM = _PRES + _RET + _em_sql(ROUNDS, POWER)


def fitted(b: Base):
    return model.fit(retained(b), ROUNDS, POWER, prior(b))


@query("a13_weighted_evidence", "SELECT species, round(mass, 6) AS mass FROM mass", _EM)
def _(b: Base):
    return model.shares(retained(b)).select("species", r6(F.col("mass"), "mass"))


@query("m1_assignment_posteriors", "SELECT read, species, round(q, 6) AS q FROM post", _EM)
def _(b: Base):
    return fitted(b)[0].select("read", "species", r6(F.col("q"), "q"))


@query("m1_assignment_weights", "SELECT species, round(pi, 6) AS pi FROM pis", _EM)
def _(b: Base):
    return fitted(b)[1].select("species", r6(F.col("pi"), "pi"))


CALIBRATION = 200_000  # reads


@query("m2_calibration", "SELECT species, round(pi, 6) AS pi FROM pis", _RET + ", scale AS (SELECT '' AS species, 1.0::DOUBLE AS scale WHERE false)" + _em_sql(ROUNDS, 2.0).replace("1e-5::DOUBLE END", "1e-9::DOUBLE END"))
def _(b: Base):
    """The fit on a sample of at most 200,000 reads, as if the community were wholly dispersed, without a prior; here these are all reads."""
    some = retained(b).join(b.reads.select("read").orderBy("read").limit(CALIBRATION), "read", "left_semi")
    return model.fit(some, ROUNDS, 2.0)[1].select("species", r6(F.col("pi"), "pi"))


_MIX = _RET + f"""
, mc AS (SELECT (SELECT count(DISTINCT read) FROM ret) AS n, (SELECT count(DISTINCT species) FROM ret) AS t),
mu AS (SELECT 0 AS i, species, 1 / (SELECT t FROM mc)::DOUBLE AS pi FROM ret GROUP BY species UNION ALL
  SELECT i + 1, species, (sum(q) + 0.5) / (any_value(n) + 0.5 * any_value(t)) FROM (SELECT *, x / sum(x) OVER (PARTITION BY read) AS q FROM (SELECT mu.i, ret.read, ret.species, pi * score AS x, mc.n, mc.t FROM ret JOIN mu USING (species) CROSS JOIN mc)) WHERE i < {MIX_ROUNDS} GROUP BY i, species),
ms AS (SELECT species, pi FROM mu WHERE i = {MIX_ROUNDS}),
mq AS (SELECT read, species, genus, score, pi * score / sum(pi * score) OVER (PARTITION BY read) AS q FROM ret JOIN ms USING (species))"""


def mixed(b: Base):
    return model.mixture(retained(b), MIX_ROUNDS)


def blended(b: Base):
    """The sample mixture's posteriors, fitted once."""
    return b.spool.held("mixture", lambda: mixed(b)[0])


@query("m4_sample_mixture", "SELECT species, round(pi, 6) AS pi FROM ms", _MIX)
def _(b: Base):
    return mixed(b)[1].select("species", r6(F.col("pi"), "pi"))


@query("m4_mixture_posteriors", "SELECT read, species, round(q, 6) AS q FROM mq", _MIX)
def _(b: Base):
    return mixed(b)[0].select("read", "species", r6(F.col("q"), "q"))


ABUNDANCE_ROUNDS = 3  # the root of a hundred, times the dispersion, rounded up


@query(
    "a15_abundance_fit",
    "SELECT species, round(mass, 6) AS mass, round(pi, 6) AS pi FROM ab WHERE i = 3",
    _RET + """
, ab AS (SELECT 0 AS i, species, 0.0::DOUBLE AS mass, 1 / count(*) OVER ()::DOUBLE AS pi FROM (SELECT DISTINCT species FROM ret) UNION ALL
  SELECT i + 1, species, e, (e + 1e-6::DOUBLE) / (count(*) OVER () * 1e-6::DOUBLE + sum(e) OVER ()) FROM (SELECT i, species, CASE WHEN e < 2e-4::DOUBLE * max(e) OVER () THEN 0 ELSE e END AS e FROM (
    SELECT i, species, sum(evaluated * q) AS e FROM (SELECT *, x / sum(x) OVER (PARTITION BY read) AS q FROM (SELECT ab.i, ret.read, ret.species, ret.evaluated, greatest(pi, 1e-9::DOUBLE) * score AS x FROM ret JOIN ab USING (species))) GROUP BY i, species)) WHERE i < 3)""",
)
def _(b: Base):
    return model.abundance_fit(retained(b), ABUNDANCE_ROUNDS).select("species", r6(F.col("mass"), "mass"), r6(F.col("pi"), "pi"))


@query(
    "a18_sequence_profile",
    "SELECT species, round(assigned, 6) AS assigned, uniq, round(features, 6) AS features, round(assigned / sum(assigned) OVER (), 6) AS sequence_abundance FROM (SELECT species, sum(share) AS assigned, sum((kin = 1)::INTEGER)::DOUBLE AS uniq, sum(share * evaluated) AS features FROM (SELECT *, score / sum(score) OVER (PARTITION BY read) AS share, count(*) OVER (PARTITION BY read) AS kin FROM (SELECT *, max(score) OVER (PARTITION BY read) AS best FROM ret) WHERE score >= 0.95::DOUBLE * best) GROUP BY 1)",
    _RET,
)
def _(b: Base):
    return model.sequence_profile(retained(b)).select("species", r6(F.col("assigned"), "assigned"), F.col("unique").alias("uniq"), r6(F.col("features"), "features"), r6(F.col("sequence_abundance"), "sequence_abundance"))


@query("j9_sidecar_merge", "SELECT ret.read, ret.species, round(ret.score, 6) AS score, round(mq.q, 6) AS q FROM ret JOIN mq USING (read, species)", _MIX)
def _(b: Base):
    return retained(b).select("read", "species", "score").join(mixed(b)[0].select("read", "species", "q"), ["read", "species"]).select("read", "species", r6(F.col("score"), "score"), r6(F.col("q"), "q"))


@query("s11_spool_scan", "SELECT read, species FROM ret", _RET)
def _(b: Base):
    """Two columns of the spool of candidates; the others aren't read."""
    return retained(b).select("read", "species")


# --- community -------------------------------------------------------------------------

_COMM = """
, am AS (SELECT l_partkey, sum(l_quantity) AS x FROM lineitem GROUP BY 1), ap AS (SELECT x, x / sum(x) OVER () AS p, row_number() OVER (ORDER BY x DESC) AS r FROM am),
ae AS (SELECT 1 / sum(p * p) AS eff, -sum(p * ln(p)) AS shannon, count(*) AS n FROM ap),
ah AS (SELECT sum(p) AS head FROM ap, ae WHERE r <= ceil(round(eff, 9))),
ad AS (SELECT *, (1 - head) * ln(1 + exp(shannon)) AS volume FROM ae, ah)"""


@query("a12_community_dispersion", "SELECT n, round(eff, 4) AS eff, round(head, 6) AS head, round(shannon, 6) AS shannon, round(volume / (1 + volume), 6) AS u, round(1 - exp(-pow(volume, 4)), 6) AS s FROM ad", _COMM)
def _(b: Base):
    rows = b.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("x"))
    return model.community(rows, "x").select(F.col("n").cast("long").alias("n"), F.round("eff", 4).alias("eff"), *(r6(F.col(c), c) for c in ("head", "shannon", "u", "s")))


@query("a23_effective_taxa", "SELECT l_shipdate AS day, round(pow(sum(x), 2) / sum(x * x), 6) AS eff FROM (SELECT l_shipdate, l_suppkey, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(b: Base):
    rows = b.lineitem.groupBy(F.col("l_shipdate").alias("day"), "l_suppkey").agg(F.sum("l_quantity").alias("x"))
    return rows.groupBy("day").agg(r6(F.pow(F.sum("x"), F.lit(2.0)) / F.sum(F.col("x") * F.col("x")), "eff"))


@query("w17_active_set", "SELECT l_suppkey AS supp, x FROM (SELECT *, sum(x) OVER (ORDER BY x DESC, l_suppkey ROWS UNBOUNDED PRECEDING) AS held, sum(x) OVER () AS total FROM (SELECT l_suppkey, sum(l_quantity) AS x FROM lineitem GROUP BY 1)) WHERE held - x < 0.8::DOUBLE * total")
def _(b: Base):
    rows = b.lineitem.groupBy(F.col("l_suppkey").alias("supp")).agg(F.sum("l_quantity").alias("x"))
    return profile.active_set(rows, "supp", "x", 0.8).select("supp", "x")


@query("w18_tail_mass", "SELECT supp, round(sum(p) OVER (ORDER BY p, supp ROWS UNBOUNDED PRECEDING), 6) AS tail FROM (SELECT supp, x / sum(x) OVER () AS p FROM (SELECT l_suppkey AS supp, sum(l_quantity) AS x FROM lineitem GROUP BY 1))")
def _(b: Base):
    rows = b.lineitem.groupBy(F.col("l_suppkey").alias("supp")).agg(F.sum("l_quantity").alias("x"))
    return model.tail_mass(rows, "x", "supp").select("supp", r6(F.col("tail"), "tail"))


# --- readout ---------------------------------------------------------------------------


def _need(least: str) -> str:
    return f"CASE level WHEN 'accept' THEN least({least}, 1e-6::DOUBLE) WHEN 'reject' THEN least(1.0, {least} * 2) ELSE {least} END"


_PRUNE = _EM + f"""
, pr0 AS (SELECT post.*, pi, coalesce(level, 'unknown') AS level FROM post JOIN pis USING (species) LEFT JOIN level USING (species)),
pz AS (SELECT *, max(ok) OVER (PARTITION BY read) AS keeps FROM (SELECT *, pi >= {_need("1e-4::DOUBLE")} AS ok FROM pr0)),
pr AS (SELECT read, species, genus, evaluated, score, pi, level, CASE WHEN keeps THEN q / sum(q) OVER (PARTITION BY read) ELSE q END AS q FROM pz WHERE ok OR NOT keeps)"""
_DEC = _PRUNE + f"""
, d0 AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY round(q, 9) DESC, species) AS rn FROM pr),
d1 AS (SELECT *, max(CASE WHEN rn = 1 THEN pi >= {_need(f"{LEAST}::DOUBLE")} END) OVER w AS fine, CASE WHEN q > 0 AND (rn = 1 OR level <> 'reject') THEN q ELSE 0 END AS sh, CASE WHEN evaluated > 0 THEN evaluated ELSE 1 END AS tot FROM d0 WINDOW w AS (PARTITION BY read)),
d2 AS (SELECT *, round(round(sh / sum(sh) OVER (PARTITION BY read) * tot, 9)) AS cnt FROM d1),
d3 AS (SELECT *, max(cnt) OVER (PARTITION BY read) AS most FROM d2),
d4 AS (SELECT *, CASE WHEN most > 0 THEN cnt WHEN rn = 1 THEN greatest(1.0, round(tot)) ELSE 0 END AS c FROM d3),
dec AS (SELECT read, species, c::DOUBLE AS count, NULL::VARCHAR AS reason FROM d4 WHERE fine AND c > 0 UNION ALL SELECT read, 'unclassified', 1.0, 'posterior_weight' FROM d4 WHERE NOT fine AND rn = 1)"""
_READ = _DEC + _MIX.removeprefix(_RET) + """
, x0 AS (SELECT *, round(sum(q) OVER (PARTITION BY read, genus), 9) AS gm, count(*) OVER (PARTITION BY read) AS k, row_number() OVER (PARTITION BY read ORDER BY score DESC, species) AS bs, row_number() OVER (PARTITION BY read ORDER BY round(q, 9) DESC, species) AS any_, max(score) OVER (PARTITION BY read) AS best FROM mq),
x1 AS (SELECT *, max(CASE WHEN bs = 2 THEN score END) OVER (PARTITION BY read) AS second, row_number() OVER (PARTITION BY read ORDER BY gm DESC, genus, round(q, 9) DESC, species) AS own FROM x0),
x2 AS (SELECT o.read, o.species AS top, o.q AS top_mass, o.best, o.second, o.k, w.species AS new, w.q AS new_mass FROM x1 o JOIN x1 w ON w.read = o.read AND w.own = 1 WHERE o.any_ = 1),
y0 AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY count DESC, species) AS rn FROM dec),
y1 AS (SELECT y0.read, y0.species AS head, y0.reason AS head_reason, x2.*, mq.q AS old_mass FROM y0 JOIN x2 USING (read) LEFT JOIN mq ON mq.read = y0.read AND mq.species = y0.species WHERE rn = 1),
y2 AS (SELECT *, ln(greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, top_mass)) / (1 - greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, top_mass)))) AS gain, 0.5 * ln(1 + best) AS cost,
  ln(greatest(new_mass, 1e-12::DOUBLE) / greatest(coalesce(old_mass, 0), 1e-12::DOUBLE)) AS change, greatest(ln(greatest(1, CASE WHEN second > 0 THEN best / second ELSE 1 + best END)), 0.5 * ln(greatest(1, k))) AS price FROM y1),
y3 AS (SELECT *, CASE WHEN head = 'unclassified' THEN (CASE WHEN head_reason = 'posterior_weight' AND gain > cost THEN 'released' ELSE 'kept' END) WHEN head <> new AND new_mass > 0 AND change > price THEN 'switched' ELSE 'kept' END AS mode FROM y2),
ro AS (SELECT y0.read, CASE mode WHEN 'released' THEN top WHEN 'switched' THEN new ELSE y0.species END AS species, CASE mode WHEN 'released' THEN top_mass WHEN 'switched' THEN new_mass ELSE y0.count END AS count, CASE WHEN mode = 'kept' THEN reason END AS reason, mode, gain, cost, change, price
  FROM y0 LEFT JOIN y3 USING (read) WHERE mode = 'kept' OR rn = 1)"""


def pruned(b: Base):
    """Pruned posteriors of the assignment mixture, fitted once."""

    def make():
        post, pi = fitted(b)
        return model.pruned(post, F.broadcast(pi), F.broadcast(posterior(b).select("species", "level")), LEAST).join(F.broadcast(b.taxa), "species")  # a row a taxon

    return b.spool.held("pruned", make)


def decisions(b: Base):
    return model.decided(pruned(b), LEAST)


def readout(b: Base):
    return b.spool.held("readout", lambda: model.readout(decisions(b), blended(b), F.broadcast(b.taxa)))  # a row a taxon


@query("f10_posterior_prune", "SELECT read, species, round(q, 6) AS q FROM pr", _PRUNE)
def _(b: Base):
    return pruned(b).select("read", "species", r6(F.col("q"), "q"))


@query("f12_final_decision", "SELECT read, species, count, reason FROM dec", _DEC)
def _(b: Base):
    return decisions(b)


@query("a28_species_mass", "SELECT read, genus, round(sum(q), 6) AS mass, arg_max(species, {'q': round(q, 9), 'n': -sid}) AS best FROM (SELECT *, dense_rank() OVER (ORDER BY species) AS sid FROM pr) GROUP BY 1, 2", _PRUNE)
def _(b: Base):
    return pruned(b).groupBy("read", "genus").agg(r6(F.sum("q"), "mass"), F.min_by("species", F.struct(-F.round("q", 9), "species")).alias("best"))


@query("x13_release_gain", "SELECT DISTINCT read, mode, round(gain, 6) AS gain, round(cost, 6) AS cost, round(change, 6) AS change, round(price, 6) AS price FROM ro", _READ)
def _(b: Base):
    return readout(b).select("read", "mode", *(r6(F.col(c), c) for c in ("gain", "cost", "change", "price"))).distinct()


@query("x13_selective_readout", "SELECT read, species, round(count, 6) AS count, reason, mode FROM ro", _READ)
def _(b: Base):
    return readout(b).select("read", "species", r6(F.col("count"), "count"), "reason", "mode")


def _top(post, by: str = "q"):
    """(read, top): up to sixteen taxa and their shares, the largest first."""
    x = F.slice(F.sort_array(F.collect_list(F.struct((-F.round(by, 9)).alias("n"), "species", F.col(by).alias("v")))), 1, 16)
    return post.groupBy("read").agg(F.array_join(F.transform(x, lambda y: F.concat(y["species"], F.lit(":"), F.format_string("%.6f", F.round(y["v"], 6)))), ",").alias("top"))


def _top_sql(table: str) -> str:
    return f"SELECT read, string_agg(species || ':' || printf('%.6f', round(q, 6)), ',' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY round(q, 9) DESC, species) AS rn FROM {table}) WHERE rn <= 16 GROUP BY 1"


@query("w19_top_posteriors", _top_sql("pr"), _PRUNE)
def _(b: Base):
    return _top(pruned(b))


def read_lines(rows, tops, mixed_tops, reads):
    """(line) of the table of reads: the read, its taxa with counts or the reason that there are none, and the posteriors that decided."""
    number = F.when(F.col("count") == F.floor("count"), F.col("count").cast("long").cast("string")).otherwise(F.format_string("%.6f", F.round("count", 6)))
    cell = F.struct((-F.col("count")).alias("n"), "species", F.concat_ws(":", "species", number).alias("text"))
    taxa = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("species") != "unclassified", cell))), lambda x: x["text"]), "\t")
    one = rows.groupBy("read").agg(taxa.alias("taxa"), F.max("reason").alias("reason"), F.max("mode").alias("mode"))
    one = reads.select("read").join(one, "read", "left").join(tops, "read", "left").join(mixed_tops.withColumnRenamed("top", "other"), "read", "left")
    none = F.concat(F.lit("unclassified\tREJECT="), F.coalesce("reason", F.lit("no_candidate")))
    shown = F.when(F.col("mode").isin("released", "switched"), F.col("other")).otherwise(F.col("top"))
    return one.select(F.concat_ws("\t", F.col("read").cast("string"), F.when(F.coalesce(F.col("taxa"), F.lit("")) == "", none).otherwise(F.col("taxa")), F.concat(F.lit("POST_TOPK="), shown)).alias("line"))


@query(
    "k1_read_table",
    f"""SELECT concat_ws(chr(9), r.read::VARCHAR, coalesce(taxa, 'unclassified' || chr(9) || 'REJECT=' || coalesce(reason, 'no_candidate')), 'POST_TOPK=' || CASE WHEN mode IN ('released', 'switched') THEN o.top ELSE t.top END) AS line
    FROM (SELECT DISTINCT read FROM reads) r LEFT JOIN (SELECT read, string_agg(CASE WHEN species <> 'unclassified' THEN species || ':' || CASE WHEN count = floor(count) THEN count::BIGINT::VARCHAR ELSE printf('%.6f', round(count, 6)) END END, chr(9) ORDER BY count DESC, species) AS taxa, max(reason) AS reason, max(mode) AS mode FROM ro GROUP BY 1) USING (read)
    LEFT JOIN ({_top_sql("pr")}) t USING (read) LEFT JOIN ({_top_sql("mq")}) o USING (read)""",
    _READ,
)
def _(b: Base):
    return read_lines(readout(b), _top(pruned(b)), _top(blended(b)), b.reads)


_PROF = _READ + """
, oc AS (SELECT species, sum(count) AS mass, count(DISTINCT read) AS read_support FROM ro WHERE species <> 'unclassified' GROUP BY 1),
ob AS (SELECT oc.*, genus, total AS callable, sources, CASE WHEN total > 0 THEN mass / total ELSE 0 END AS observation, (SELECT count(DISTINCT read) FROM post) AS cands FROM oc LEFT JOIN counters USING (species) LEFT JOIN (SELECT species, genus, count(*) AS sources FROM refs GROUP BY 1, 2) USING (species)),
o1 AS (SELECT *, CASE WHEN sum(observation) OVER () > 0 THEN observation / sum(observation) OVER () ELSE 0 END AS raw FROM ob),
o2 AS (SELECT *, greatest(0.01::DOUBLE, least(0.05::DOUBLE, 0.5 * sum(raw * raw) OVER ())) AS fl FROM o1),
o3 AS (SELECT *, CASE WHEN NOT coalesce(callable > 0, false) THEN 'nuisance_no_callable_exposure' WHEN read_support < least(cands, greatest(3, ceil(0.01::DOUBLE * sqrt(cands)))) THEN 'nuisance_low_runtime_support' WHEN 100 * raw < fl THEN 'nuisance_below_dynamic_detection_floor' WHEN NOT raw > 0 THEN 'nuisance_no_abundance_response' WHEN sources <= 1 THEN 'single_source_limited_reportable' ELSE 'classifier_response_reportable' END AS reportability FROM o2),
prof AS (SELECT *, NOT starts_with(reportability, 'nuisance') AS kept, coalesce((CASE WHEN starts_with(reportability, 'nuisance') THEN 0 ELSE raw END) / nullif(sum(CASE WHEN starts_with(reportability, 'nuisance') THEN 0 ELSE raw END) OVER (), 0), 0) AS rel FROM o3)"""


def abundance(b: Base):
    """The profile: a row a species decided on, reportable or not."""
    rows = profile.observed(readout(b), b.archive.coverage, b.sources)
    cands = retained(b).agg(F.countDistinct("read").alias("cands"))
    return profile.reportable(rows.crossJoin(F.broadcast(cands)), "observation", "read_support", "sources", "callable", F.col("cands"))  # one row


@query(
    "k2_profile",
    "SELECT (row_number() OVER (ORDER BY round(rel, 9) DESC, kept DESC, round(raw, 9) DESC, species))::INTEGER AS place, 'species' AS rank, species AS taxid, species AS name, round(rel, 6) AS relative_abundance, round(100 * rel, 4) AS percentage, read_support, round(mass, 6) AS assigned_mass, callable AS effective_yield, sources AS measurement_unit_support, genus AS parent_taxid, genus AS parent_name, genus AS genus_taxid, genus AS genus_name, 'root;' || genus || ';' || species AS lineage_taxids, 'root;' || genus || ';' || species AS lineage_names, sources <= 1 AS single_source_limited, reportability FROM prof",
    _PROF,
)
def _(b: Base):
    return profile.table(abundance(b))


@query("k3_cami_profile", "SELECT species AS taxid, 'species' AS rank, genus || '|' || species AS taxpath, genus || '|' || species AS taxpathsn, round(100 * rel, 4) AS percentage FROM prof WHERE kept UNION ALL SELECT genus, 'genus', genus, genus, round(sum(100 * rel), 4) FROM prof WHERE kept GROUP BY 1", _PROF)
def _(b: Base):
    return profile.cami(abundance(b))


@query("k4_read_trace", "SELECT d.read, d.species, d.mode, round(d.count, 6) AS weight, round(d.count / p.mass * rel, 9) AS contribution, round(100 * d.count / p.mass * rel, 6) AS percentage_contribution FROM ro d JOIN prof p USING (species) WHERE kept", _PROF)
def _(b: Base):
    return profile.read_trace(readout(b), abundance(b)).select("read", "species", "mode", r6(F.col("weight"), "weight"), F.round("contribution", 9).alias("contribution"), r6(F.col("percentage_contribution"), "percentage_contribution"))


@query("a20_local_mix", "SELECT species, round(sum(sqrt(q) / t), 6) AS mass FROM (SELECT *, sum(sqrt(q)) OVER (PARTITION BY read) AS t FROM (SELECT *, first_value(genus) OVER (PARTITION BY read ORDER BY round(q, 9) DESC, genus DESC) AS bg FROM pr) WHERE genus = bg) GROUP BY 1", _PRUNE)
def _(b: Base):
    return profile.shared_mass(pruned(b)).select("species", r6(F.col("mass"), "mass"))


@query("j12_profile_response", "SELECT species, round(mass, 6) AS mass, round(coalesce(m, 0), 6) AS response FROM prof LEFT JOIN (SELECT species, sum(q) AS m FROM pr GROUP BY 1) USING (species)", _PROF)
def _(b: Base):
    response = pruned(b).groupBy("species").agg(F.sum("q").alias("m"))
    return abundance(b).join(response, "species", "left").select("species", r6(F.col("mass"), "mass"), r6(F.coalesce("m", F.lit(0.0)), "response"))


_F13 = """, fr0 AS (SELECT l_suppkey AS taxon, sum(l_quantity) AS value, count(*) AS support, count(DISTINCT l_linenumber) AS sources, sum(l_tax) AS callable FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
fr1 AS (SELECT *, value / sum(value) OVER () AS p, sum(support) OVER () AS reads FROM fr0), fr2 AS (SELECT *, greatest(0.01::DOUBLE, least(0.05::DOUBLE, 0.5 * sum(p * p) OVER ())) AS fl FROM fr1),
fr3 AS (SELECT *, CASE WHEN NOT callable > 0 THEN 'nuisance_no_callable_exposure' WHEN support < least(reads, greatest(3, ceil(0.01::DOUBLE * sqrt(reads)))) THEN 'nuisance_low_runtime_support' WHEN 100 * p < fl THEN 'nuisance_below_dynamic_detection_floor' WHEN sources <= 1 THEN 'single_source_limited_reportable' ELSE 'classifier_response_reportable' END AS reportability FROM fr2)"""


@query("f13_reportability", "SELECT taxon, round(p, 6) AS raw_abundance, reportability, round(coalesce((CASE WHEN starts_with(reportability, 'nuisance') THEN 0 ELSE p END) / sum(CASE WHEN starts_with(reportability, 'nuisance') THEN 0 ELSE p END) OVER (), 0), 6) AS relative_abundance FROM fr3", _F13)
def _(b: Base):
    rows = b.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("taxon")).agg(F.sum("l_quantity").alias("value"), F.count("*").alias("support"), F.countDistinct("l_linenumber").alias("sources"), F.sum("l_tax").alias("callable"))
    out = profile.reportable(rows.withColumn("reads", F.sum("support").over(profile.whole())), "value", "support", "sources", "callable", F.col("reads"))
    return out.select("taxon", r6(F.col("raw_abundance"), "raw_abundance"), "reportability", r6(F.col("relative_abundance"), "relative_abundance"))


@query(
    "a19_normalised_profile",
    "SELECT key, round(a / sum(a) OVER (), 6) AS by_length, round(r / sum(r) OVER (), 6) AS by_root, round(c / sum(c) OVER (), 6) AS by_callable, round(u / sum(u) OVER (), 6) AS by_unique FROM (SELECT key, n / len AS a, n / sqrt(len) AS r, n / greatest(call, 1) AS c, n / greatest(uni, 1) AS u FROM (SELECT lang || '/' || source AS key, count(*)::DOUBLE AS n, median(n_chars) AS len, median(n_chars - 27) AS call, median(n_chars // 17) AS uni FROM documents GROUP BY 1))",
)
def _(b: Base):
    rows = b.documents.select(F.concat_ws("/", "lang", "source").alias("key"), F.lit(1).alias("one"), "n_chars", (F.col("n_chars") - 27).alias("call"), F.floor(F.col("n_chars") / 17).alias("uni"))
    out = profile.normalised(rows, "key", "one", "n_chars", "call", "uni")
    return out.select("key", *(r6(F.col(c), c) for c in ("by_length", "by_root", "by_callable", "by_unique")))


@query("a21_median_lengths", "SELECT lang, source, median(n_chars) AS median_chars FROM documents GROUP BY 1, 2")
def _(b: Base):
    return b.documents.groupBy("lang", "source").agg(F.median("n_chars").alias("median_chars"))


# --- local resolution ------------------------------------------------------------------

_ANCH = f"""
, {K.minimizers("qm", "passages", "read")}, {K.minimizers("tm", "refs", "tid")},
qa AS (SELECT read, pos, code AS key, strand FROM qm), ta AS (SELECT tid, pos, code AS key, strand FROM tm),
tr AS (SELECT * FROM ta WHERE key IN (SELECT key FROM ta GROUP BY 1 HAVING count(*) <= 500)),
ah0 AS (SELECT read, tid, q.pos AS qpos, t.pos AS tpos, xor(q.strand, t.strand) AS orient FROM qa q JOIN tr t USING (key)),
ch AS (SELECT read, tid, orient, diag, count(*) AS n, 50 * count(*) + floor(least(max(qpos) - min(qpos), max(tpos) - min(tpos)) / 20)::BIGINT AS score
  FROM (SELECT *, trunc((CASE WHEN orient = 0 THEN tpos - qpos ELSE tpos + qpos END) / 256)::INTEGER AS diag FROM ah0) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4)"""


def anchors(b: Base):
    """The minimizers of the passages, and the archive's of the references."""
    return features.anchors(b.passages), b.archive.anchors


def chained(b: Base):
    """Chains of the passages' minimizers; of the references' only those with a key of a passage are held, all of a key's or none."""
    q = features.anchors(b.passages)
    keys = b.spool.held("keys", lambda: q.select("key").distinct())
    t = b.spool.held("met", lambda: features.anchors(b.refs.select("tid", "seq")).join(keys, "key", "left_semi"))
    return local.chains(local.anchor_hits(q, local.rare_keys(t)))


@query("f16_rare_anchor_keys", "SELECT tid, key, pos FROM tr", _ANCH)
def _(b: Base):
    return local.rare_keys(anchors(b)[1]).select("tid", "key", F.col("pos").cast("long").alias("pos"))


@query("f15_query_key_filter", "SELECT tid, key, pos FROM ta WHERE key IN (SELECT key FROM qa)", _ANCH)
def _(b: Base):
    q, t = anchors(b)
    return t.join(q.select("key"), "key", "left_semi").select("tid", "key", F.col("pos").cast("long").alias("pos"))


@query("j10_anchor_join", "SELECT read, tid, qpos, tpos, orient FROM ah0", _ANCH)
def _(b: Base):
    q, t = anchors(b)
    return local.anchor_hits(q, local.rare_keys(t)).select("read", "tid", F.col("qpos").cast("long").alias("qpos"), F.col("tpos").cast("long").alias("tpos"), "orient")


@query("a25_chain_scores", "SELECT read, tid, orient, diag, n, score FROM ch", _ANCH)
def _(b: Base):
    return chained(b).select("read", "tid", "orient", "diag", "n", "score")


@query("t3_local_scores", "SELECT read, species, mass, row_number() OVER (PARTITION BY read ORDER BY mass DESC, species)::INTEGER AS rn FROM (SELECT read, species, sum(score)::BIGINT AS mass FROM ch JOIN refs USING (tid) GROUP BY 1, 2)", _ANCH)
def _(b: Base):
    mass = chained(b).join(b.refs.select("tid", "species"), "tid").groupBy("read", "species").agg(F.sum("score").alias("mass"))
    return score.ranked(mass.withColumnRenamed("mass", "score")).select("read", "species", F.col("score").alias("mass"), "rn")


@query("w12_even_budget", "SELECT read, pos, hash FROM (SELECT *, count(*) OVER (PARTITION BY read) AS n, row_number() OVER (PARTITION BY read ORDER BY pos) - 1 AS place FROM rfeat) WHERE n <= 256 OR list_contains(list_transform(range(256), lambda i: i * n // 256), place)")
def _(b: Base):
    return local.even_tokens(b.rfeat, "read", "pos").select("read", F.col("pos").cast("long").alias("pos"), "hash")


_TGT = ", tg AS (SELECT doc_id AS target, lang AS genus, lang || '/' || source AS species, source || '/' || (doc_id % 12) AS source, n_chars // 10 AS anchors, n_chars AS length FROM documents), tq0 AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY anchors DESC, length DESC, target) AS rn FROM tg), tq1 AS (SELECT *, min(rn) OVER (PARTITION BY species, source) AS first, row_number() OVER (PARTITION BY species, source ORDER BY rn) AS own FROM tq0), tq2 AS (SELECT *, dense_rank() OVER (PARTITION BY species ORDER BY first) AS s FROM tq1), kt AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY rn) AS place FROM tq2 WHERE s <= 8 AND own <= 32)"


def targets(b: Base):
    rows = b.documents.select(F.col("doc_id").alias("target"), F.col("lang").alias("genus"), F.concat_ws("/", "lang", "source").alias("species"), F.concat_ws("/", "source", (F.col("doc_id") % 12).cast("string")).alias("source"), F.floor(F.col("n_chars") / 10).alias("anchors"), F.col("n_chars").alias("length"))
    return local.kept_targets(rows)


@query("w13_target_retention", "SELECT target, species, place::INTEGER AS place FROM kt", _TGT)
def _(b: Base):
    return targets(b).select("target", "species", "place")


@query("w14_round_robin", "SELECT target, genus, row_number() OVER (PARTITION BY genus ORDER BY turn, species)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY genus, species ORDER BY place) AS turn FROM kt)", _TGT)
def _(b: Base):
    return local.round_robin(targets(b)).select("target", "genus", "rank")


_PANEL = _TGT + ", pg AS (SELECT * FROM (SELECT genus, row_number() OVER (ORDER BY sum(length) DESC, genus) AS g FROM kt GROUP BY 1) WHERE g <= 32), ps AS (SELECT * FROM (SELECT genus, species, row_number() OVER (PARTITION BY genus ORDER BY sum(length) DESC, species) AS s FROM kt GROUP BY 1, 2) WHERE s <= 8), panel AS (SELECT * FROM (SELECT kt.*, row_number() OVER (PARTITION BY genus ORDER BY ps.s, target) AS t FROM kt JOIN pg USING (genus) JOIN ps USING (genus, species)) WHERE t <= 32)"


def panel(b: Base):
    return local.panel(targets(b).withColumn("mass", F.col("length")))


@query("w15_resolution_panel", "SELECT target, genus, species, t::INTEGER AS t FROM panel", _PANEL)
def _(b: Base):
    return panel(b).select("target", "genus", "species", "t")


@query("w15_byte_budget")
def _(b: Base):
    rows = panel(b).select("genus", "t", "target", "length")
    return local.within_budget(rows, "genus", "t", "length", 40_000, "genus string, t int, target long, length long")


@query("j13_panel_targets", "SELECT d.read, p.target, p.species FROM ro d JOIN panel p USING (species)", _READ + _PANEL)
def _(b: Base):
    return readout(b).select("read", "species").join(panel(b).select("target", "species"), "species")


_A24 = _PRUNE + ", pk AS (SELECT count(*) AS reads, avg(n) AS items, avg((n = 1)::INTEGER) AS singleton, avg((top < 0.9)::INTEGER) AS ambiguous, avg(top) AS top1 FROM (SELECT read, count(*) AS n, max(q) AS top FROM pr GROUP BY 1))"


@query("a24_post_topk", "SELECT reads, round(items, 6) AS items, round(singleton, 6) AS singleton, round(ambiguous, 6) AS ambiguous, round(top1, 6) AS top1 FROM pk", _A24)
def _(b: Base):
    return local.post_topk(pruned(b)).select("reads", *(r6(F.col(c), c) for c in ("items", "singleton", "ambiguous", "top1")))


@query("f14_local_eligibility", "SELECT items >= 3 AND singleton <= 0.5 AND top1 <= 0.85::DOUBLE AND ambiguous >= 0.5 AS eligible FROM pk", _A24)
def _(b: Base):
    return local.eligible(local.post_topk(pruned(b))).select("eligible")


@query("x15_local_override", "SELECT DISTINCT d.read, CASE WHEN c.read IS NULL THEN d.species ELSE c.taxon END AS species FROM ro d LEFT JOIN (SELECT read, arg_max(species, {'s': mass, 't': sid}) AS taxon FROM (SELECT *, dense_rank() OVER (ORDER BY species) AS sid FROM (SELECT read, species, sum(score)::BIGINT AS mass FROM ch JOIN refs USING (tid) GROUP BY 1, 2)) GROUP BY 1) c USING (read)", _READ + _ANCH)
def _(b: Base):
    calls = chained(b).join(b.refs.select("tid", "species"), "tid").groupBy("read", F.col("species").alias("taxon")).agg(F.sum("score").alias("score"))
    return local.overridden(readout(b), calls).select("read", "species").distinct()


@query("j11_read_local_call", "SELECT d.read, coalesce(c.n, 0) AS calls FROM (SELECT DISTINCT read FROM passages) d LEFT JOIN (SELECT read, count(DISTINCT tid) AS n FROM ch GROUP BY 1) c USING (read)", _ANCH)
def _(b: Base):
    calls = chained(b).groupBy("read").agg(F.countDistinct("tid").alias("n"))
    return b.passages.select("read").distinct().join(calls, "read", "left").select("read", F.coalesce("n", F.lit(0)).alias("calls"))


@query("x26_local_json", "SELECT read, '{\"reads\":' || count(*) || ',\"score\":' || sum(score)::BIGINT || '}' AS json FROM ch GROUP BY 1", _ANCH)
def _(b: Base):
    own = chained(b).groupBy("read").agg(F.count("*").alias("reads"), F.sum("score").alias("score"))
    return own.select("read", F.to_json(F.struct("reads", "score")).alias("json"))
