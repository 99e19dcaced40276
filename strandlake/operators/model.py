"""Models fitted over all reads: mixture fits, presence, dispersion, readout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandlake.functions import scalars as S

from . import score

EPS = 1e-9
SUMS = 100_000  # numbers of a round that may come from its tasks


def log_likelihood(rows: DataFrame) -> DataFrame:
    """Adds loglik: 1.05 ln of the score a unit of evaluated evidence, against the read's best."""
    part = W.partitionBy("read")
    out = rows.withColumn("c", F.col("score") / F.col("evaluated")).withColumn("top", F.max("c").over(part)).withColumn("m", F.count("*").over(part))
    ratio = (F.col("c") + EPS) / (F.col("top") + F.col("m") * EPS)
    return out.withColumn("loglik", 1.05 * F.log(F.greatest(ratio, F.lit(EPS)))).drop("c", "top", "m")


def shares(rows: DataFrame, by: str = "species") -> DataFrame:
    """(by, mass): the candidates' shares of their read's score, summed."""
    p = F.col("score") / F.sum("score").over(W.partitionBy("read"))
    return rows.withColumn("p", p).groupBy(by).agg(F.sum("p").alias("mass"))


class Packed:
    """Candidates, one row a read, for models that go over them many times.

    A read's candidates are bounded by their selection. The taxa are numbered on the driver,
    a number a taxon; a round sends one weight a taxon out and gets one sum a taxon back.
    """

    def __init__(self, cand: DataFrame, value: str, by: str = "species", each: int = 50_000):
        self.by, self.spark = by, cand.sparkSession
        rows = cand.groupBy("read").agg(F.max("evaluated").alias("evaluated"), F.sort_array(F.collect_list(F.struct(F.col(by).alias("t"), F.col(value).alias("v"), F.col("score").alias("s")))).alias("c"))
        rows = rows.select("read", "evaluated", "c.t", "c.v", "c.s").persist()
        self.reads = rows.count()
        self.tasks = max(1, -(-self.reads // each))
        self.rows = rows.coalesce(self.tasks)
        self.taxa = sorted(r["t"] for r in rows.select(F.explode("t").alias("t")).distinct().collect())

    def _batches(self, fn: Callable, schema: str) -> DataFrame:
        """fn(batch, starts, taxon, value) of each batch, without reads that have no candidate."""
        number = {t: i for i, t in enumerate(self.taxa)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    size = batch["t"].value_lengths().to_numpy()
                    taxon = np.array([number[t] for t in batch["t"].flatten().to_pylist()], np.int64)
                    yield fn(batch, np.cumsum(size) - size, size, taxon, batch["v"].flatten().to_numpy())

        return self.rows.mapInArrow(run, schema)

    def sums(self, share: Callable, weigh: Callable) -> np.ndarray:
        """Over all reads, the sum of weigh(evaluated, q) by taxon; q = share(taxon, value), made to add up to one a read."""
        n = len(self.taxa)

        def part(batch, starts, size, taxon, value):
            q, top = normalised(share(taxon, value), starts, size)
            e = np.bincount(taxon, weigh(np.repeat(batch["evaluated"].to_numpy(), size), q, top), n)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(e)], ["at", "e"])

        rows = self._batches(part, "at long, e double")
        if self.tasks * n > SUMS:  # few enough are added up here, without a shuffle a round
            rows = rows.groupBy("at").agg(F.sum("e").alias("e"))
        got = rows.toArrow()
        return np.bincount(got["at"].to_numpy(), got["e"].to_numpy(), n)

    def posteriors(self, share: Callable) -> DataFrame:
        """(read, by, evaluated, score, q) of every candidate."""

        def part(batch, starts, size, taxon, value):
            row = pa.array(np.repeat(np.arange(batch.num_rows), size))
            q, _ = normalised(share(taxon, value), starts, size)
            return pa.RecordBatch.from_arrays([batch["read"].take(row), batch["t"].flatten(), batch["evaluated"].take(row), batch["s"].flatten(), pa.array(q)], ["read", self_by, "evaluated", "score", "q"])

        self_by, read = self.by, self.rows.schema["read"].dataType.simpleString()
        return self._batches(part, f"read {read}, {self.by} string, evaluated double, score double, q double")

    def weights(self, pi: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame(list(zip(self.taxa, pi.tolist())), f"{self.by} string, pi double")


def normalised(w: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(w) over its sum within each stretch, and the stretch's greatest of it for each place."""
    x = np.exp(w - np.repeat(np.maximum.reduceat(w, starts), size))
    q = x / np.repeat(np.add.reduceat(x, starts), size)
    return q, np.repeat(np.maximum.reduceat(q, starts), size)


def fit(cand: DataFrame, iterations: int = 100, power: float = 1.0, prior: DataFrame | None = None, prune: float = 2e-4, alpha: float = 1e-6, by: str = "species") -> tuple[DataFrame, DataFrame]:
    """(posteriors with q, class weights) of the assignment mixture.

    `prior` (by, scale) scales the start by its root; a taxon without one starts as it is.
    Posteriors use the weights before the last step. Rounds end early only where the next
    would change nothing.
    """
    mass = {r[by]: r["mass"] for r in shares(cand, by).collect()}
    scale = {r[by]: r["scale"] for r in prior.collect()} if prior is not None else {}
    held = Packed(log_likelihood(cand), "loglik", by)
    start = np.array([mass.get(t, 0.0) * (scale[t] ** 0.5 if (scale.get(t) or 0) > 0 else 1.0) for t in held.taxa])
    pi = np.where(start > 0, start, 1e-9 if prior is None else 1e-5)
    pi = before = pi / (pi.sum() or 1.0)

    def share(weights: np.ndarray) -> Callable:
        return lambda taxon, value: np.log(np.maximum(weights, EPS))[taxon] + value

    for _ in range(iterations if held.taxa else 0):
        before = pi
        e = held.sums(share(pi), lambda evaluated, q, top: evaluated * top**power * q)
        pi = (np.where(e < prune * e.max(), 0.0, e) + alpha) / (len(e) * alpha + e.sum())
        if np.array_equal(pi, before):
            break
    return held.posteriors(share(before)), held.weights(pi)


def mixture(cand: DataFrame, iterations: int = 10, by: str = "species") -> tuple[DataFrame, DataFrame]:
    """(posteriors with q, weights) of the sample mixture: likelihoods are scores, one half is added to each taxon; scores must be positive."""
    held = Packed(cand, "score", by)
    n = max(1, len(held.taxa))
    pi = np.full(len(held.taxa), 1 / n)

    def share(weights: np.ndarray) -> Callable:
        return lambda taxon, value: np.log(np.maximum(weights[taxon] * value, 1e-300))

    for _ in range(iterations if held.taxa else 0):
        pi = (held.sums(share(pi), lambda evaluated, q, top: q) + 0.5) / (held.reads + 0.5 * n)
    return held.posteriors(share(pi)), held.weights(pi)


def abundance_fit(cand: DataFrame, iterations: int, start: DataFrame | None = None, prune: float = 2e-4, alpha: float = 1e-6, by: str = "species") -> DataFrame:
    """(by, mass, pi) of the abundance mixture: responsibilities linear in the score, each read weighing its evaluated evidence.

    Expected masses below the pruning share of the largest are dropped before they are
    added up; mass is that of the last round. Scores must be positive.
    """
    held = Packed(cand, "score", by)
    n = len(held.taxa)
    given = {r[by]: r["pi"] for r in start.collect()} if start is not None else {}
    pi = np.array([given.get(t, 1 / max(1, n)) for t in held.taxa])
    e = np.zeros(n)
    for _ in range(iterations if n else 0):
        weights = np.maximum(pi, EPS)
        e = held.sums(lambda taxon, value, w=weights: np.log(w[taxon] * value), lambda evaluated, q, top: evaluated * q)
        e = np.where(e < prune * e.max(), 0.0, e)
        pi = (e + alpha) / (n * alpha + e.sum())
    return held.spark.createDataFrame(list(zip(held.taxa, e.tolist(), pi.tolist())), f"{by} string, mass double, pi double")


def sequence_profile(cand: DataFrame, near: float = 0.95, by: str = "species") -> DataFrame:
    """(by, assigned, unique, features, sequence_abundance): each read's mass among the taxa that come near its best score, by score."""
    part = W.partitionBy("read")
    rows = cand.groupBy("read", by).agg(F.max("score").alias("score"), F.max("evaluated").alias("evaluated"))
    rows = rows.withColumn("best", F.max("score").over(part)).where(F.col("score") >= near * F.col("best"))
    rows = rows.withColumn("share", F.col("score") / F.sum("score").over(part)).withColumn("n", F.count("*").over(part))
    out = rows.groupBy(by).agg(F.sum("share").alias("assigned"), F.sum(F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("unique"), F.sum(F.col("share") * F.col("evaluated")).alias("features"))
    return out.withColumn("sequence_abundance", F.col("assigned") / F.sum("assigned").over(W.partitionBy(F.lit(1))))  # a row a taxon


def community(rows: DataFrame, value: str) -> DataFrame:
    """One row: n, eff (inverse Simpson), head mass, Shannon entropy, u and s of positive amounts."""
    total = rows.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("k"))  # equal amounts together
    sums = total.agg(F.sum(F.col("x") * F.col("k")).alias("t"), F.sum("k").alias("n"), F.sum(F.col("x") * F.col("x") * F.col("k")).alias("t2"))
    sums = sums.withColumn("eff", F.col("t") * F.col("t") / F.col("t2"))
    held = F.sum("k").over(W.orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, 0))  # a row a distinct amount
    ranked = total.withColumn("held", held).crossJoin(F.broadcast(sums))
    want = F.ceil(F.round("eff", 9))
    taken = F.greatest(F.lit(0), F.least(F.col("k"), want - (F.col("held") - F.col("k"))))
    p = F.col("x") / F.col("t")
    out = ranked.agg(F.max("n").alias("n"), F.max("eff").alias("eff"), F.sum(taken * p).alias("head"), (-F.sum(F.col("k") * p * F.log(p))).alias("shannon"))
    u, s = S.dispersion(F.col("head"), F.exp("shannon"))
    return out.withColumn("u", u).withColumn("s", s)


def nearest_rank(rows: DataFrame, value: str, q: float) -> DataFrame:
    """(v): the value at place floor(q (n - 1)) of the ordered values; percentile_disc does not floor."""
    n = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("k"))
    held = F.sum("k").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    total = n.agg(F.sum("k").alias("n"))
    return n.withColumn("held", held).crossJoin(F.broadcast(total)).where(F.col("held") > F.floor(q * (F.col("n") - 1))).agg(F.min("v").alias("v"))


def presence(parts: DataFrame, scores: DataFrame, numbers: DataFrame, bits: int = 2048) -> DataFrame:
    """(species, hits, uniq, reads, unique_reads, unique_obs, breadth_obs): evidence a taxon, by its number in `numbers`.

    uniq sums the strength of hits of this taxon alone; unique_obs and breadth_obs count, by
    bitmaps, the hashes and the bins of hits that are of this taxon and in one bin alone.
    `scores` are those of `parts`: a read's occurrences have been put together there.
    """
    rows = scores.groupBy("read", "species").agg(F.sum("hits").alias("hits"), F.sum("uniq").alias("uniq"), F.max(F.col("uniq") > 0).alias("alone"))
    r = F.col("read").isNotNull().cast("long")
    stats = rows.groupBy("species").agg(F.sum("hits").alias("hits"), F.sum("uniq").alias("uniq"), F.sum(r).alias("reads"), F.sum(F.when(F.col("alone"), r).otherwise(0)).alias("unique_reads"))
    edge = parts.where("deg = 1 and dfb = 1").select(F.pmod("hash", F.lit(bits)).alias("low"), "bin", F.explode("taxa").alias("taxon"))
    seen = lambda c: F.coalesce(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod(c, F.lit(bits)) + 1))), F.lit(0))
    marks = score.named(edge, numbers).groupBy("species").agg(seen("low").alias("unique_obs"), seen("bin").alias("breadth_obs"))
    return stats.join(marks, "species", "left").na.fill(0, ["unique_obs", "breadth_obs"])


def _place(values: str, q: float, n: str | None = None) -> Column:
    """The value at place floor(q (n - 1)) of an ordered array, 0 if it is empty."""
    at = F.floor(q * (F.size(values) - 1)) + 1
    return F.coalesce(F.try_element_at(F.col(values), F.greatest(at, F.lit(1)).cast("int")), F.lit(0.0))


def exposed(stats: DataFrame, coverage: DataFrame, reads: DataFrame, span: int) -> DataFrame:
    """Adds density, callable counts and exposure: the unique signatures that all reads should show of a taxon.

    `coverage` (species, bp, total, unique, unique_density); `reads` is one row (n, average).
    """
    window = F.greatest(F.lit(1), F.col("average") - span + 1)
    out = stats.join(coverage.select("species", "bp", "total", "unique", "unique_density"), "species", "left").na.fill(0, ["bp", "total", "unique"]).na.fill(0.0, ["unique_density"])
    out = out.crossJoin(F.broadcast(reads))  # one row
    a_read = F.when(F.col("unique_density") > 0, F.col("unique_density") * window).when((F.col("total") > 0) & (F.col("bp") > 0), F.col("total") / F.col("bp") * window).otherwise(0.0)
    out = out.withColumn("expected", a_read).withColumn("e", a_read * F.col("n"))
    return out.withColumn("exposure", F.when(F.col("e") > 0, F.col("e")).otherwise(F.col("unique").cast("double"))).drop("e", "n", "average")


def presence_posterior(rows: DataFrame, mu: float = 1e-4, prior: float = 1e-3, tau: float = 4.6) -> DataFrame:
    """Adds local_factor, logodds, posterior and level to rows of exposed().

    A Poisson Bayes factor of the unique evidence C at its exposure over a noise rate mu. C
    is capped by what its distinct signatures can have given, and shrunk where the evidence
    of a taxon below the ninetieth percentile looks like that of the faintest third.
    """
    ratio = F.when(F.col("unique_obs") > 0, F.when(F.col("breadth_obs") > 0, F.least(F.lit(1.0), F.col("breadth_obs") / F.col("unique_obs"))).otherwise(1.0)).otherwise(0.0)
    rows = rows.withColumn("score", F.col("hits").cast("double")).withColumn("effective", F.col("unique_obs") * ratio)
    rows = rows.withColumn("rate", F.col("effective") / F.greatest(F.lit(1.0), F.col("score"))).withColumn("read_ratio", F.when(F.col("reads") > 0, F.col("unique_reads") / F.col("reads")).otherwise(0.0))
    ordered = lambda c: F.sort_array(F.collect_list(c))  # noqa: E731  a number a taxon
    cut = rows.agg(ordered("score").alias("s"), ordered(F.when(F.col("exposure") > 0, F.col("exposure"))).alias("e"))
    tenth = F.coalesce(F.try_element_at("e", F.least(F.floor(0.1 * F.size("e")) + 1, F.size("e")).cast("int")), F.lit(0.0))
    cut = cut.select(_place("s", 0.3).alias("faint"), _place("s", 0.9).alias("strong"), F.when(F.size("e") > 0, tenth).otherwise(0.0).alias("least"))
    rows = rows.crossJoin(F.broadcast(cut))  # one row
    names = ("unique_obs", "breadth_obs", "rate", "read_ratio")
    noise = rows.where(F.col("score") <= F.col("faint")).agg(*(ordered(F.col(c).cast("double")).alias(c) for c in names))
    rows = rows.crossJoin(F.broadcast(noise.select(*(_place(c, 0.95).alias(f"cut_{c}") for c in names))))  # one row
    exposure = F.when(F.col("exposure") > 0, F.col("exposure")).otherwise(F.greatest(F.lit(1.0), F.col("score")))
    most = F.col("effective") * F.when(F.col("unique") > 0, F.greatest(F.lit(1.0), exposure / F.col("unique"))).otherwise(1.0)
    capped = F.when(most > 0, F.when(F.col("uniq") > 0, F.least(F.col("uniq"), most)).otherwise(most)).otherwise(F.col("uniq"))
    count = F.when(capped > 0, capped).when(F.col("uniq") > 0, F.col("uniq")).otherwise(F.col("score"))
    like = F.least(F.lit(1.0), *(F.when(F.col(f"cut_{c}") > 0, F.col(c) / F.col(f"cut_{c}")).otherwise(1.0) for c in names))
    factor = F.when((F.col("strong") > 0) & (F.col("score") < F.col("strong")), F.greatest(F.lit(0.0), like)).otherwise(1.0)
    rows = rows.withColumn("u", F.greatest(exposure, F.col("least"))).withColumn("local_factor", factor).withColumn("C", count * factor)
    lam = F.greatest(F.lit(0.0), F.col("C") / F.col("u") - mu)
    bf = F.when(F.col("C") > 0, F.col("C") * F.log((lam + mu) / mu)).otherwise(0.0) - lam * F.col("u")
    rows = rows.withColumn("logodds", bf + F.log(F.lit(prior)) - F.log1p(F.lit(-prior))).withColumn("posterior", 1 / (1 + F.exp(-F.col("logodds"))))
    level = F.when(F.col("logodds") >= tau, "accept").when(F.col("logodds") <= -tau, "reject").otherwise("unknown")
    return rows.withColumn("level", level).drop("score", "rate", "read_ratio", "faint", "strong", "least", "u", "C", *(f"cut_{c}" for c in names))


def prior_scale(coverage: DataFrame, posterior: DataFrame, reads: DataFrame, span: int) -> DataFrame:
    """(species, scale): half the unique signatures expected of a read, half the presence posterior; taxa without either are left out."""
    window = F.greatest(F.lit(1), F.col("average") - span + 1)
    rows = coverage.select("species", "unique_density").crossJoin(F.broadcast(reads)).join(posterior.select("species", "posterior"), "species", "left")  # one row
    expected = F.col("unique_density") * window
    mixed = F.when(F.col("posterior").isNull(), expected).when(expected > 0, 0.5 * expected + 0.5 * F.col("posterior")).otherwise(F.col("posterior"))
    return rows.select("species", mixed.alias("scale")).where("scale > 0")


def least_weight(level: Column, least: float | Column, accepted: float = 1e-6, rejected: float = 2.0) -> Column:
    """The class weight that a taxon of a presence level needs."""
    least = F.lit(least) if isinstance(least, float) else least
    return F.when(level == "accept", F.least(least, F.lit(accepted))).when(level == "reject", F.least(F.lit(1.0), least * rejected)).otherwise(least)


def pruned(post: DataFrame, pi: DataFrame, levels: DataFrame, least: float = 5e-4, by: str = "species") -> DataFrame:
    """Posteriors of classes with enough weight for their presence, renormalised, with pi and level; a read that would lose all keeps all.

    `pi` and `levels` have a row a taxon.
    """
    part = W.partitionBy("read")
    rows = post.join(pi, by).join(levels.select(by, "level"), by, "left").na.fill("unknown", ["level"])
    rows = rows.withColumn("ok", F.col("pi") >= least_weight(F.col("level"), min(least, 1e-4))).withColumn("any", F.max("ok").over(part))
    rows = rows.where(F.col("ok") | ~F.col("any"))
    return rows.withColumn("q", F.when(F.col("any"), F.col("q") / F.sum("q").over(part)).otherwise(F.col("q"))).drop("ok", "any")


def decided(post: DataFrame, least: float = 5e-4) -> DataFrame:
    """(read, species, count, reason) from pruned(): the read's evidence dealt out by posterior if its best class has enough weight.

    Rejected taxa but the best get nothing; shares that round to nothing are left out, unless all do.
    """
    part = W.partitionBy("read")
    rows = post.withColumn("rn", F.row_number().over(part.orderBy(F.desc(F.round("q", 9)), "species")))
    fine = F.max(F.when(F.col("rn") == 1, F.col("pi") >= least_weight(F.col("level"), least))).over(part)
    rows = rows.withColumn("fine", fine).withColumn("takes", (F.col("q") > 0) & ((F.col("rn") == 1) | (F.col("level") != "reject")))
    total = F.when(F.col("evaluated") > 0, F.col("evaluated")).otherwise(1.0)
    share = F.when(F.col("takes"), F.col("q")).otherwise(0.0)
    rows = rows.withColumn("count", F.round(F.round(share / F.sum(share).over(part) * total, 9))).withColumn("most", F.max("count").over(part))
    rows = rows.withColumn("count", F.when(F.col("most") > 0, F.col("count")).when(F.col("rn") == 1, F.greatest(F.lit(1.0), F.round(total))).otherwise(0.0))
    good = rows.where(F.col("fine") & (F.col("count") > 0)).select("read", "species", "count", F.lit(None).cast("string").alias("reason"))
    bad = rows.where(~F.col("fine") & (F.col("rn") == 1)).select("read", F.lit("unclassified").alias("species"), F.lit(1.0).alias("count"), F.lit("posterior_weight").alias("reason"))
    return good.unionAll(bad)


def readout(decisions: DataFrame, mix: DataFrame, taxa: DataFrame) -> DataFrame:
    """Decisions, with `mode`, after two corrections by the sample mixture's posteriors `mix` (read, species, score, q).

    released: a read without enough class weight gets the best species, if its log odds
    outweigh half the log of the best score; switched: a read whose first species isn't the
    best of the best genus gets that one, if it gains more than local scores and the
    number of species cost.
    """
    eps, part = 1e-12, W.partitionBy("read")
    m = mix.join(taxa.select("species", "genus"), "species")
    m = m.withColumn("genus_mass", F.round(F.sum("q").over(W.partitionBy("read", "genus")), 9)).withColumn("k", F.count("*").over(part)).withColumn("by_score", F.row_number().over(part.orderBy(F.desc("score"), "species")))
    m = m.withColumn("best_score", F.max("score").over(part)).withColumn("second", F.max(F.when(F.col("by_score") == 2, F.col("score"))).over(part))
    m = m.withColumn("any", F.row_number().over(part.orderBy(F.desc(F.round("q", 9)), "species"))).withColumn("own", F.row_number().over(part.orderBy(F.desc("genus_mass"), "genus", F.desc(F.round("q", 9)), "species")))
    one = m.where("any = 1").select("read", F.col("species").alias("top"), F.col("q").alias("top_mass"), "best_score", "second", "k")
    two = m.where("own = 1").select("read", F.col("species").alias("new"), F.col("q").alias("new_mass"))
    d = decisions.withColumn("rn", F.row_number().over(part.orderBy(F.desc("count"), "species")))
    head = d.where("rn = 1").select("read", F.col("species").alias("head"), F.col("reason").alias("head_reason"))
    old = mix.select("read", F.col("species").alias("head"), F.col("q").alias("old_mass"))
    head = head.join(one, "read").join(two, "read").join(old, ["read", "head"], "left")
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("top_mass")))
    gain = F.log(p / (1 - p))
    cost = 0.5 * F.log1p(F.greatest(F.lit(0.0), F.col("best_score")))
    local = F.when(F.col("second") > 0, F.col("best_score") / F.col("second")).otherwise(1 + F.greatest(F.lit(0.0), F.col("best_score")))
    change = F.log(F.greatest(F.col("new_mass"), F.lit(eps)) / F.greatest(F.coalesce("old_mass", F.lit(0.0)), F.lit(eps)))
    price = F.greatest(F.log(F.greatest(F.lit(1.0), local)), 0.5 * F.log(F.greatest(F.lit(1.0), F.col("k").cast("double"))))
    out = F.col("head") == "unclassified"
    mode = F.when(out & (F.col("head_reason") == "posterior_weight") & (gain > cost), "released").when(~out & (F.col("head") != F.col("new")) & (F.col("new_mass") > 0) & (change > price), "switched").otherwise("kept")
    head = head.select("read", mode.alias("mode"), gain.alias("gain"), cost.alias("cost"), change.alias("change"), price.alias("price"), "top", "top_mass", "new", "new_mass")
    both = d.join(head, "read", "left").na.fill("kept", ["mode"]).where("mode = 'kept' or rn = 1")
    species = F.when(F.col("mode") == "released", F.col("top")).when(F.col("mode") == "switched", F.col("new")).otherwise(F.col("species"))
    count = F.when(F.col("mode") == "released", F.col("top_mass")).when(F.col("mode") == "switched", F.col("new_mass")).otherwise(F.col("count"))
    return both.select("read", species.alias("species"), count.alias("count"), F.when(F.col("mode") == "kept", F.col("reason")).alias("reason"), "mode", "gain", "cost", "change", "price")


def tail_mass(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Adds share and the running share from the smallest."""
    p = F.col(value) / F.sum(value).over(W.partitionBy(F.lit(1)))
    out = rows.withColumn("p", p)
    return out.withColumn("tail", F.sum("p").over(W.orderBy("p", by).rowsBetween(W.unboundedPreceding, 0)))
