"""Toxicity by non-negative positive-unlabelled learning.

Two linear numpy classifiers, one over words and one over character n-grams within
words, are trained from confirmed toxic texts (positive) and any other text
(unlabelled) with the class-prior-corrected risk

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]),

l the logistic loss, flat beyond log odds of `most`. Where the second term would be negative its gradient is reversed,
so the classifiers can't gain by calling known positives negative. The score is the
mean of both probabilities. Training takes bounded numbers of texts (`Config`); both it
and scoring read every text whole, wherever in it the evidence stands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, held_out, id_text, map_arrow, materialize, unused

_EDGE = ".,;:!?\"'()[]{}<>|*#$%&@~+=-_/\\…«»„“”¡¿"
_CACHE = 300_000


@dataclass(frozen=True)
class Config:
    """Bounds of the training sample and the optimiser's settings; none grows with the corpus."""

    positives: int = 2500
    unlabelled: int = 6000
    bits: int = 18
    grams: tuple[int, ...] = (4, 5)
    kept: int = 2000  # features of a classifier
    least_z: float = 4.0  # by which a feature's frequencies must differ, in standard errors
    steps: int = 300
    rate: float = 0.05
    together: float = 20.0  # full steps that a row's features may take at one time
    decay: float = 1e-4
    most: float = 4.0  # log odds beyond which a row's loss is flat, or a prior a little too high would outweigh all clean texts
    prior: float | None = None  # None: the share of positives among the labelled training rows


def words(text: str) -> list[str]:
    """The distinct words, lower case, without punctuation at the edges, sorted by first place."""
    return [w for w in dict.fromkeys([x.strip(_EDGE) for x in text.lower().split()]) if w]


class Features:
    """Hashed features of a word, kept in a bounded cache; kind 0: the word, 1: its n-grams."""

    def __init__(self, config: Config):
        self.config, self.cache = config, ({}, {})

    def word(self, kind: int, w: str) -> tuple[int, ...]:
        got = self.cache[kind].get(w)
        if got is None:
            got = self.hashed(kind, w)
            if len(self.cache[kind]) >= _CACHE:
                self.cache[kind].clear()
            self.cache[kind][w] = got
        return got

    def hashed(self, kind: int, w: str) -> tuple[int, ...]:
        mask = (1 << self.config.bits) - 1
        if kind == 0:
            return (zlib.crc32(w.encode("utf-8", "replace")) & mask,)
        padded = f"<{w}>"
        return tuple({zlib.crc32(padded[i : i + n].encode("utf-8", "replace")) & mask for n in self.config.grams for i in range(max(1, len(padded) - n + 1))})

    def text(self, kind: int, ws: list[str]) -> np.ndarray:
        return np.unique(np.fromiter((f for w in ws for f in self.word(kind, w)), np.int32))


def telling(n_p: np.ndarray, n_u: np.ndarray, pos: int, unl: int, config: Config) -> np.ndarray:
    """The features clearly more frequent in `pos` positive than in `unl` unlabelled texts, the clearest first."""
    p, u = n_p / pos, (n_u + 0.5) / (unl + 1)
    z = (p - u) / np.sqrt(u * (1 / pos + 1 / unl))
    best = np.argsort(-z, kind="stable")[: config.kept]
    return best[(z[best] >= config.least_z) & (n_p[best] >= 3)]


def bounded_prior(n_p: np.ndarray, n_u: np.ndarray, pos: int, unl: int, prior: float) -> float:
    """The prior, or less where a feature proves it: unlabelled texts hold it at least prior times as often as positive ones."""
    p, u = n_p / pos, n_u / unl
    often = n_p >= 20
    bound = (u + 2 * np.sqrt((u + 1 / unl) / unl))[often] / (p - 2 * np.sqrt(p * (1 - p) / pos))[often].clip(1e-9)
    return float(max(0.01, min([prior, *bound])))


def risk(z: np.ndarray, is_p: np.ndarray, share: np.ndarray, prior: float, most: float) -> tuple[float, float, np.ndarray]:
    """The positive and the unlabelled part of the risk at log odds z, and the direction to go down by row.

    That is the gradient of their sum; where the unlabelled part is negative, the gradient
    of the negated part alone.
    """
    z, sure = np.clip(z, -most, most), np.abs(z) > most
    y = 1 / (1 + np.exp(-z))
    loss_neg = np.logaddexp(0, z) * share
    rest = loss_neg[~is_p].sum() - prior * loss_neg[is_p].sum()
    negative = y * share * ~sure * np.where(is_p, -prior, 1.0)  # gradient of the unlabelled part
    grad = -negative if rest < 0 else negative + np.where(is_p, prior * (y - 1) * share, 0.0)
    return prior * float((np.logaddexp(0, -z) * share)[is_p].sum()), float(rest), grad


def fit(pos: list[np.ndarray], unl: list[np.ndarray], keep: np.ndarray, prior: float, config: Config) -> tuple[np.ndarray, float]:
    """Weights and intercept of one classifier from rows of places in `keep`; all zero if it is empty."""
    w = np.zeros(1 << config.bits)
    if not keep.size:
        return w, float(np.log(prior / (1 - prior)))
    rows = pos + unl
    at, cols = np.repeat(np.arange(len(rows)), [len(c) for c in rows]), np.concatenate(rows)
    is_p = np.arange(len(rows)) < len(pos)
    share = np.where(is_p, 1 / len(pos), 1 / len(unl))
    theta = np.zeros(len(keep) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    # a row's score moves by its features' steps together: features of long rows (many copies of one text) take shorter ones
    sizes = np.bincount(at, minlength=len(rows))
    typical = np.bincount(cols, sizes[at] * share[at], len(keep)) / np.bincount(cols, share[at], len(keep))
    rate = config.rate * np.append(np.minimum(1, config.together / typical), 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, config.steps + 1):
        z = np.bincount(at, theta[cols], len(rows)) + theta[-1]
        grad = risk(z, is_p, share, prior, config.most)[2]
        g = np.append(np.bincount(cols, grad[at], len(keep)), grad.sum())
        g[:-1] += config.decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (1 - (step - 1) / config.steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w[keep] = theta[:-1]
    return w, float(theta[-1])


def _sampled(docs: DataFrame, labels: DataFrame, config: Config) -> tuple[DataFrame, float]:
    """(doc_id, pos, f0, f1), the written feature rows of the sample's whole texts, and the prior.

    Rows that repeat an id are one document: the text with the least hash stands for it.
    """
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    marks = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    prior = config.prior
    if prior is None:
        prior = marks.agg(F.avg("toxic")).first()[0] or 0.0
    prior = min(0.9, max(0.01, prior))
    ranked = ids.join(marks, "doc_id", "left").select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("pos"), F.xxhash64("doc_id").alias("h"))
    # any training text is unlabelled, known positives too: their share there is the prior
    take = lambda pos, n: (ranked.where("pos") if pos else ranked).orderBy("h", "doc_id").limit(n).select("doc_id", F.lit(pos).alias("pos"))
    sample = F.broadcast(take(True, config.positives).unionAll(take(False, config.unlabelled)))  # of a stated size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features(config)
        for batch in batches:
            ws = [words(t) for t in batch["text"].to_pylist()]
            cols = [[f.text(k, w).tobytes() for w in ws] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["pos"], batch["h"], *(pa.array(c, pa.binary()) for c in cols)], ["doc_id", "pos", "h", "f0", "f1"])

    some = docs.join(sample, "doc_id").select("doc_id", "pos", F.xxhash64("text").alias("h"), "text")
    rows = map_arrow(some, run, "doc_id long, pos boolean, h long, f0 binary, f1 binary")
    one = rows.groupBy("doc_id", "pos").agg(F.min_by(F.struct("f0", "f1"), "h").alias("f"))
    return materialize(one.select("doc_id", "pos", "f.f0", "f.f1")), prior


def _counted(rows: DataFrame, config: Config) -> np.ndarray:
    """How many rows hold each feature, by kind and class (1: positive); a row holds it once. Summed in the executors."""
    size = 1 << config.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2, size), np.int64)
        for batch in batches:
            for pos, *fs in zip(batch["pos"].to_pylist(), *(batch[c] for c in ("f0", "f1"))):
                for k, f in enumerate(fs):
                    n[k, int(pos), np.frombuffer(f.as_buffer(), np.int32)] += 1
        flat = n.ravel()
        at = np.flatnonzero(flat)
        for i in range(0, len(at), 100_000):
            own = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(flat[own], pa.int64())], ["at", "n"])

    got = map_arrow(rows, run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * size)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(2, 2, size)


def _kept(rows: DataFrame, keeps: list[np.ndarray], config: Config) -> tuple[list, list]:
    """Of the positives and the unlabelled, the places in `keeps` of the features they hold; at most `kept` a row and kind."""
    places = np.full((2, 1 << config.bits), -1, np.int32)
    for k, keep in enumerate(keeps):
        places[k, keep] = np.arange(len(keep))
    held = rows.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = []
            for k, name in enumerate(("f0", "f1")):
                at = (held.value[k][np.frombuffer(f.as_buffer(), np.int32)] for f in batch[name])
                cols.append(pa.array([a[a >= 0].tobytes() for a in at], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["pos"], *cols], ["doc_id", "pos", "f0", "f1"])

    got = map_arrow(rows, run, rows.schema).collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.f0), bytes(r.f1)))
    unpack = lambda r: (np.frombuffer(r.f0, np.int32), np.frombuffer(r.f1, np.int32))
    return [unpack(r) for r in got if r.pos], [unpack(r) for r in got if not r.pos]


def train(docs: DataFrame, labels: DataFrame, config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> list[tuple[np.ndarray, float]]:
    """The two classifiers. Labels of the held-out fold are not read; without positives all weights are 0 and every text gets the least prior."""
    rows, prior = _sampled(id_text(docs, id_col, text_col), labels, config)
    n = _counted(rows, config)
    sizes = {r["pos"]: r["count"] for r in rows.groupBy("pos").count().collect()}
    n_pos, n_unl = sizes.get(True, 0), sizes.get(False, 0)
    keeps = [telling(n[k, 1], n[k, 0], n_pos, n_unl, config) if n_pos and n_unl else np.zeros(0, int) for k in (0, 1)]
    priors = [bounded_prior(n[k, 1][keeps[k]], n[k, 0][keeps[k]], n_pos, n_unl, prior) if keeps[k].size else prior for k in (0, 1)]
    pos, unl = _kept(rows, keeps, config)
    model = [fit([p[k] for p in pos], [u[k] for u in unl], keeps[k], priors[k], config) for k in (0, 1)]
    del pos, unl
    give_back()
    return model


class Scorer:
    """Scores of texts under a model; an instance a task."""

    def __init__(self, model: list[tuple[np.ndarray, float]], config: Config):
        self.model, self.features = model, Features(config)
        # of a written word, its features with a weight; two generations, so common words stay
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _look(self, raw: str) -> tuple:
        got = self.older.get(raw)
        if got is None:
            got = tuple((k, x) for w in words(raw) for k in (0, 1) for x in self.features.hashed(k, w) if self.model[k][0][x])
        if len(self.known) >= _CACHE // 2:
            self.older, self.known = self.known, {}
        self.known[raw] = got
        return got

    def __call__(self, text: str) -> float:
        get, hits = self.known.get, set()
        for raw in set(text.split()):
            got = get(raw)
            if got is None:
                got = self._look(raw)
            if got:
                hits.update(got)
        z = [b + sum(sorted(float(w[x]) for j, x in hits if j == k)) for k, (w, b) in enumerate(self.model)]
        return float(np.mean([1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in z]))


def _scored(docs: DataFrame, model: list[tuple[np.ndarray, float]], config: Config, text: str, out_schema: T.StructType) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([(w.astype(np.float32), b) for w, b in model])  # 2 x 2^bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value, config)
        for batch in batches:
            scores = pa.array([scorer(t or "") for t in batch[text].to_pylist()], pa.float64())
            keep = [c for c in batch.schema.names if c in out_schema.names]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), scores], [*keep, out_schema.names[-1]])

    return map_arrow(docs, run, out_schema)


def score(docs: DataFrame, model: list[tuple[np.ndarray, float]], config: Config = Config(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of `docs`, from its text alone.

    A null or empty text has no features and gets the intercepts' score; null or
    repeated ids are carried along; other columns are not read; an empty table gives none.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    return _scored(id_text(docs, id_col, text_col), model, config, "text", schema)


def keep_clean(docs: DataFrame, model: list[tuple[np.ndarray, float]], config: Config = Config(), text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score under one half, all their columns, whatever their names."""
    (name,) = unused(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return _scored(docs, model, config, text_col, schema).where(F.col(name) < 0.5).drop(name)
