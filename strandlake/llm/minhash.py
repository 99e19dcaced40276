"""Near-duplicate documents: a signature-coordinate inverted join.

A document's set of word shingles gets a signature of `COORDS` minima. It is posted under
coordinate-value pairs; two documents above the threshold agree in at least `least`
coordinates but for a chance of under 1e-4, and so share one of the first COORDS - least + 1 pairs
of both, whatever the order. The order is rare pairs first, by a sketch of all documents'
pairs of fixed size, so values of passages that many documents share are seldom posted.
Pairs of a list are merged with skipping: coordinates agreeing are counted for pairs of
different components only, in the list of their first shared pair; those that match often
enough are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import Tables, bitmap, id_text, in_bitmap, map_arrow, unused

COORDS = 64
WIDTH = 5  # bytes of a coordinate's value: chance matches stay rare in billions of documents
SKETCH = 18  # bits: counters of the frequency sketch
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_ROLL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAG = _rng.integers(1, 1 << 62, COORDS, dtype=np.int64)
_CACHE = 150_000
_word: dict[bytes, int] = {}


def least_matches(percent: int) -> int:
    """Coordinates that agree at a similarity of percent / 100, less four standard deviations and a half."""
    j = percent / 100
    return max(1, int(COORDS * j - 4.5 * (COORDS * j * (1 - j)) ** 0.5))


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, ASCII white space between words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    if len(_word) > _CACHE:
        _word.clear()
    hashes = [x if (x := _word.get(w)) is not None else _word.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words]
    h, n = np.array(hashes, np.uint64), len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _ROLL[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(grams: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's permutation, mixed to WIDTH bytes: rows of a byte matrix."""
    out = np.full(COORDS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(grams), 512):
        part = grams[at : at + 512]
        out = np.minimum(out, (part[None] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return np.ascontiguousarray(_mixed(out).view(np.uint8).reshape(COORDS, 8)[:, :WIDTH])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def values(sigs: list[bytes]) -> np.ndarray:
    """The coordinates' values of packed signatures, a row each."""
    out = np.zeros((len(sigs), COORDS, 8), np.uint8)
    out[:, :, :WIDTH] = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), COORDS, WIDTH)
    return out.view(np.uint64)[:, :, 0]


def pair_keys(sigs: list[bytes]) -> np.ndarray:
    """A 64-bit key of each coordinate-value pair, a row a signature."""
    return _mixed(values(sigs) * np.uint64(0x9E3779B97F4A7C15) ^ _TAG.astype(np.uint64)).view(np.int64)


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, digest, sig): digest of the whole set and its signature, null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for t in batch["text"].cast(pa.binary()).to_pylist():
                grams = shingles(t, size)
                n.append(len(grams))
                digest.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                sig.append(signature(grams).tobytes() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, digest binary, sig binary")


def _sketch(reps: DataFrame) -> np.ndarray:
    """How many documents post pairs of each of 2^SKETCH classes: a fixed number of counters, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            keys = pair_keys(batch["sig"].to_pylist()).view(np.uint64) >> np.uint64(64 - SKETCH)
            count += np.bincount(keys.ravel().astype(np.int64), minlength=1 << SKETCH)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at])], ["at", "n"])

    total = map_arrow(reps.select("sig"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH, np.int64)
    out[total["at"].to_numpy()] = total["n"].to_numpy()
    return out


def _prefix(sigs: list[bytes], count: np.ndarray, length: int) -> np.ndarray:
    """The first `length` pair keys of each signature, rare classes first, in one order for all documents."""
    keys = pair_keys(sigs)
    rare = count[keys.view(np.uint64) >> np.uint64(64 - SKETCH)]
    return np.take_along_axis(keys, np.lexsort((keys, rare))[:, :length], 1)


def near(docs: DataFrame, percent: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`.

    Documents are linked where 100 * intersection >= percent * union of their sets; the
    component is the smallest doc_id that links reach. A null or empty text has an empty
    set and is linked with nothing. A row without an id is linked with nothing, has no
    component and is kept. Rows that repeat an id with different texts are one document:
    it is linked by any of its texts. Other columns are not read; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    least = least_matches(percent)
    length = COORDS - least + 1
    base = id_text(docs, id_col, text_col)
    sigs = tables.keep(signatures(base, size))
    own = sigs.where("doc_id is not null and digest is not null")
    # copies of a set are one: its smallest id stands for it; an id may stand for several sets
    first = tables.keep(own.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    count = spark.sparkContext.broadcast(_sketch(first))
    # the sets of a document with several are linked through it
    several = tables.keep(own.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id"))
    also = None
    if tables.rows(several):
        also = own.join(several, "doc_id").join(first.select("digest", "id"), "digest").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _prefix(batch["sig"].to_pylist(), count.value, length)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch["id"].to_numpy(), length), pa.int64())], ["key", "id"])

    postings = map_arrow(first.select("id", "sig"), post, "key long, id long")

    def sieve(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (values(batch[c].to_pylist()) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

        left, right = (first.select(F.col("id").alias(k), F.col("sig").alias(s)) for k, s in (("a", "x"), ("b", "y")))
        return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")

    def payload(ids: DataFrame) -> DataFrame:
        held = bitmap(ids, "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(in_bitmap(held.value, batch["doc_id"].to_numpy()).astype(bool)))
                digest, light, data = [], [], []
                for t in batch["text"].cast(pa.binary()).to_pylist():
                    grams = shingles(t, size)
                    digest.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    light.append(signature(grams).tobytes() + len(grams).to_bytes(8, "little"))
                    data.append(grams.tobytes())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.binary()) for c in (digest, light, data))], ["id", "digest", "light", "data"])

        sets = map_arrow(base.where("doc_id is not null"), run, "id long, digest binary, light binary, data binary")
        return sets.join(ids, "id", "left_semi").dropDuplicates(["id", "digest"]).drop("digest")

    def check(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
            return False
        at = np.searchsorted(a, b)
        at[at == len(a)] = 0
        both = int((a[at] == b).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    def likely(key: int, lights: tuple[bytes, ...], labels: np.ndarray) -> list[tuple[int, int]]:
        packed = [d[: WIDTH * COORDS] for d in lights]
        sigs = values(packed)
        sizes = np.array([int.from_bytes(d[WIDTH * COORDS :], "little") for d in lights])
        found = []
        for at, row in enumerate(sigs):  # by rows, so no cube of all pairs stands in memory
            more = sizes[at + 1 :]
            fit = (labels[at + 1 :] != labels[at]) & (100 * np.minimum(more, sizes[at]) >= percent * np.maximum(more, sizes[at]))
            rest = at + 1 + np.flatnonzero(fit)
            agree = (sigs[rest] == row).sum(axis=1)
            found += [(-n, at, b) for n, b in zip(agree.tolist(), rest.tolist()) if n >= least]
        if not found:
            return []
        prefix = _prefix(packed, count.value, length).tolist()
        sets = [set(x) for x in prefix]
        # a pair that shares several keys is merged in the list of the first
        return [(a, b) for _, a, b in sorted(found) if next((k for k in prefix[a] if k in sets[b]), key) == key]

    labels = linking.link(postings, linking.Items(payload, check, likely, sieve), tables, also)
    known = first.join(tables.small(labels), "id", "left").select(F.col("digest").alias("d"), F.coalesce("component", "id").alias("component"))
    # null digests are spread, as a join would send them all to one task
    linked = own.join(known, F.col("digest") == F.col("d")).select("doc_id", "n_shingles", F.least("component", "doc_id").alias("component_id"))
    alone = sigs.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose document stays: of each component the one with the smallest id, all its rows.

    80 is the threshold of a stage without a contract of its own; op8's contract asks near() for 85.
    """
    (gone,) = unused(docs, "gone")
    out = near(docs, percent, size, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, docs[id_col].cast("long") == F.col(gone), "left_anti")
