"""Line dedup by a segment-partition edit join.

Two lines are alike within an edit distance of EDITS: cut into EDITS + 1 segments, one of
the two has a segment that the other holds unchanged, at a place that the lengths and the
segment's number bound. Lines are indexed by (length, segment number, segment); the
substrings that a line of at most EDITS more characters must share are probed, and a pair
is verified by a banded bit-parallel edit distance. Lines of at least `WORDS` words are also
alike if they have as many words and one at most differs, whatever its length: such lines
share their first or their second half of words. Lines shorter than `FUZZY` code points
are alike only if identical. Lines are compared without white space at their ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import Tables, bitmap, id_text, in_bitmap, map_arrow, unused

EDITS = 2
FUZZY = 24
WORDS = 8


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k.

    What both share at the start and the end is cut off. Bit d of row e tells whether the
    first j - k + d characters of a can become the first j of b with e edits; only the band
    of 2k + 1 diagonals is kept, and a band without a bit ends the work.
    """
    if abs(len(a) - len(b)) > k:
        return False
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return True
    while lo < hi:  # the longest common start
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the longest common end
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    m, n, full = len(a), len(b), (1 << (2 * k + 1)) - 1
    rows = [((1 << (e + 1)) - 1) << k & full for e in range(k + 1)]
    for j, c in enumerate(b):
        match = 0
        for d in range(2 * k + 1):
            if 0 <= (i := j - k + d) < m and a[i] == c:
                match |= 1 << d
        above, new = 0, []
        for e, row in enumerate(rows):
            now = row & match
            if e:
                now |= (rows[e - 1] >> 1) | rows[e - 1] | (new[-1] << 1)
            new.append(now & full)
        rows = new
        if not rows[k]:
            return False
    at = m - (n - k)
    return 0 <= at <= 2 * k and bool(rows[k] >> at & 1)


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of each segment; the later ones are longer by one if it doesn't come out even."""
    short, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def probes(length: int, k: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(length of the indexed line, segment number, start, size) of the substrings to probe, its own segments first."""
    out = []
    for less in range(k + 1):
        for i, (start, size) in enumerate(cuts(length - less, k + 1), 1):
            left, right = max(start - (i - 1), start + less - (k + 1 - i)), min(start + (i - 1), start + less + (k + 1 - i))
            for at in range(max(0, left), min(right, length - size) + 1):
                out.append((length - less, i, at, size))
    return out


def one_word(a: str, b: str) -> bool:
    """Whether both have the same number of words, WORDS at least, and one at most differs."""
    x, y = a.split(), b.split()
    return len(x) == len(y) >= WORDS and sum(map(ne, x, y)) <= 1


def alike(a: str, b: str) -> bool:
    return within(a, b, EDITS) or one_word(a, b)


_plans: dict[int, list] = {}


def keys_of(line: str) -> list[int]:
    """The 64-bit keys of a line's own segments, of its probes and of its halves of words, distinct."""
    n = len(line)
    plan = _plans.get(n)
    if plan is None:
        if len(_plans) > 20_000:
            _plans.clear()
        plan = _plans[n] = [((size << 20) + (length << 3) + i, 4 * at, 4 * (at + size)) for length, i, at, size in probes(n)]
    digest = xxhash.xxh3_64_intdigest
    wide = line.encode("utf-32-le", "surrogatepass")  # four bytes a code point, so places are known
    keys = {digest(wide[a:b], seed) for seed, a, b in plan}
    if half := halves(line):  # seeds of size 0, which no segment has
        m, one, two = half
        keys.add(digest(one.encode("utf-8", "surrogatepass"), (m << 3) + 1))
        keys.add(digest(two.encode("utf-8", "surrogatepass"), (m << 3) + 2))
    return list(keys)


def halves(line: str) -> tuple[int, str, str] | None:
    """The number of words and both halves of them, a blank between words; none below WORDS words."""
    if "  " not in line and line.isprintable():  # blanks are its only white space, one at a time
        m = line.count(" ") + 1
        if m < WORDS:
            return None
        two = line.split(" ", m // 2)[-1]
        return m, line[: len(line) - len(two) - 1], two
    words = line.split()
    m = len(words)
    return (m, " ".join(words[: m // 2]), " ".join(words[m // 2 :])) if m >= WORDS else None


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8"))


def _lines(text: str) -> list[str]:
    return [x.strip(" \t\r\x0b\x0c") for x in text.split("\n")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, digest): digest tells rows with one id and different texts apart."""
    return id_text(docs, id_col, text_col).withColumn("digest", F.xxhash64("text"))


def places(docs: DataFrame) -> DataFrame:
    """(id, doc_id, digest, line_no) of each line that isn't blank; id is a 64-bit hash of the line, line_no counts from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row, at = [], [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                for i, x in enumerate(_lines(text)):
                    if x:
                        ids.append(line_id(x))
                        row.append(k)
                        at.append(i)
            own = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([_signed(ids), batch["doc_id"].take(own), batch["digest"].take(own), pa.array(at, pa.int32())], ["id", "doc_id", "digest", "line_no"])

    return map_arrow(docs, run, "id long, doc_id long, digest long, line_no int")


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """The long enough lines of each batch, without most of the repeats within the task."""
    seen: set[int] = set()
    for batch in batches:
        out = []
        for text in batch["text"].to_pylist():
            for x in _lines(text):
                if len(x) >= FUZZY and (h := hash(x)) not in seen:
                    if len(seen) > 250_000:
                        seen.clear()
                    seen.add(h)
                    out.append(x)
        yield out


def classes(docs: DataFrame, tables: Tables) -> DataFrame:
    """(id, component) of the lines that are alike another one without being identical, in a written table."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fresh in _fresh(batches):
            keys = [keys_of(x) for x in fresh]
            ids = np.repeat(np.array([line_id(x) for x in fresh], np.uint64), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([_signed([k for ks in keys for k in ks]), pa.array(ids.view(np.int64))], ["key", "id"])

    texts = docs.select("text")
    # nearly all keys of a task differ, so they are met before they are added up; a line comes once a task
    shared = map_arrow(texts, post, "key long, id long").repartition("key").groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    held = bitmap(shared, "key")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for fresh in _fresh(batches):
            own = [keys_of(x) for x in fresh]
            flat = np.array([k for ks in own for k in ks], np.uint64)
            hit = in_bitmap(bits, flat).astype(bool)
            ends = np.cumsum([len(ks) for ks in own], dtype=np.int64)
            kept = np.add.reduceat(hit, ends - [len(ks) for ks in own], dtype=np.int64) if own else np.zeros(0, np.int64)
            lines = [x for x, n in zip(fresh, kept.tolist()) if n]
            ids = [line_id(x) for x in lines]
            light = [len(x.split()) << 32 | len(x) for x in lines]
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *kept[kept > 0]]), pa.int32()), pa.array(flat[hit].view(np.int64)))
            yield pa.RecordBatch.from_arrays([_signed(ids), pa.array(light, pa.int64()), pa.array(lines, pa.string()), keys], ["id", "light", "line", "keys"])

    # light: the numbers of words and of code points
    some = tables.keep(map_arrow(texts, again, "id long, light long, line string, keys array<long>").dropDuplicates(["id"]))

    def likely(key: int, lights: tuple[int, ...], labels: np.ndarray) -> list[tuple[int, int]]:
        both = np.array(lights)
        size, words = both & 0xFFFFFFFF, both >> 32
        near = (np.abs(size[:, None] - size[None]) <= EDITS) | ((words[:, None] == words[None]) & (words >= WORDS))
        fit = near & (labels[:, None] != labels[None])
        return list(zip(*(x.tolist() for x in np.nonzero(np.triu(fit, 1)))))

    def payload(ids: DataFrame) -> DataFrame:
        return some.select("id", "light", F.col("line").alias("data"))

    found = linking.link(some.select("id", F.explode("keys").alias("key")), linking.Items(payload, alike, likely), tables)
    tables.drop(some)
    return found


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """(doc_id, digest, line_no, exact) of each line that goes: all but the first of its class.

    The first is that of the smallest doc_id, then line number, then the text's digest;
    rows without an id come last. Identical lines are one class, and so are lines joined by
    edit distances of at most EDITS or by one other word in at least WORDS. Blank lines
    stay. Null and empty texts have no lines. Rows that repeat an id with different texts
    are told apart by the digest of the text (Spark's xxhash64); rows that repeat an id
    and its text are one row, so they keep and lose the same lines. An empty table gives
    no rows.
    """
    tables = tables or Tables(docs.sparkSession)
    base = _rows(docs, id_col, text_col)
    at = tables.keep(places(base))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "digest")
    found = classes(base, tables)
    firsts = at.groupBy("id").agg(F.min(place).alias("own"), F.max(place).alias("other"))
    firsts = firsts.join(tables.small(found), "id", "left").where("not (own <=> other) or component is not null").select("id", "own", "component")
    firsts = tables.keep(firsts)
    # few lines are alike without being identical: their heads alone meet by component
    heads = tables.keep(firsts.where("component is not null").groupBy("component").agg(F.min("own").alias("head")))
    heads = firsts.join(tables.small(heads), "component", "left").select("id", "own", F.coalesce("head", "own").alias("head"))
    gone = at.join(heads, "id").where(~place.eqNullSafe(F.col("head")))
    return gone.select("doc_id", "digest", "line_no", F.col("own").eqNullSafe(F.col("head")).alias("exact"))


def _verdicts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, n_dropped, n_near, dropped_lines) of the rows that lose lines."""
    # a line of a row that stands twice is one place
    gone = dropped(docs, id_col, text_col).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("line_no", "exact")).alias("g"))
    near = F.size(F.filter("g", lambda x: ~x["exact"])).cast("long")
    return gone.select("doc_id", "digest", F.size("g").cast("long").alias("n_dropped"), near.alias("n_near"), F.sort_array(F.col("g.line_no")).alias("dropped_lines"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_dropped, n_near, dropped_lines) for each row; n_near: alike an earlier line, not identical to the one that stays."""
    own = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("d"))
    gone = _verdicts(docs, id_col, text_col)
    out = own.join(gone, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("d") == F.col("digest")), "left")
    return out.select(F.col("i").alias("doc_id"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped_lines", F.array().cast("array<int>")).alias("dropped_lines"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the lines that go cut out of their text; all rows and columns stay, whatever their names."""
    i, d, g = unused(docs, "gone_id", "gone_digest", "gone_lines")
    gone = _verdicts(docs, id_col, text_col).select(F.col("doc_id").alias(i), F.col("digest").alias(d), F.col("dropped_lines").alias(g))
    out = docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(d)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    rest = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda y: ~F.array_contains(g, y["n"])), lambda y: y["x"]), "\n")
    text = F.when(F.col(g).isNull(), F.col(text_col)).otherwise(rest)
    return out.withColumn(text_col, text).select(*docs.columns)
