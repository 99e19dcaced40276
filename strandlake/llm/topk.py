"""Exact top-k inner products over a bit-sliced index.

Each attribute (vector component, quantised to an integer) of a block of rows is kept
as bit slices: bitmap j holds bit j of that attribute of every row of the block. A
query's scores are summed for all rows at once: the slices of attribute d enter with
weight 2^(i+j) for every bit i of the query's component, complemented if it is
negative, and a carry-save tree of full adders turns the pile of bitmaps into score
slices. The top rows are then chosen from the most significant slice downward; ties at
the boundary are resolved by the smaller id, in which order a block's rows lie.

Every row lies in one block and every query is sent to each block, where the block's rows
come first, are made an index, and the queries stream past it: nothing but one block is
held. A block gives at most k rows a query; a second step keeps the best k of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

ROWS = 16_384  # of a block, about; a multiple of 64 words keeps adders in the CPU's cache
MOST = (1 << 63) - 1


class Slices:
    """The bit-sliced index of one block: `matrix` is rows x attributes, integers."""

    def __init__(self, matrix: np.ndarray):
        self.n, self.dims = matrix.shape
        self.low = int(matrix.min()) if matrix.size else 0
        spread = int(matrix.max()) - self.low if matrix.size else 0
        self.bits = max(1, spread.bit_length())
        words = -(-self.n // 64)
        shifted = (matrix.astype(np.uint64) - np.uint64(self.low % (1 << 64))).T  # attributes x rows; wraps to the true difference
        self.planes = np.zeros((self.dims, self.bits, words), np.uint64)
        for j in range(self.bits):
            bits = np.zeros((self.dims, words * 64), np.uint8)
            bits[:, : self.n] = (shifted >> np.uint64(j)) & np.uint64(1)
            self.planes[:, j] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.live = np.zeros(words * 64, np.uint8)
        self.live[: self.n] = 1
        self.live = np.packbits(self.live, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of each row's score plus a constant, and that constant."""
        piles: dict[int, list[np.ndarray]] = {}
        full = (1 << self.bits) - 1
        constant = 0
        size = np.where(query < 0, -query, query).astype(np.uint64)  # the lowest long is its own negative, which is right as unsigned
        for negative in (False, True):
            for i in range(int(size.max()).bit_length() if query.size else 0):
                at = np.flatnonzero(((size >> np.uint64(i)) & np.uint64(1)).astype(bool) & ((query < 0) == negative))
                if at.size:
                    for j in range(self.bits):
                        plane = self.planes[at, j]
                        piles.setdefault(i + j, []).append(~plane if negative else plane)
        constant += full * sum(size[query < 0].tolist()) - self.low * sum(query.tolist())
        out: list[np.ndarray] = []
        weight = 0
        while weight <= max(piles, default=-1):
            pile = np.concatenate(piles[weight]) if weight in piles else np.zeros((0, len(self.live)), np.uint64)
            while len(pile) > 1:
                third = len(pile) // 3
                if third:
                    a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                    both = a ^ b
                    piles.setdefault(weight + 1, []).append((a & b) | (both & c))
                    pile = np.concatenate([both ^ c, pile[3 * third :]])
                else:
                    piles.setdefault(weight + 1, []).append((pile[0] & pile[1])[None])
                    pile = (pile[0] ^ pile[1])[None]
            out.append(pile[0] if len(pile) else np.zeros(len(self.live), np.uint64))
            weight += 1
        return out, constant

    def rows_of(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows, ties to the lower row, in row order."""
        slices, constant = self.scores(query)
        sure, maybe = np.zeros_like(self.live), self.live
        for s in reversed(slices):
            both = sure | (maybe & s)
            count = int(np.bitwise_count(both).sum())
            if count > k:
                maybe = maybe & s
            else:
                sure, maybe = both, maybe & ~s
        chosen = self.rows_of(sure)
        rows = np.concatenate([chosen, self.rows_of(maybe)[: k - len(chosen)]])
        narrow = max(len(slices), constant.bit_length()) < 62
        value = np.zeros(len(rows), np.int64 if narrow else object)  # plain integers where a long might not do
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        for w, s in enumerate(slices):
            value += ((s[word] >> bit) & np.uint64(1)).astype(value.dtype) << w
        value = value - constant
        return rows, value if narrow else np.array([min(MOST, max(-MOST - 1, int(v))) for v in value], np.int64)


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<int>): rows with an id and a vector of finite numbers only, each component floored after scaling."""
    v = F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def search(df: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose id `every` divides.

    Null vectors, vectors with null or non-finite components and rows without an id take
    no part; shorter vectors count as filled up with zeros; of rows that repeat an id, all
    are candidates of other queries and none of its own; repeated query rows give their
    ranks once. Equal scores go to the smaller vec_id. Scaled components and scores beyond
    a long are taken as its ends. An empty table gives no rows.
    """
    spark = df.sparkSession
    base = usable(df, id_col, vec_col, scale)
    n, dims = base.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = max(1, dims or 0)
    n_blocks = max(1, -(-n // rows), min(2 * spark.sparkContext.defaultParallelism, n // 2048))
    held = base.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).alias("block"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = base.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("block"), F.lit(1).alias("asks"), "vec_id", "v")
    met = held.unionAll(asked).repartition(2 * n_blocks, "block").sortWithinPartitions("block", "asks", "vec_id")

    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, v = batch["vec_id"].to_numpy(), batch["v"]
        sizes = v.value_lengths().to_numpy()
        out = np.zeros((len(ids), dims), np.int64)
        out[np.arange(dims) < sizes[:, None]] = v.flatten().to_numpy()
        return ids, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, index, ids = None, [], None, None
        for batch in batches:
            own = 2 * batch["block"].to_numpy() + batch["asks"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            found = []
            for at, end in zip(edges, edges[1:]):
                if at == end:
                    continue
                if own[at] // 2 != block:
                    block, parts, index = own[at] // 2, [], None
                part = matrix(batch.slice(at, end - at))
                if own[at] % 2 == 0:
                    parts.append(part)
                    continue
                if index is None and not parts:  # no row has this block
                    continue
                if index is None:
                    ids, index = np.concatenate([p[0] for p in parts]), Slices(np.concatenate([p[1] for p in parts]))
                    parts = []
                for qid, vec in zip(*part):
                    # the query's own rows are at most a few more
                    here, score = index.top(vec, k + int((ids == qid).sum()))
                    keep = ids[here] != qid
                    here, score = here[keep], score[keep]
                    best = np.lexsort((ids[here], -score))[:k]
                    found.append((np.full(len(best), qid), ids[here][best], score[best]))
            cols = [np.concatenate(x) for x in zip(*found)] if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["query_id", "vec_id", "score"])

    out = met.mapInArrow(run, "query_id long, vec_id long, score long")
    # each task keeps its k best rows of a query before they are sent on
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
