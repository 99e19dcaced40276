"""Groups of alike items from posting lists, without emitting all pairs of a list.

Items that share a key are candidates. Lists of at most `SMALL` items give all their
pairs; a longer list gives a star around its smallest item. The pairs are verified and
contracted to components. In a long list whose items are not yet one component, those
outside its largest component meet `HUBS` items of that. What is still apart is cut into blocks, and
each pair of blocks is one bounded unit of work: by light descriptions it finds the items
that may be alike one of another component, then verifies such pairs only, joining
components as it goes, and returns the links that joined something. So no link between
components is lost, and no unit holds a whole list.

An id may stand for several payloads; it is linked if one of them is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, map_arrow, narrow

SMALL = 24
BLOCK = 256
HUBS = 4
EDGES = 100_000  # of one task that joins them


def top(root: dict[int, int], x: int) -> int:
    """The root of x, halving its path."""
    while (y := root.setdefault(x, x)) != x:
        root[x] = root[y] = root.setdefault(y, y)
        x = root[x]
    return x


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a task as stars around the smallest id of each of its components."""
    root: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            u, v = top(root, u), top(root, v)
            if u != v:
                root[max(u, v)] = min(u, v)
    out = [(x, r) for x in root if (r := top(root, x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["u", "v"])


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(id, component) of every item of `links` (a, b): the smallest id that can be reached, in a written table.

    Each task joins the edges it holds, `EDGES` or so; if one task held them all, that is
    all. Otherwise a large-star and a small-star step follow, which bring edges of one
    item together, and so on until nothing changes. Links of an item with itself are ignored.
    """
    tables = tables or Tables(links.sparkSession)
    edges = tables.keep(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")))
    state = None
    while (n := tables.rows(edges)) > EDGES:
        joined = tables.keep(map_arrow(narrow(edges, n, EDGES), _forest, "u long, v long"))
        both = joined.unionAll(joined.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = tables.keep(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        tables.drop(edges, joined)
        edges = stars
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        stars = tables.keep(map_arrow(edges.coalesce(1), _forest, "u long, v long"))  # of at most EDGES
        tables.drop(edges)
        edges = stars
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    if tables.rows(edges) <= EDGES:
        roots = roots.coalesce(1)
    out = tables.keep(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots))
    tables.drop(edges)
    return out


@dataclass
class Items:
    """What is known of items: payload(ids) gives (id, light, data), one or more rows an id.

    check(data, data): whether two are linked. likely(key, lights, labels): the pairs of
    places that may be linked and differ in label, the likeliest first. sieve(pairs) drops
    pairs (a, b) that can't pass, cheaply.
    """

    payload: Callable[[DataFrame], DataFrame]
    check: Callable
    likely: Callable
    sieve: Callable[[DataFrame], DataFrame] = lambda pairs: pairs


def lists(postings: DataFrame, tables: Tables) -> DataFrame:
    """(key, id, n, hub) of the postings whose key has n > 1 of them, hub the smallest id."""
    found = tables.keep(postings.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").drop("last"))
    out = tables.keep(postings.join(tables.small(found), "key").select("key", "id", "n", "hub"))
    tables.drop(found)
    return out


def first_pairs(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of short lists and the stars of long ones."""
    short = rows.where(f"n <= {SMALL}").groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    rest = "filter(ids, x -> x > a)"
    pairs = short.select("ids", F.explode("ids").alias("a")).select("a", F.explode(F.expr(rest)).alias("b"))
    stars = rows.where(f"n > {SMALL} and id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    return pairs.unionAll(stars).distinct()


def verified(pairs: DataFrame, payload: DataFrame, check: Callable) -> DataFrame:
    """The pairs (a, b) of which payloads pass check(data_a, data_b)."""
    left = payload.select(F.col("id").alias("a"), F.col("data").alias("x"))
    right = payload.select(F.col("id").alias("b"), F.col("data").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [check(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def labelled(long: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    return long.join(tables.small(labels), "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))


def as_links(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("id").alias("a"), F.col("component").alias("b"))


def mixed(rows: DataFrame, tables: Tables) -> DataFrame:
    """The rows (key, id, label) of lists with more than one label; `most`: the label with most rows, `hubs`: some items of it."""
    hubs = F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64("id", F.lit(t)).alias("h"), "id"))["id"] for t in range(HUBS))))
    own = rows.groupBy("key", "label").agg(F.count("*").alias("m"), hubs.alias("hubs"))
    some = own.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("m", F.col("label").alias("most"), "hubs")).alias("x")).where("labels > 1")
    some = tables.keep(some.select("key", "x.most", "x.hubs"))
    out = tables.keep(rows.join(tables.small(some), "key").select("key", "id", "label", "most", "hubs"))
    tables.drop(some)
    return out


def stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of the rows outside their list's largest component with hubs of it."""
    apart = rows.where("label <> most").select("id", "hubs").distinct().select("id", F.explode("hubs").alias("hub"))
    return apart.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def _units(rows: DataFrame, column: str, work: Callable, schema: str) -> DataFrame:
    """work(key, ids, labels, column) of each unit (key, i, j) of two blocks, whose rows meet in one task in order."""
    met = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def told(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], names)

        for batch in batches:
            found = []
            for key, i, j, *own in zip(*(batch[c].to_pylist() for c in ("key", "i", "j", "id", "label", column))):
                if (key, i, j) != unit:
                    if len(held) > 1:
                        found += work(unit, *zip(*held))
                    unit, held = (key, i, j), []
                held.append(own)
            yield told(found)
        if len(held) > 1:
            yield told(work(unit, *zip(*held)))

    names = [x.split()[0] for x in schema.split(", ")]
    return map_arrow(met.select("key", "i", "j", "id", "label", column), run, schema)


def block_links(rows: DataFrame, held: DataFrame, items: Items, tables: Tables) -> DataFrame:
    """Verified links (a, b) between different labels within the lists of `rows` (key, id, label)."""
    # a label with many rows of a list gets blocks of its own, all others share blocks, whole labels together
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("m"))
    shared = sizes.where(f"m <= {BLOCK}").groupBy("key").agg(F.sum("m").alias("rest"))
    sizes = sizes.join(shared, "key", "left").withColumn("pure", F.when(F.col("m") > BLOCK, F.col("label")))
    sizes = tables.keep(sizes.withColumn("nb", F.ceil(F.coalesce(F.when(F.col("pure").isNotNull(), F.col("m")), "rest") / BLOCK).cast("int")).select("key", "label", "pure", "nb"))
    own = F.pmod(F.xxhash64(F.when(F.col("pure").isNull(), F.col("label")).otherwise(F.col("id"))), F.col("nb")).cast("int")
    placed = tables.keep(rows.join(tables.small(sizes), ["key", "label"]).select("key", "id", "label", F.xxhash64(F.coalesce("pure", F.lit(-1)), own).alias("block")))
    blocks = tables.keep(placed.groupBy("key", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    one, two = (tables.small(blocks).select("key", *(F.col(c).alias(f"{c}{k}") for c in ("block", "lo", "hi"))) for k in "12")
    # pairs of blocks; what has one label has nothing to verify
    units = blocks.select("key", *(F.col(c).alias(f"{c}1") for c in ("block", "lo", "hi"))).join(two, "key")
    units = tables.keep(units.where("block1 <= block2 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)").select("key", F.col("block1").alias("i"), F.col("block2").alias("j")))
    sides = units.select("key", F.col("i").alias("block"), "i", "j").unionAll(units.where("i <> j").select("key", "j", "i", "j"))
    if 2 * tables.rows(units) <= tables.rows(placed):
        sides = tables.small(tables.keep(sides))
    placed = placed.join(sides, ["key", "block"]).join(held.select("id", "light"), "id").select("key", "i", "j", "id", "label", "light")

    likely, check = items.likely, items.check

    def some(unit: tuple, ids: tuple, labels: tuple, lights: tuple) -> list[tuple]:
        places = {k for pair in likely(unit[0], lights, np.array(labels)) for k in pair}
        return [(*unit, *x) for x in sorted({(ids[k], labels[k]) for k in places})]

    def links(unit: tuple, ids: tuple, labels: tuple, both: tuple) -> list[tuple]:
        root: dict[int, int] = {}
        out = []
        for p, q in likely(unit[0], tuple(b["light"] for b in both), np.array(labels)):
            x, y = top(root, labels[p]), top(root, labels[q])
            if x != y and check(both[p]["data"], both[q]["data"]):
                root[max(x, y)] = min(x, y)
                out.append((ids[p], ids[q]))
        return out

    maybe = tables.keep(_units(placed, "light", some, "key long, i long, j long, id long, label long"))
    if not tables.rows(maybe):
        return tables.keep(maybe.select(F.col("i").alias("a"), F.col("j").alias("b")))
    full = maybe.join(held.select("id", F.struct("light", "data").alias("both")), "id")
    out = tables.keep(_units(full, "both", links, "a long, b long"))
    tables.drop(sizes, placed, blocks, units, maybe)
    return out


def link(postings: DataFrame, items: Items, tables: Tables, also: DataFrame | None = None) -> DataFrame:
    """(id, component) of the linked items of `postings` (key, id), in a written table; `also`: links (a, b) that are known."""
    rows = lists(postings, tables)
    pairs = tables.keep(items.sieve(first_pairs(rows)))
    long = tables.keep(rows.where(f"n > {SMALL}").select("key", "id"))
    tables.drop(rows)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(long.select("id")).distinct()
    held = tables.keep(items.payload(ids))
    links = verified(pairs, held, items.check)
    labels = components(links if also is None else links.unionAll(also), tables)
    tables.drop(pairs)
    if tables.rows(long):
        # a few more pairs an item join most of what is left; blocks verify the rest
        apart = mixed(labelled(long, labels, tables), tables)
        more = tables.keep(verified(items.sieve(stars(apart)), held, items.check))
        if tables.rows(more):
            labels = _joined(labels, more, tables)
            again = mixed(labelled(apart, labels, tables), tables)
            tables.drop(apart)
            apart = again
        if tables.rows(apart):
            more = block_links(apart.select("key", "id", "label"), held, items, tables)
            if tables.rows(more):
                labels = _joined(labels, more, tables)
        tables.drop(apart)
    tables.drop(long, held)
    return labels


def _joined(labels: DataFrame, more: DataFrame, tables: Tables) -> DataFrame:
    out = components(as_links(labels).unionAll(more), tables)
    tables.drop(labels, more)
    return out
