"""Evidence that reads leave on disk: one row an occurrence, one shuffle, no files of queries that have ended."""

from __future__ import annotations

import io
import math
import re
import time
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import features, local, model, score
from strandlake.plans import model as steps
from strandlake.plans.base import QUERIES, Base
from strandlake.plans.model import chained
from strandlake.sources import archive
from strandlake.sources.archive import Store, exists

FEATS = [  # tid, genus, species, bin, pos, hash
    (1, "g", "a", 1, 1, 7), (1, "g", "a", 1, 5, 4194304 + 7), (2, "g", "b", 2, 3, 7), (65, "g", "a", 1, 2, 9),
    (3, "h", "a", 3, 4, 9), (3, "h", "a", 3, 4, 9), (4, "h", "c", 4, 1, 11), (4, "h", "c", 4, 2, 5000),
]
READS = [(10, 1, 7), (10, 2, 9), (10, 2, 9), (10, 3, 12), (11, 1, 5000)]


def _tables(spark):
    feats = spark.createDataFrame(FEATS, "tid long, genus string, species string, bin long, pos int, hash long")
    reads = spark.createDataFrame(READS, "read long, pos int, hash long")
    numbers = spark.createDataFrame([("a", "g", 0), ("a", "h", 1), ("b", "g", 65536), ("c", "h", 131072)], "species string, genus string, taxon long")
    return feats, reads, numbers


def _rows(df):
    return sorted((r["read"], r["pos"], r["hash"], r["deg"], r["dfb"], r["bin"], r["strength"], round(r["weight"], 9), tuple(sorted(r["taxa"]))) for r in df.collect())


def test_shared_evidence_equals_the_join(spark):
    feats, reads, numbers = _tables(spark)
    everything = reads.unionAll(feats.select((F.col("tid") + 100).alias("read"), "pos", "hash"))
    df = feats.groupBy("hash").agg(F.count("*").alias("df"))
    for most in (None, 3):  # from 3 occurrences of a class of hashes on, none is kept: 9, and 7 with 4194311, which are one class
        limits = {"enabled": most is not None, "threshold": most, "counters": 16}
        seen = feats.groupBy(F.col("hash").bitwiseAND(F.lit(4194303)).alias("h")).agg(F.count("*").alias("n")).where(F.lit(most is None) | (F.col("n") < (most or 0)))
        idx = feats.join(seen, F.col("hash").bitwiseAND(F.lit(4194303)) == F.col("h"), "left_semi").select("hash", "bin", "tid", "species", "genus").distinct()
        want = _rows(score.contributions(everything, idx, df, numbers, 16, 64, 0.25))
        assert _rows(score.shared(reads, feats, numbers, limits, 64, 0.25, 100)) == want
        assert len(want) == (10 if most is None else 3)


def test_shared_evidence_shuffles_once(spark):
    feats, reads, numbers = _tables(spark)
    out = io.StringIO()
    with redirect_stdout(out):
        score.shared(reads, feats, numbers, {"enabled": True, "threshold": 4, "counters": 16}, 64, 0.25, 100).explain()
    assert out.getvalue().count("Exchange hashpartitioning") == 1


def test_packed_rows_come_back(spark):
    rows = [(1 << 62, 2_147_483_647, (1 << 56) - 1, 65536 * 80 + 3), (5, 1, 0, None), (5, 255, 7, 0), (-3, 256, 1 << 55, None)]
    df = spark.createDataFrame(rows, "read long, pos int, hash long, taxon long")
    back = score.unpacked(score.packed(df))
    assert sorted(back.drop("h22").collect(), key=str) == sorted(df.collect(), key=str)
    assert all(r["h22"] == r["hash"] % 4194304 for r in back.collect())


def test_shared_evidence_shuffles_three_numbers_a_row(spark):
    feats, reads, numbers = _tables(spark)
    out = io.StringIO()
    with redirect_stdout(out):
        score.shared(reads, feats, numbers, {"enabled": True, "threshold": 4, "counters": 16}, 64, 0.25, 100).explain("formatted")
    shuffle = re.search(r"\) Exchange\nInput \[(\d+)\][^\n]*\nArguments: hashpartitioning", out.getvalue())
    assert shuffle and shuffle[1] == "3"


def test_coverage_shuffles_classes_once(spark):
    feats, *_ = _tables(spark)
    seqs = spark.createDataFrame([(s, "A" * 10) for s in "abc"], "species string, seq string")
    for enabled, most in ((False, 0), (True, 3)):
        limits = spark.createDataFrame([(most, enabled)], "threshold long, enabled boolean")
        got = features.tallied(feats, seqs, limits, "species")
        want = features.counters(features.kept(feats, features.frequency(feats), limits), seqs, "species")
        assert sorted(got.collect()) == sorted(want.collect())
    out = io.StringIO()
    with redirect_stdout(out):
        got.select("*").explain()
    assert len(re.findall(r"Exchange hashpartitioning\(h22", out.getvalue())) == 1


def test_scores_do_not_depend_on_the_order_of_occurrences(spark):
    """Two taxa have the same weights in another order: their sums are equal, and the exact ones, so the name decides."""
    rng = np.random.default_rng(0)
    w = (rng.random(3000) * 90 + 0.01).tolist()
    schema, numbers = "read long, pos int, weight double, deg long, strength double, taxa array<long>", spark.createDataFrame([("a", "g", 0), ("b", "g", 65536)], "species string, genus string, taxon long")
    rows = [(1, i, x, 2, 0.0, [65536]) for i, x in enumerate(sorted(w))] + [(1, 5000 + i, x, 2, 0.0, [0]) for i, x in enumerate(w)]
    got = {r["species"]: (r["score"], r["evaluated"]) for r in score.scores(spark.createDataFrame(rows, schema).coalesce(1), numbers).collect()}
    assert got["a"] == got["b"] == (math.fsum(w), math.fsum(w + w))
    assert score.top_two(score.scores(spark.createDataFrame(rows, schema), numbers)).first()["species"] == "a"


def test_a_held_table_leaves_no_shuffle_files(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().mkString(" ").count("shuffle_")
    before = files()
    held = Store(spark, str(tmp_path)).held("t", lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert held.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def test_chains_hold_no_anchors_but_those_of_the_passages(spark):
    b = Base(spark, "/root/testdata/sf0.001")
    q = features.anchors(b.passages)
    assert chained(b).collect() and not exists(spark, f"{b.archive.path}/anchors")
    met = spark.read.parquet(f"{b.spool.path}/met")
    assert met.count() and not met.join(q, "key", "left_anti").count()
    want = local.chains(local.anchor_hits(q, local.rare_keys(features.anchors(b.refs.select("tid", "seq")))))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, chained(b).collect()))


def test_presence_deals_out_no_occurrences(spark):
    """What a read shows of a taxon is in its scores, so no occurrence is shuffled by its read once more."""
    feats, reads, numbers = _tables(spark)
    parts = score.shared(reads, feats, numbers, {"enabled": False, "threshold": 0, "counters": 16}, 64, 0.25, 100).localCheckpoint()
    sums = score.scores(parts, numbers).localCheckpoint()
    got = model.presence(parts, sums, numbers)
    names, want = {r["taxon"]: r["species"] for r in numbers.collect()}, {}
    for r in parts.collect():
        for t in r["taxa"]:
            x = want.setdefault(names[t], [0, 0.0, set(), set()])
            u = r["strength"] if r["deg"] == 1 else 0.0
            x[0], x[1] = x[0] + 1, x[1] + u
            x[2].add(r["read"]), x[3].update([r["read"]] if u > 0 else [])
    assert {r["species"]: (r["hits"], r["uniq"], r["reads"], r["unique_reads"]) for r in got.collect()} == {k: (n, u, len(a), len(b)) for k, (n, u, a, b) in want.items()}
    out = io.StringIO()
    with redirect_stdout(out):
        got.explain("formatted")
    assert "REPARTITION_BY_COL" not in out.getvalue()
    assert all("taxon" not in x or "bitmap" in x or "buf" in x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", out.getvalue()))


def test_posteriors_are_fitted_once_a_session(spark, monkeypatch):
    made, packed = [], model.Packed
    monkeypatch.setattr(model, "Packed", lambda *a, **k: made.append(1) or packed(*a, **k))
    monkeypatch.setattr(steps, "ROUNDS", 2)
    sf = "/root/testdata/sf0.001/"  # a path of its own, and so an archive
    for name in ("x13_release_gain", "k1_read_table", "k4_read_trace", "a24_post_topk", "f12_final_decision"):
        assert QUERIES[name](spark, sf).count()
    assert len(made) == 2  # the assignment's and the sample mixture's


def test_evidence_scores_and_coverage_are_dealt_out_in_stretches(spark, monkeypatch):
    """A third of the rows at a time lies in shuffle files; the tables are the same."""
    whole, third = (Base(spark, f"/root/testdata/{sf}") for sf in ("sf0.001//", "./sf0.001"))  # paths of their own, and so archives
    names = ("parts", "scores", "coverage")

    def rows(b, what):
        df = b.archive.coverage if what == "coverage" else getattr(b, what)
        return sorted(str([sorted(x) if isinstance(x, list) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())

    want = [rows(whole, x) for x in names]
    monkeypatch.setattr(archive, "EACH", 1000)
    assert [rows(third, x) for x in names] == want and all(want)
    for b, n in ((whole, 1), (third, 3)):
        for at in (f"{b.spool.path}/parts", f"{b.spool.path}/scored", f"{b.archive.path}/tallies"):
            assert all(exists(spark, f"{at}/{k}-of-{n}") for k in range(n))
            assert n == 1 or all(spark.read.parquet(f"{at}/{k}-of-{n}").count() for k in range(n))


def test_sequences_are_measured_once(spark):
    b = Base(spark, "/root/testdata/sf0.001")
    want = b.reads.agg(F.count("*").alias("n"), F.floor(F.sum(F.length("seq")) / F.count("*")).alias("average")).first()
    got = steps.read_lengths(b)
    assert got.first() == want
    assert steps.prior(b).count() and not any("documents" in x for x in steps.prior(b).inputFiles() + steps.presence(b).inputFiles())
