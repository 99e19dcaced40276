"""Kernels, sources and operators of the engine itself against small fixtures and brute force."""

import gzip
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.functions import kernels
from strandlake.functions import scalars as S
from strandlake.operators import catalog, local, model, packing, probe, taxonomy
from strandlake.sources import files


def sequence(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def complement(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_kmer_codes_and_folding():
    assert kernels.encode("acgtuNRYK").tolist() == [0, 1, 2, 3, 3, 0, 0, 1, 2]
    with pytest.raises(ValueError):
        kernels.encode("AC-G")
    s = sequence(60)
    fwd, rev = kernels.windows(kernels.encode(s), 7)
    for i in range(54):
        number = lambda x: int("".join(str("ACGT".index(c)) for c in x), 4)
        assert (fwd[i], rev[i]) == (number(s[i : i + 7]), number(complement(s[i : i + 7])))


def test_mixers():
    x = np.array([0, 1, 2**63, 12345], np.uint64)
    assert [int(v) for v in kernels.packed_mix(x)] == [xxhash.xxh64_intdigest(v.tobytes()) for v in x]
    assert len(set(kernels.murmur_mix(x).tolist())) == len(set(kernels.splitmix(x).tolist())) == 4


def test_syncmers_do_not_depend_on_the_strand():
    s = sequence(4000)
    assert kernels.smer_size(28) == 12
    one, at = kernels.syncmers(kernels.encode(s))
    two, back = kernels.syncmers(kernels.encode(complement(s)))
    assert one.tolist() == two[::-1].tolist() and at.tolist() == (4000 - 28 - back[::-1]).tolist()
    assert 4000 / 30 < len(one) < 4000 / 10
    assert len(kernels.strobemers(kernels.encode(s))) == len(one)
    assert len(kernels.strobemers(kernels.encode("ACGT"))) == 0


def test_strobemer_partners_by_brute_force():
    s = kernels.encode(sequence(3000, 4))
    h, at = kernels.syncmers(s, 10)
    got = kernels.strobemers(s, 10, 1, 4)
    main, low, top = kernels.STROBE_MASK, (1 << 26) - 1, (1 << 64) - 256
    for i in range(len(h)):
        best, partner = 99, i
        for j in range(i + 1, min(i + 4, len(h) - 1) + 1):
            if at[j] > at[i] + 14:
                break
            d = bin((int(h[i]) ^ int(h[j])) & 255).count("1")
            if d < best:
                best, partner = d, j
        a, b = int(h[i]), int(h[partner])
        content = min(((a & main) | (b & low)) & top, ((b & main) | (a & low)) & top)
        assert int(got[i]) == xxhash.xxh3_64_intdigest(content.to_bytes(8, "little"), kernels.SEED >> 44)


def test_minimizers_by_brute_force():
    s = kernels.encode(sequence(500, 2))
    fwd, rev = kernels.windows(s, 15)
    rank = kernels.murmur_mix(np.minimum(fwd, rev)).tolist()
    want = []
    for i in range(len(rank) - 9):
        p = min(range(i, i + 10), key=lambda j: (rank[j], j))
        if not want or want[-1] != p:
            want.append(p)
    code, at, strand = kernels.minimizers(s)
    assert at.tolist() == want and (code == np.minimum(fwd, rev)[at]).all() and set(strand.tolist()) == {0, 1}


def test_packing_invariants():
    rng = random.Random(3)
    counts = {f"t{i}": rng.randrange(0, 500) + 3000 * (i % 17 == 0) for i in range(90)}
    bins = packing.pack(counts)
    held = {}
    for b in bins:
        assert len(b) <= 16 and len({t for t, _ in b}) == len(b)
        for t, n in b:
            held[t] = held.get(t, 0) + n
    assert held == counts and packing.pack({}) == []


def test_taxonomy(spark):
    rows = [(1, 1, "root"), (2, 1, "domain"), (10, 2, "family"), (20, 10, "genus"), (21, 10, "genus"), (30, 20, "species"), (31, 20, "species"), (32, 21, "species"), (300, 30, "strain")]
    nodes = spark.createDataFrame(rows, "taxid int, parent int, rank string")
    line = taxonomy.closure(nodes.select("taxid", "parent"))
    species = {r.taxid: r["at"] for r in taxonomy.at_rank(line, nodes, "species", True).collect()}
    genus = {r.taxid: r["at"] for r in taxonomy.at_rank(line, nodes, "genus", False).collect()}
    assert (species[300], species[20], genus[300], genus[20], genus[10]) == (30, 20, 20, 20, 0)
    pairs = spark.createDataFrame([(31, 32), (300, 31), (30, 300)], "a int, b int")
    assert {(r.a, r.b): r.lca for r in taxonomy.lca(pairs, line).collect()} == {(31, 32): 10, (300, 31): 20, (30, 300): 30}


def test_dispersion_and_ranks(spark):
    rows = spark.createDataFrame([(8,), (1,), (1,), (0,)], "x int")
    r = model.community(rows, "x").first()
    assert (round(r.eff, 4), round(r.head, 4), round(r.shannon, 4)) == (1.5152, 0.9, 0.639)
    volume = 0.1 * np.log(1 + np.exp(r.shannon))  # one tenth outside the head
    assert abs(volume - 0.1063) < 1e-4 and abs(r.u - volume / (1 + volume)) < 1e-9 and abs(r.s - 0.000128) < 1e-6
    four = spark.createDataFrame([(10,), (20,), (30,), (40,)], "x int")
    assert model.nearest_rank(four, "x", 0.3).first().v == 10


def test_chains(spark):
    hits = spark.createDataFrame([(1, 7, q, q - 100 + d, 0) for q, d in ((0, 0), (25, 0), (50, 0), (75, 1), (100, 2))], "read int, tid int, qpos int, tpos int, orient int")
    (r,) = local.chains(hits).collect()
    assert (r.diag, r.n, r.score) == (0, 5, 255)


def test_catalog(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 4), ("z", None)], "k string, v int")
    assert {(r.k, r.change) for r in catalog.diff(a, b, "k", ["v"]).collect()} == {("y", "updated"), ("w", "new")}
    assert {(r.k, r.v) for r in catalog.overwritten(a, b, "k", ["v"]).collect()} == {("x", 1), ("y", 3), ("z", None)}


def test_scalars(spark):
    df = spark.createDataFrame([("/a/GCF_000123456.2_x.gz", "d__B;g__;s__", "4294967296"), ("none", "d__B;g__Cc;s__", "42")], "p string, l string, n string")
    got = df.select(S.accession(F.col("p")).alias("a"), S.ftp_path(S.accession(F.col("p"))).alias("f"), S.deepest(F.col("l")).alias("d"), S.parse_u32(F.col("n")).alias("n")).collect()
    assert tuple(got[0]) == ("GCF_000123456.2", "GCF/000/123/456", "d__B", None)
    assert (got[1].a, got[1].d, got[1].n) == (None, "g__Cc", 42)


def test_text_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">s1 first\nACGT\nacg\n>s2\nTT\n")
    assert {tuple(r) for r in files.fasta(spark, str(tmp_path / "a.fa.gz")).collect()} == {("s1", "ACGTACG"), ("s2", "TT")}
    (tmp_path / "r1.fq").write_text("@r1 x\nAC\n+\nII\n@r2\nGG\n+\nII\n@r3\nT\n+\nI\n")
    (tmp_path / "r2.fq").write_text("@r1\nTT\n+\nII\n@r2\nCC\n+\nII\n")
    mates = files.paired(files.fastq(spark, str(tmp_path / "r1.fq")), files.fastq(spark, str(tmp_path / "r2.fq")))
    assert {tuple(r) for r in mates.collect()} == {(0, "r1", "AC", "TT"), (1, "r2", "GG", "CC")}
    (tmp_path / "target.tsv").write_text("a.fa 9\n\nonly\nb.fa\t10 more\n")
    assert {tuple(r) for r in files.manifest(spark, str(tmp_path / "target.tsv")).collect()} == {("a.fa", "9"), ("b.fa", "10")}
    (tmp_path / "meta").write_text("# c\n\n kind = ncbi\nversion=a=b\n")
    assert {tuple(r) for r in files.key_values(spark.read.text(str(tmp_path / "meta"))).collect()} == {("kind", "ncbi"), ("version", "a=b")}
    (tmp_path / "ev.tsv").write_text("Taxid\tCount\n#x\t1\n7\t2.5\n8\t0\n9\tno\n")
    assert [tuple(r) for r in files.evidence(spark.read.text(str(tmp_path / "ev.tsv"))).collect()] == [("7", 2.5)]


def test_sampling_keeps_short_reads_whole(spark):
    reads = spark.createDataFrame([(1, p, 100 + p) for p in range(10)] + [(2, p, 500 + p) for p in range(400)], "read int, pos int, hash long")
    df = spark.createDataFrame([(500 + p, p % 7 + 1) for p in range(400)], "hash long, df long")
    got = probe.sample(reads, df)
    n = {r.read: r.n for r in got.groupBy("read").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 10, 2: 96}


def test_stream_ingest(spark, tmp_path):
    from strandlake.streaming.ingest import ingest

    for i in range(3):
        spark.createDataFrame([(i, "ACGT")], "id int, seq string").write.parquet(f"{tmp_path}/in/{i}")
    spark.read.parquet(f"{tmp_path}/in/*").coalesce(1).write.parquet(f"{tmp_path}/reads")
    schema = spark.read.parquet(f"{tmp_path}/reads").schema
    q = ingest(spark, f"{tmp_path}/reads", schema, lambda d: d.withColumn("n", F.length("seq")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2]


def test_entry(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert e.entry(spark).columns
