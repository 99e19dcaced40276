"""The index, the models and the command line against brute force and hand-made fixtures."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import engine
from strandlake.__main__ import main
from strandlake.functions import kernels
from strandlake.operators import features, local, model, probe, profile, score, taxonomy
from strandlake.sources import files, gtdb
from strandlake.sources.archive import Archive

from .test_operators import complement, sequence


def candidates(spark, seed=1, reads=40, taxa=9):
    rng = random.Random(seed)
    rows = []
    for r in range(reads):
        e = 5 + 20 * rng.random()
        for t in rng.sample(range(taxa), rng.randrange(1, 5)):
            rows.append((r, f"s{t}", 0.1 + e * rng.random(), e))
    return rows, spark.createDataFrame(rows, "read long, species string, score double, evaluated double")


def test_kernels_by_stretches(monkeypatch):
    s = kernels.encode(sequence(3000, 5))
    whole = [kernels.syncmers(s), kernels.minimizers(s), kernels.contents(s, 12, 1, 4)]
    for size in (1, 7, 100, 999):
        monkeypatch.setattr(kernels, "CHUNK", size)
        for a, b in zip(whole, [kernels.syncmers(s), kernels.minimizers(s), kernels.contents(s, 12, 1, 4)]):
            assert all(x.tolist() == y.tolist() for x, y in zip(a, b))


@pytest.mark.parametrize("k,s", [(28, 12), (31, 15), (21, 5), (16, 14), (10, 8), (22, 6), (19, 5), (6, 4)])
def test_smer_size(k, s):
    assert kernels.smer_size(k) == s and (k - s) % 2 == 0


def test_feature_rows(spark):
    seqs = [(1, sequence(500, 1)), (2, sequence(66, 2)), (3, None), (4, ""), (5, sequence(67, 3)), (5, sequence(300, 4))]
    df = spark.createDataFrame([(i, s, 7) for i, s in seqs], "tid long, seq string, hash2 int")
    got = sorted((r.tid, r.pos, r.hash) for r in features.features(df).collect())
    want = []
    for i, s in seqs:
        if s and len(s) >= 67:
            content, at = kernels.contents(kernels.encode(s))
            want += [(i, int(p) + 1, int(c) >> 8) for c, p in zip(content, at)]
    assert got == sorted(want)
    assert features.features(df.limit(0)).count() == 0 and features.anchors(df.where("tid > 1 and tid < 5")).where("tid <> 2").count() == 0
    kmers = features.kmers(df.select("tid", "seq"), 12).where("tid = 1").orderBy("pos").collect()
    assert [r.kmer for r in kmers] == [seqs[0][1][i : i + 12] for i in range(489)]


@pytest.mark.parametrize("with_prior", [False, True])
def test_fit_by_brute_force(spark, with_prior):
    rows, df = candidates(spark)
    scale = {"s0": 4.0, "s1": 0.25, "s2": 0.0}
    by = {}
    for r, t, x, e in rows:
        by.setdefault(r, []).append((t, x, e))
    taxa = sorted({t for _, t, _, _ in rows})
    start = dict.fromkeys(taxa, 0.0)
    loglik = {}
    for r, own in by.items():
        c = [x / e for _, x, e in own]
        for (t, x, _), v in zip(own, c):
            start[t] += x / sum(y for _, y, _ in own)
            loglik[r, t] = 1.05 * math.log(max((v + 1e-9) / (max(c) + len(c) * 1e-9), 1e-9))
    pi = {t: v * math.sqrt(scale.get(t) or 1.0) if with_prior else v for t, v in start.items()}
    pi = {t: v / sum(pi.values()) for t, v in pi.items()}
    for _ in range(100):
        before, mass = pi, dict.fromkeys(taxa, 0.0)
        for r, own in by.items():
            w = [math.log(max(pi[t], 1e-9)) + loglik[r, t] for t, _, _ in own]
            x = [math.exp(v - max(w)) for v in w]
            q = [v / sum(x) for v in x]
            for (t, _, e), v in zip(own, q):
                mass[t] += e * max(q) ** 1.25 * v
        pi = {t: ((0 if m < 2e-4 * max(mass.values()) else m) + 1e-6) / (len(taxa) * 1e-6 + sum(mass.values())) for t, m in mass.items()}
    prior = spark.createDataFrame(list(scale.items()), "species string, scale double") if with_prior else None
    post, weights = model.fit(df, 100, 1.25, prior)
    assert {r.species: pytest.approx(r.pi, abs=1e-9) for r in weights.collect()} == pi
    for r in post.collect():
        w = {t: max(before[t], 1e-9) * math.exp(loglik[r.read, t]) for t, _, _ in by[r.read]}
        assert r.q == pytest.approx(w[r.species] / sum(w.values()), abs=1e-9)
    assert model.fit(df.limit(0), 5)[0].count() == 0


def test_mixture_by_brute_force(spark):
    rows, df = candidates(spark, 2)
    taxa = sorted({t for _, t, _, _ in rows})
    by = {}
    for r, t, x, _ in rows:
        by.setdefault(r, []).append((t, x))
    pi = dict.fromkeys(taxa, 1 / len(taxa))
    for _ in range(10):
        q = dict.fromkeys(taxa, 0.5)
        for own in by.values():
            total = sum(pi[t] * x for t, x in own)
            for t, x in own:
                q[t] += pi[t] * x / total
        pi = {t: v / (len(by) + 0.5 * len(taxa)) for t, v in q.items()}
    post, weights = model.mixture(df)
    assert {r.species: pytest.approx(r.pi, abs=1e-9) for r in weights.collect()} == pi
    assert all(v == pytest.approx(1) for v in [r["s"] for r in post.groupBy("read").agg(F.sum("q").alias("s")).collect()])


def test_rounds_over_several_tasks(spark, monkeypatch):
    """Sums met by a shuffle are those added up on the driver."""
    _, df = candidates(spark, 3)
    one = {r.species: r.pi for r in model.fit(df, 7)[1].collect()}
    monkeypatch.setattr(model, "SUMS", 0)
    assert {r.species: pytest.approx(r.pi, abs=1e-12) for r in model.fit(df, 7)[1].collect()} == one


def test_presence_levels(spark):
    """A taxon with much unique evidence is accepted, one whose exposure should have shown more is rejected."""
    cols = "species string, hits long, uniq double, reads long, unique_reads long, unique_obs long, breadth_obs long, bp long, total long, unique long, unique_density double, expected double, exposure double"
    rows = [("many", 900, 800.0, 300, 300, 700, 700, 1000, 900, 800, 0.8, 2.0, 400.0), ("none", 30, 0.0, 30, 0, 0, 0, 1000, 900, 800, 0.8, 2.0, 4000.0), ("some", 5, 1.0, 5, 1, 1, 1, 10, 9, 8, 0.8, 0.1, 0.0), ("big", 100, 50.0, 90, 40, 40, 30, 1000, 900, 800, 0.8, 2.0, 500.0)]
    got = {r.species: r for r in model.presence_posterior(spark.createDataFrame(rows, cols)).collect()}
    lam = 700 / 400 - 1e-4  # capped by 700 distinct signatures
    want = 700 * math.log((lam + 1e-4) / 1e-4) - lam * 400 + math.log(1e-3) - math.log(0.999)
    assert got["many"].logodds == pytest.approx(want) and got["many"].level == "accept" and got["many"].local_factor == 1
    assert got["none"].level == "reject"  # no unique evidence, so its factor is 0: only the prior is left
    assert got["none"].local_factor == 0 and got["none"].logodds == pytest.approx(math.log(1e-3) - math.log(0.999))


def test_prune_and_decide(spark):
    post = spark.createDataFrame([(1, "a", 0.7, 10.0), (1, "b", 0.3, 10.0), (2, "c", 1.0, 4.0), (3, "r", 0.6, 10.0), (3, "a", 0.4, 10.0), (4, "a", 0.5, 10.0), (4, "d", 0.3, 10.0), (4, "r", 0.2, 10.0)], "read long, species string, q double, evaluated double")
    pi = spark.createDataFrame([("a", 0.9), ("b", 5e-5), ("c", 2e-4), ("r", 6e-4), ("d", 2e-6)], "species string, pi double")
    levels = spark.createDataFrame([("r", "reject"), ("d", "accept")], "species string, level string")
    pruned = model.pruned(post, pi, levels)
    got = {(r.read, r.species): round(r.q, 6) for r in pruned.collect()}
    # b falls below 1e-4; the rejected r stays above twice that; the accepted d needs 1e-6 only
    assert got == {(1, "a"): 1.0, (2, "c"): 1.0, (3, "r"): 0.6, (3, "a"): 0.4, (4, "a"): 0.5, (4, "d"): 0.3, (4, "r"): 0.2}
    out = {(r.read, r.species): (r["count"], r.reason) for r in model.decided(pruned).collect()}
    # c has too little weight, the rejected r needs twice as much; in read 4 the rejected r gets nothing
    assert out == {(1, "a"): (10.0, None), (2, "unclassified"): (1.0, "posterior_weight"), (3, "unclassified"): (1.0, "posterior_weight"), (4, "a"): (6.0, None), (4, "d"): (4.0, None)}


def test_readout(spark):
    decisions = spark.createDataFrame([(1, "unclassified", 1.0, "posterior_weight"), (2, "unclassified", 1.0, "posterior_weight"), (3, "a1", 9.0, None), (4, "a1", 9.0, None)], "read long, species string, count double, reason string")
    mix = spark.createDataFrame([(1, "a1", 1.0, 0.95), (1, "b1", 1.0, 0.05), (2, "a1", 50.0, 0.6), (2, "b1", 1.0, 0.4), (3, "a1", 2.0, 0.1), (3, "a2", 2.0, 0.9), (4, "a1", 9.0, 0.4), (4, "a2", 2.0, 0.6)], "read long, species string, score double, q double")
    taxa = spark.createDataFrame([("a1", "a"), ("a2", "a"), ("b1", "b")], "species string, genus string")
    got = {r.read: (r.species, round(r["count"], 6), r.mode, r.reason) for r in model.readout(decisions, mix, taxa).collect()}
    # log odds 2.9 outweigh 0.35; 0.4 doesn't outweigh 1.97; a gain of ln 9 is more than ln 2 / 2; ln 1.5 is less than ln 4.5
    assert got == {1: ("a1", 0.95, "released", None), 2: ("unclassified", 1.0, "kept", "posterior_weight"), 3: ("a2", 0.9, "switched", None), 4: ("a1", 9.0, "kept", None)}


def test_reportable_floor_is_in_per_cent(spark):
    rows = spark.createDataFrame([("a", 9991.0, 50, 2, 10.0), ("b", 6.0, 50, 2, 10.0), ("c", 3.0, 50, 1, 10.0), ("d", 500.0, 2, 5, 10.0), ("e", 800.0, 50, 1, 10.0), ("f", 1.0, 9, 1, 0.0)], "t string, v double, n long, sources long, callable double")
    got = {r.t: (r.reportability, r.kept) for r in profile.reportable(rows, "v", "n", "sources", "callable", F.lit(100)).collect()}
    # one taxon holds nearly all, so the floor is 0.05 per cent: 6 of 11,301 is above, 3 below
    assert got == {
        "a": ("classifier_response_reportable", True), "b": ("classifier_response_reportable", True), "c": ("nuisance_below_dynamic_detection_floor", False),
        "d": ("nuisance_low_runtime_support", False), "e": ("single_source_limited_reportable", True), "f": ("nuisance_no_callable_exposure", False),
    }


def test_retention_floor(spark):
    rows = spark.createDataFrame([(1, f"s{i:03d}", "g", 200.0 - i, 1.0, 900.0, 50) for i in range(200)], "read long, species string, genus string, score double, uniq double, evaluated double, n long")
    thr = spark.createDataFrame([(1, 1000.0)], "read long, thr double")
    assert score.retained(rows, thr, 0.25).count() == 96 and score.retained(rows, thr, 0.25, 16).count() == 12


def test_target_retention_takes_sources_by_rank(spark):
    rows = [(i, "s", f"x{i % 3}", 100 - i, 10) for i in range(9)] + [(100, "s", "y", 1000, 10)]
    df = spark.createDataFrame(rows, "target long, species string, source string, anchors long, length long")
    got = [(r.target, r.place) for r in local.kept_targets(df, 2, 3).orderBy("place").collect()]
    assert got == [(100, 1), (0, 2), (1, 3), (3, 4), (4, 5)]  # y first, then x0 and x1, two of each


def test_adaptive_surface(spark):
    coarse = [(1, f"a{i}", "a", 50 - i) for i in range(8)] + [(1, f"b{i}", "b", 5 - i) for i in range(3)] + [(1, "c0", "c", 4)] + [(2, f"{g}0", g, 10) for g in "abcdefgh"]
    df = spark.createDataFrame(coarse, "read long, species string, genus string, evidence long")
    rare = spark.createDataFrame([(1, "a7", 9), (1, "b2", 1)], "read long, species string, support long")
    genus = spark.createDataFrame([(1, "c", 3)], "read long, genus string, support long")
    lengths = spark.createDataFrame([(1, 5000), (2, 5000)], "read long, n long")
    assert probe.adaptive_surface(df, rare, genus, lengths, 0.25).count() == 0  # long reads need a higher dispersion
    got = [r.species for r in probe.adaptive_surface(df, rare, genus, lengths, 0.4).orderBy("place").collect()]
    assert got == ["a0", "a7", "a1", "c0", "b2", "a2"]  # the strongest, two of its genus, the best of two others, then by evidence
    short = probe.adaptive_surface(df, rare, genus, lengths.withColumn("n", F.lit(500).cast("long")), 0.25).orderBy("place").collect()
    assert [r.species for r in short[:7]] == ["a0", "a7", "a1", "a2", "a3", "c0", "b2"] and len(short) == 12


def test_rescue(spark):
    rows = [(1, "a", "g", 10.0, 0.0, 20.0, 9), (1, "b", "h", 9.5, 0.0, 20.0, 9), (1, "c", "g", 4.0, 0.0, 20.0, 9), (1, "d", "h", 2.0, 0.0, 20.0, 9)]
    df = spark.createDataFrame(rows, "read long, species string, genus string, score double, uniq double, evaluated double, n long")
    thr, kept = spark.createDataFrame([(1, 7.0)], "read long, thr double"), spark.createDataFrame([(1, "a")], "read long, species string")
    # d is below the floor of 3.5; c comes first, of the best one's genus
    assert [(r.species, r.place) for r in score.rescued(df, thr, kept).orderBy("place").collect()] == [("c", 1), ("b", 2)]


def test_within_budget(spark):
    rows = spark.createDataFrame([("g", i, 10 + i, n) for i, n in enumerate([30, 60, 20, 10])] + [("h", 0, 99, 101)], "genus string, t int, target long, length long")
    got = {(r.genus, r.target) for r in local.within_budget(rows, "genus", "t", "length", 60, rows.schema).collect()}
    assert got == {("g", 10), ("g", 12), ("g", 13)}  # what doesn't fit is passed over


def test_abundance_and_sequence_profile(spark):
    df = spark.createDataFrame([(1, "a", 10.0, 10.0), (1, "b", 9.6, 10.0), (1, "c", 2.0, 10.0), (2, "a", 4.0, 6.0)], "read long, species string, score double, evaluated double")
    got = {r.species: (round(r.assigned, 6), r.unique, round(r.features, 6)) for r in model.sequence_profile(df).collect()}
    assert got == {"a": (round(1 + 10 / 19.6, 6), 1.0, round(6 + 100 / 19.6, 6)), "b": (round(9.6 / 19.6, 6), 0.0, round(96 / 19.6, 6))}
    one = {r.species: r.mass for r in model.abundance_fit(df, 1).collect()}
    assert one == pytest.approx({"a": 6 + 100 / 21.6, "b": 96 / 21.6, "c": 20 / 21.6})


def test_closure_of_a_long_chain(spark):
    n = 70
    nodes = spark.createDataFrame([(1, 1)] + [(i, i - 1) for i in range(2, n + 1)], "taxid int, parent int")
    assert taxonomy.closure(nodes).where(f"taxid = {n}").count() == n
    with pytest.raises(ValueError):
        taxonomy.closure(spark.createDataFrame([(1, 2), (2, 1)], "taxid int, parent int"))


def test_fasta_and_fastq_records(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 with > inside\r\nACGT\r\nac gu\r\n>s2\n>s3 x\nTT")
    assert {tuple(r) for r in files.fasta(spark, str(tmp_path / "a.fa")).collect()} == {("s1", "ACGTACGU"), ("s2", ""), ("s3", "TT")}
    rng = random.Random(1)
    want = []
    with open(tmp_path / "r.fq", "w") as f:
        for i in range(700):
            s = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60)))
            f.write(f"@r{i} {i}\n{s}\n+\n{'@' * len(s)}\n")
            want.append((f"r{i}", s, i))
        f.write("@cut\nAC\n")
    with gzip.open(tmp_path / "z.fq.gz", "wt") as f:
        f.write("@z\nacg\n+\nIII\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("997", "131", "20", "1m"):  # splits far smaller than a record, too
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.fastq(spark, str(tmp_path / "r.fq")).select("seq_id", "seq", "ordinal").collect()
            assert sorted((tuple(r) for r in got), key=lambda r: r[2]) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    both = files.fastq(spark, str(tmp_path / "*.fq*")).groupBy("file").agg(F.max("ordinal").alias("m")).collect()
    assert sorted(r.m for r in both) == [0, 699]


def test_assembly_summary_and_metadata(spark, tmp_path):
    (tmp_path / "sum.txt").write_text("# c\n#x\n" + "\t".join(f"v{i}" for i in range(22)) + "\n" + "\t".join(f"w{i}" for i in range(8)) + "\n")
    rows = sorted(files.assembly_summary(spark, str(tmp_path / "sum.txt")).collect(), key=lambda r: r.accession)
    assert (rows[0].accession, rows[0].taxid, rows[0].species_taxid, rows[0].organism, rows[0].date) == ("v0", "v5", "v6", "v7", "v14") and rows[1].url is None
    (tmp_path / "bac.tsv").write_text("accession\tother\tgtdb_representative\tgtdb_taxonomy\nRS_GCF_1.1\tx\tt\td__Bacteria;g__A;s__A b\nGB_GCA_2.1\tx\tf\td__Bacteria;g__A;s__\n")
    (tmp_path / "sp_clusters.tsv").write_text("Representative genome\tGTDB taxonomy\nRS_GCF_1.1\tz\nGB_GCA_3.1\td__Archaea;s__Q\n\tno\n")
    meta, cluster = gtdb.metadata(spark, str(tmp_path / "bac.tsv")), gtdb.clusters(spark, str(tmp_path / "sp_clusters.tsv"))
    assert {tuple(r) for r in gtdb.representatives(meta, cluster).collect()} == {("GCF_1.1", "d__Bacteria;g__A;s__A b", "bacteria", "d__Bacteria;g__A;s__A b", ""), ("GCA_3.1", "d__Archaea;s__Q", "archaea", "d__Archaea;s__Q", "")}
    none = cluster.limit(0)
    assert gtdb.representatives(meta, none, ("archaea",)).count() == 0 and gtdb.representatives(meta, none).count() == 1
    assert {tuple(r) for r in gtdb.lineages(meta, meta.select(gtdb.bare(F.col("accession")).alias("accession"))).collect()} == {("GCF_1.1", "s__A b", "A b"), ("GCA_2.1", "g__A", "A")}


def test_build_and_classify_from_the_command_line(spark, tmp_path):
    genomes = {"n1": sequence(20_000, 11), "n2": sequence(20_000, 12), "n3": sequence(20_000, 13)}
    for node, s in genomes.items():
        (tmp_path / f"{node}.fa").write_text(f">{node}_1\n{s[:12_000]}\n>{node}_2\n{s[12_000:]}\n")
    (tmp_path / "target.tsv").write_text("".join(f"{tmp_path}/{n}.fa\t{n}\n" for n in genomes))
    (tmp_path / "tax.info").write_text("1\t1\troot\troot\ng1\t1\tgenus\tG\nsp1\tg1\tspecies\tS one\nsp2\tg1\tspecies\tS two\ng2\t1\tgenus\tH\nsp3\tg2\tspecies\tS three\nn1\tsp1\tstrain\tx\nn2\tsp2\tstrain\ty\nn3\tsp3\tstrain\tz\n")
    rng, truth = random.Random(14), {}
    with open(tmp_path / "reads.fq", "w") as f:
        for i in range(60):
            node = rng.choice(["n1", "n2"])
            at = rng.randrange(19_000)
            s = genomes[node][at : at + 900]
            truth[f"r{i}"] = {"n1": "sp1", "n2": "sp2"}[node]
            f.write(f"@r{i}\n{s if i % 2 else complement(s)}\n+\n{'I' * 900}\n")
        f.write(f"@alien\n{sequence(900, 99)}\n+\n{'I' * 900}\n")
    main(["build", "--target", f"{tmp_path}/target.tsv", "--taxonomy", f"{tmp_path}/tax.info", "--index", f"{tmp_path}/db"])
    index = Archive(spark, f"{tmp_path}/db")
    assert {tuple(r) for r in index.taxa.collect()} == {("sp1", "g1", 2), ("sp2", "g1", 2), ("sp3", "g2", 2)}
    main(["classify", "--index", f"{tmp_path}/db", "--reads", f"{tmp_path}/reads.fq", "--out", f"{tmp_path}/out"])
    got = dict(r.value.split("\t", 1) for r in spark.read.text(f"{tmp_path}/out/Classify.tsv").collect())
    assert got.pop("alien") == "unclassified\tREJECT=no_candidate"
    assert {r: x.split(":")[0] for r, x in got.items()} == truth
    table = spark.read.csv(f"{tmp_path}/out/Profile.tsv", sep="\t", header=True, inferSchema=True).collect()
    assert {r.taxid for r in table} == {"sp1", "sp2"} and len(table[0]) == 17 and sum(r.relative_abundance for r in table) == pytest.approx(1)
    trace = spark.read.csv(f"{tmp_path}/out/Trace.tsv", sep="\t", header=True, inferSchema=True)
    assert trace.agg(F.sum("contribution")).first()[0] == pytest.approx(1)
    with pytest.raises(FileNotFoundError):
        Archive(spark, f"{tmp_path}/nothing").index
    (tmp_path / "ev.tsv").write_text("taxid\tcount\na\t3\nb\t1\n")
    main(["profile", "--evidence", f"{tmp_path}/ev.tsv", "--out", f"{tmp_path}/legacy"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/legacy").collect()][-2:] == ["a\t3.0\t75.00", "b\t1.0\t25.00"]


def test_chain_resumes_from_its_spool(spark, tmp_path):
    refs = spark.createDataFrame([(1, "g", "s", sequence(3000, 1)), (2, "g", "t", sequence(3000, 2))], "tid long, genus string, species string, seq string")
    index = engine.build(spark, refs, f"{tmp_path}/db")
    reads = spark.createDataFrame([("x", sequence(3000, 1)[500:1500])], "read string, seq string")
    first = engine.Run(spark, index, reads, f"{tmp_path}/spool")
    assert [r.species for r in first.scores.collect()] == ["s"]
    again = engine.Run(spark, Archive(spark, f"{tmp_path}/db"), reads.limit(0), f"{tmp_path}/spool")
    assert [r.species for r in again.scores.collect()] == ["s"]
    assert np.isclose(first.scores.first().evaluated, again.scores.first().evaluated)
