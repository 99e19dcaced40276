"""Queries of the build side: sequences to features, frequencies, selections, taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.operators import features, packing, taxonomy

from . import sqlkernels as K
from .base import Base, query, r6


@query("f1_length_filter", "SELECT tid, length(seq)::INTEGER AS n FROM refs WHERE length(seq) >= 67")
def _(b: Base):
    return features.long_enough(b.refs, "seq").select("tid", F.length("seq").alias("n"))


@query(
    "x4_canonical_kmers",
    "SELECT tid, count(*) AS n, count(DISTINCT least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA'))) AS n_canonical FROM ck GROUP BY 1",
    ", cc AS (SELECT tid, substr(seq, o + 1, 267) AS part FROM refs, unnest(range(0, length(seq) - 11, 256)) u(o)), ck AS (SELECT tid, substr(part, i, 12) AS kmer FROM cc, unnest(range(1, least(length(part) - 11, 256) + 1)) u(i))",
)
def _(b: Base):
    return features.kmers(b.refs, 12).groupBy("tid").agg(F.count("*").alias("n"), F.countDistinct(S.canonical(F.col("kmer"))).alias("n_canonical"))


@query("a2_frequency", "SELECT h22, df FROM freq")
def _(b: Base):
    return b.archive.frequency


@query("f3_frequency_threshold", "SELECT threshold, enabled FROM lim")
def _(b: Base):
    return b.archive.limits.select("threshold", "enabled")


_COUNT = ", cnt AS (SELECT species, sum(length(seq))::BIGINT AS bp FROM refs GROUP BY 1), own AS (SELECT species, count(*) AS total, sum(uniq::BIGINT)::BIGINT AS uni FROM kept GROUP BY 1), counters AS (SELECT species, bp, coalesce(total, 0) AS total, coalesce(uni, 0) AS uni FROM cnt LEFT JOIN own USING (species))"


@query("f2_frequency_filter", "SELECT tid, pos, hash, uniq FROM kept")
def _(b: Base):
    return b.archive.kept.select("tid", F.col("pos").cast("long").alias("pos"), "hash", "uniq")


@query("a1_build_counters", "SELECT species, bp, total, uni AS unique_signatures FROM counters", _COUNT)
def _(b: Base):
    return b.archive.coverage.select("species", "bp", "total", F.col("unique").alias("unique_signatures"))


@query("a3_build_statistics", "SELECT count(*) AS sequences, sum((length(seq) < 67)::BIGINT)::BIGINT AS skipped, sum(length(seq))::BIGINT AS bp, (SELECT count(*) FROM dfeat) - (SELECT count(*) FROM kept) AS dropped FROM refs")
def _(b: Base):
    dropped = b.dfeat.agg(F.count("*").alias("n")).crossJoin(b.archive.kept.agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("dropped"))  # one row each
    return b.refs.agg(F.count("*").alias("sequences"), F.sum((F.length("seq") < 67).cast("long")).alias("skipped"), F.sum(F.length("seq")).alias("bp")).crossJoin(dropped)  # one row each


@query("a4_coverage_metadata", "SELECT species, round(CASE WHEN bp > 0 THEN uni / bp ELSE 0 END, 9) AS unique_density, round(CASE WHEN bp > 0 THEN uni / bp ELSE 0 END * 84, 6) AS expected FROM counters", _COUNT)
def _(b: Base):
    return b.archive.coverage.select("species", F.round("unique_density", 9).alias("unique_density"), r6(F.col("expected"), "expected"))


@query("a5_bin_packing")
def _(b: Base):
    counts = {r["species"]: r["total"] for r in b.archive.coverage.collect()}  # a number a taxon
    rows = [(i, slot, t, n) for i, held in enumerate(packing.pack(counts)) for slot, (t, n) in enumerate(held)]
    return b.spark.createDataFrame(rows, "bin int, slot int, taxid string, hashes long")


@query("a33_bucket_counts", "SELECT hash & 255 AS bucket, count(*) AS n FROM dfeat GROUP BY 1")
def _(b: Base):
    return b.dfeat.groupBy(F.col("hash").bitwiseAND(F.lit(255)).alias("bucket")).agg(F.count("*").alias("n"))


# --- selections over sequences' k-mers -------------------------------------------------

_SMER = ", s AS (SELECT read, i AS pos, ('0x' || substr(md5(least(substr(seq, i, 8), translate(reverse(substr(seq, i, 8)), 'ACGT', 'TGCA'))), 1, 15))::BIGINT AS hash FROM passages, unnest(range(1, length(seq) - 6)) u(i))"
_SYNC = _SMER + ", sync AS (SELECT read, pos, hash FROM (SELECT *, min(hash) OVER w AS least, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY read ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE hash = least AND n = 5)"


def smers(b: Base):
    return features.kmers(b.passages, 8).select("read", "pos", S.portable_hash(S.canonical(F.col("kmer"))).alias("hash"))


def syncs(b: Base):
    return features.syncmers(smers(b), ["read"], "pos", "hash", 5)


@query("w1_open_syncmers", "SELECT tid, pos, (h >> 1)::BIGINT AS half, (h & 1::UBIGINT)::BIGINT AS low FROM sy", ", " + K.syncmers("sy", "refs", "tid"))
def _(b: Base):
    rows = features.syncmer_rows(b.refs.select("tid", "seq"))
    return rows.select("tid", F.col("pos").cast("long").alias("pos"), F.shiftrightunsigned("hash", 1).alias("half"), F.col("hash").bitwiseAND(F.lit(1)).cast("long").alias("low"))


@query("x1_features", "SELECT tid, species, bin, pos, hash FROM dfeat")
def _(b: Base):
    return b.dfeat.select("tid", "species", "bin", F.col("pos").cast("long").alias("pos"), "hash")


@query("w2_minimizer_anchors", "SELECT tid, code AS key, pos, strand FROM mi", ", " + K.minimizers("mi", "refs", "tid"))
def _(b: Base):
    return b.archive.anchors.select("tid", "key", F.col("pos").cast("long").alias("pos"), "strand")


@query("w1_syncmers_by_window", "SELECT read, pos, hash FROM sync", _SYNC)
def _(b: Base):
    return syncs(b).select("read", F.col("pos").cast("long").alias("pos"), "hash")


@query(
    "w2_minimizers",
    "SELECT read, b.p AS pos, b.r AS rank FROM (SELECT *, lag(b.p) OVER (PARTITION BY read ORDER BY pos) AS before FROM m WHERE n >= 10) WHERE before IS NULL OR before <> b.p",
    _SMER + ", m AS (SELECT read, pos, min({'r': hash, 'p': pos}) OVER (PARTITION BY read ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS b, row_number() OVER (PARTITION BY read ORDER BY pos) AS n FROM s)",
)
def _(b: Base):
    return features.minimizers(smers(b), ["read"], "pos", "hash", 10).select("read", F.col("pos").cast("long").alias("pos"), "rank")


@query(
    "w3_randstrobe_partners",
    "SELECT a.read, a.pos, a.hash, coalesce(arg_min(b.hash, bit_count(xor(a.hash, b.hash) & 255)::BIGINT * 100000 + b.pos), a.hash) AS partner FROM o a LEFT JOIN o b ON b.read = a.read AND b.i BETWEEN a.i + 2 AND a.i + 8 AND b.pos <= a.pos + 60 GROUP BY a.read, a.pos, a.hash",
    _SYNC + ", o AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY pos) AS i FROM sync)",
)
def _(b: Base):
    return features.partners(syncs(b), ["read"], "pos", "hash", 2, 8, 60).select("read", F.col("pos").cast("long").alias("pos"), "hash", "partner")


@query("x5_strobe_content", "SELECT read, pos, ((hash & -67108864) | (df & 67108863)) & -256 AS content FROM rfeat JOIN df USING (hash)")
def _(b: Base):
    return b.rfeat.join(b.df, "hash").select("read", F.col("pos").cast("long").alias("pos"), features.strobe_content(F.col("hash"), F.col("df")).alias("content"))


@query("x1_strobemer_features")
def _(b: Base):
    return features.strobemers(b.refs.select("tid", "seq"))


@query(
    "t6_sorted_features",
    "SELECT read, CASE WHEN count(*) > 2048 THEN list_sort(list_distinct(list(hash))) ELSE list(hash ORDER BY pos) END AS hashes FROM rfeat GROUP BY 1",
)
def _(b: Base):
    rows = b.rfeat.groupBy("read").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("h"))
    return rows.select("read", F.when(F.size("h") > 2048, F.array_sort(F.array_distinct("h"))).otherwise(F.col("h")).alias("hashes"))


# --- taxonomy --------------------------------------------------------------------------


@query("j6_lineage_closure", "SELECT taxid, anc, dist FROM closure")
def _(b: Base):
    return taxonomy.closure(b.tree.select("taxid", "parent"))


@query(
    "j6_to_genus",
    "SELECT tree.taxid, coalesce(hit, 0) AS genus FROM tree LEFT JOIN (SELECT c.taxid, arg_min(anc, dist) AS hit FROM closure c JOIN tree t ON t.taxid = anc AND t.rank = 'genus' GROUP BY 1) USING (taxid)",
)
def _(b: Base):
    lineage = taxonomy.closure(b.tree.select("taxid", "parent"))
    return taxonomy.at_rank(lineage, b.tree, "genus", False).withColumnRenamed("at", "genus")


@query(
    "j6_to_species",
    "SELECT tree.taxid, coalesce(hit, tree.taxid) AS species FROM tree LEFT JOIN (SELECT c.taxid, arg_min(anc, dist) AS hit FROM closure c JOIN tree t ON t.taxid = anc AND t.rank = 'species' GROUP BY 1) USING (taxid)",
)
def _(b: Base):
    lineage = taxonomy.closure(b.tree.select("taxid", "parent"))
    return taxonomy.at_rank(lineage, b.tree, "species", True).withColumnRenamed("at", "species")


@query(
    "j6_lowest_common_ancestor",
    "SELECT p.a, p.b, arg_min(x.anc, x.dist) AS lca FROM pairs p JOIN closure x ON x.taxid = p.a JOIN closure y ON y.taxid = p.b AND y.anc = x.anc GROUP BY 1, 2",
    ", pairs AS (SELECT DISTINCT (1000 + o_custkey)::INTEGER AS a, (1000 + o_orderkey % (SELECT max(c_custkey) + 1 FROM customer))::INTEGER AS b FROM orders)",
)
def _(b: Base):
    most = b.customer.agg((F.max("c_custkey") + 1).alias("m"))
    pairs = b.orders.crossJoin(F.broadcast(most)).select((1000 + F.col("o_custkey")).cast("int").alias("a"), (1000 + F.col("o_orderkey") % F.col("m")).cast("int").alias("b")).distinct()
    return taxonomy.lca(pairs, taxonomy.closure(b.tree.select("taxid", "parent")))


@query(
    "f22_lineage_strings",
    "SELECT c.taxid, string_agg(c.anc::VARCHAR, ';' ORDER BY dist DESC) AS lineage_taxids, string_agg(t.name, ';' ORDER BY dist DESC) AS lineage_names FROM closure c JOIN tree t ON t.taxid = c.anc GROUP BY 1",
)
def _(b: Base):
    return taxonomy.lineages(taxonomy.closure(b.tree.select("taxid", "parent")), b.tree)


@query("j5_species_representative", "SELECT tid, species, genus, min(tid) OVER (PARTITION BY species) AS rep FROM refs")
def _(b: Base):
    return taxonomy.first_tid(b.refs.select("tid", "species", "genus"))


@query("a22_species_per_genus", "SELECT genus, count(DISTINCT species) AS species FROM refs GROUP BY 1")
def _(b: Base):
    from strandlake.operators.profile import species_in_genus

    return species_in_genus(b.refs, "genus", "species")
