"""Queries of the text sources, over lines made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandlake.functions import scalars as S
from strandlake.operators import profile
from strandlake.sources import files, gtdb

from .base import Base, query

_LINES = ", lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)"


def lines(b: Base):
    return b.documents.select(F.explode(F.split("text", "\n")).alias("value"))


@query("s1_manifest_scan", "SELECT valid, count(*) AS n, count(DISTINCT file) AS files, count(DISTINCT taxid) AS taxids FROM (SELECT w[1] AS file, w[2] AS taxid, len(w) >= 2 AS valid FROM (SELECT regexp_split_to_array(trim(value), '[ \\t]+') AS w FROM lines)) GROUP BY 1", _LINES)
def _(b: Base):
    return files.manifest_rows(lines(b)).groupBy("valid").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.countDistinct("taxid").alias("taxids"))


_IUPAC = "ACGTURYSWKMBDHVN"
_ONTO = "ACGTTACCAGACAAAA"  # fixed values: U as T, two-way and wider codes as one of their bases, N as A


@query("s2_iupac_fold", f"SELECT item_id, translate(regexp_replace(text, '[^{_IUPAC + _IUPAC.lower()}]', '', 'g'), '{_IUPAC + _IUPAC.lower()}', '{_ONTO * 2}') AS seq FROM benchmark")
def _(b: Base):
    return b.benchmark.select("item_id", F.translate(F.regexp_replace("text", f"[^{_IUPAC + _IUPAC.lower()}]", ""), _IUPAC + _IUPAC.lower(), _ONTO * 2).alias("seq"))


@query("s3_read_ordinals", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM benchmark")
def _(b: Base):
    """Dense numbers without one task: the counts before each partition of a range sort are added to its own."""
    rows = b.benchmark.select("item_id").repartitionByRange("item_id").sortWithinPartitions("item_id").withColumn("part", F.spark_partition_id())
    own = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = own.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    rank = F.row_number().over(W.partitionBy("part").orderBy("item_id")) - 1
    return rows.withColumn("r", rank).join(F.broadcast(before), "part").select("item_id", (F.col("before") + F.col("r")).alias("ordinal"))


@query("s4_paired_reads", "SELECT a.turn AS ordinal, a.conv_id AS seq_id, length(a.text) + length(b.text) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0")
def _(b: Base):
    c = b.conversations
    left = c.where("turn % 2 = 0").select(F.struct("conv_id", "turn").alias("ordinal"), F.col("conv_id").alias("seq_id"), F.col("text").alias("seq"))
    right = c.where("turn % 2 = 1").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("ordinal"), F.col("text").alias("seq"))
    return files.paired(left, right).select("ordinal.turn", "seq_id", (F.length("seq") + F.length("seq2")).cast("long").alias("n")).withColumnRenamed("turn", "ordinal")


@query("s5_bounded_scan", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 200000")
def _(b: Base):
    """The calibration sample: the first 200,000 reads by ordinal; the bound is the operator's own."""
    return b.orders.select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(200_000)


_DMP = ", dmp AS (SELECT taxid, parent, rank, name FROM tree)"


@query("s6_taxdump_scan", "SELECT taxid, parent, rank, name FROM tree")
def _(b: Base):
    bar = F.lit("\t|\t")
    nodes = b.tree.select(F.concat(F.concat_ws("\t|\t", F.col("taxid").cast("string"), F.col("parent").cast("string"), "rank"), F.lit("\t|")).alias("value"))
    names = b.tree.select(F.concat(F.col("taxid").cast("string"), bar, F.col("name"), bar, bar, F.lit("scientific name\t|")).alias("value"))
    synonyms = b.tree.select(F.concat(F.col("taxid").cast("string"), bar, F.lit("other"), bar, bar, F.lit("synonym\t|")).alias("value"))
    return files.nodes(nodes).withColumn("rank", F.regexp_replace("rank", "\\t\\|$", "")).join(files.names(names.unionAll(synonyms).withColumn("value", F.regexp_replace("value", "\\t\\|$", ""))), "taxid")


@query("s7_tax_info_scan", "SELECT taxid::VARCHAR AS node, parent::VARCHAR AS parent, rank, name FROM tree")
def _(b: Base):
    rows = b.tree.select(F.concat_ws("\t", F.col("taxid").cast("string"), F.col("parent").cast("string"), "rank", "name").alias("value"))
    return files.tax_info(rows.unionAll(b.tree.select(F.lit("too\tshort").alias("value"))))


@query("s9_key_values", "SELECT 'event_' || event_id AS key, user_id::VARCHAR AS value FROM events")
def _(b: Base):
    text = b.events.select(F.explode(F.array(F.concat(F.lit("  event_"), F.col("event_id").cast("string"), F.lit(" = "), F.col("user_id").cast("string")), F.lit("# note = x"), F.lit(""))).alias("value"))
    return files.key_values(text)


@query("s16_summary_semi_join", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def _(b: Base):
    return b.part.select("p_partkey", "p_name", "p_size").join(b.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


_ACC = ", acc AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'GCA_' ELSE 'GCF_' END || lpad(o_orderkey::VARCHAR, 9, '0') || '.' || (o_custkey % 4 + 1) AS acc FROM orders)"


def accessions(b: Base):
    return b.orders.select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "GCA_").otherwise("GCF_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("."), (F.col("o_custkey") % 4 + 1).cast("string")).alias("acc"))


@query("s17_accession_scan", "SELECT DISTINCT acc AS accession, regexp_replace(acc, '\\.[0-9]*', '', 'g') AS versionless FROM acc", _ACC)
def _(b: Base):
    path = F.concat(F.lit("/data/x/"), F.col("acc"), F.lit("_ASM1_genomic.fna.gz"))
    own = S.accession(path)
    return accessions(b).select(own.alias("accession"), S.versionless(own).alias("versionless")).dropDuplicates(["accession"])


@query("x18_ftp_paths", "SELECT acc, substr(acc, 1, 3) || '/' || substr(acc, 5, 3) || '/' || substr(acc, 8, 3) || '/' || substr(acc, 11, 3) AS path FROM acc", _ACC)
def _(b: Base):
    return accessions(b).select("acc", S.ftp_path(F.col("acc")).alias("path"))


@query("s21_evidence_scan", "SELECT l_partkey::VARCHAR AS taxid, sum(l_quantity) AS count FROM lineitem GROUP BY 1")
def _(b: Base):
    text = b.lineitem.select(F.explode(F.array(F.concat_ws("\t", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")), F.lit("taxid\tcount"), F.lit("# x\t1"), F.concat_ws("\t", F.col("l_partkey").cast("string"), F.lit("-1")))).alias("value"))
    return files.evidence(text).groupBy("taxid").agg(F.sum("count").alias("count"))


@query("a31_krona_counts", "SELECT event_type AS taxid, count(*) + 1 AS count FROM events GROUP BY 1")
def _(b: Base):
    text = b.events.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.lit("POST_TOPK=a:1"), F.concat(F.col("event_type"), F.lit(":3"))).alias("value"))
    return profile.krona(files.krona_taxid(text), "taxid")


@query("a30_legacy_profile", "SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'unclassified') AS taxon, round(sum(value), 4) AS count FROM events GROUP BY 1")
def _(b: Base):
    rows = b.events.select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("species"), "value")
    return profile.legacy(rows, "species", "value").select("taxon", F.round("count", 4).alias("count"))


@query(
    "k14_legacy_lines",
    "SELECT 5 + (row_number() OVER (ORDER BY (taxon = 'unclassified')::INTEGER, count DESC, taxon))::INTEGER - 1 AS at, taxon || chr(9) || count::DOUBLE::VARCHAR || chr(9) || printf('%.2f', round(100 * count / sum(count) OVER (), 2)) AS line FROM (SELECT CASE WHEN event_type = 'view' THEN 'unclassified' ELSE event_type END AS taxon, count(*) AS count FROM events GROUP BY 1) UNION ALL SELECT * FROM (VALUES (0, '# profile_input=aggregate_evidence'), (1, '# count_unit=reads'), (2, 'Taxon' || chr(9) || 'Count' || chr(9) || 'Relative Abundance (%)'), (3, ''), (4, '## Species Level ##'))",
)
def _(b: Base):
    rows = b.events.select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("species"), F.lit(1).alias("n"))
    return files.profile_lines(profile.legacy(rows, "species", "n"))


# --- genome taxonomy metadata: customers stand for genomes, their nations and segments for a lineage

_META = """, meta AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'RS_GCF_' ELSE 'GB_GCA_' END || lpad(c_custkey::VARCHAR, 9, '0') || '.1' AS accession, CASE c_custkey % 4 WHEN 0 THEN 't' WHEN 1 THEN 'False' WHEN 2 THEN ' TRUE' ELSE NULL END AS rep,
  CASE WHEN c_nationkey % 5 = 0 THEN 'd__Archaea' ELSE 'd__Bacteria' END || ';g__' || c_mktsegment || ';s__' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS taxonomy, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS organism, 'ASM' || c_nationkey AS assembly_name FROM customer),
bare AS (SELECT *, regexp_replace(accession, '^(RS_|GB_)', '') AS acc FROM meta),
clus AS (SELECT accession, 'd__Bacteria;s__c' AS taxonomy FROM meta WHERE substr(accession, 15, 1)::INTEGER < 6 UNION ALL SELECT 'GB_GCA_9' || lpad(s_suppkey::VARCHAR, 8, '0') || '.2', CASE WHEN s_suppkey % 2 = 0 THEN 'd__Archaea;s__' || s_name ELSE '' END FROM supplier)"""


def _metadata(b: Base):
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    lineage = F.concat(F.when(F.col("c_nationkey") % 5 == 0, "d__Archaea").otherwise("d__Bacteria"), F.lit(";g__"), "c_mktsegment", F.lit(";s__"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")))
    mark = F.when(F.col("c_custkey") % 4 == 0, "t").when(F.col("c_custkey") % 4 == 1, "False").when(F.col("c_custkey") % 4 == 2, " TRUE")
    return b.customer.select(
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "RS_GCF_").otherwise("GB_GCA_"), key, F.lit(".1")).alias("accession"), mark.alias("gtdb_representative"), lineage.alias("gtdb_taxonomy"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("ncbi_organism_name"), F.concat(F.lit("ASM"), F.col("c_nationkey").cast("string")).alias("ncbi_assembly_name"),
    )


def _clusters(b: Base):
    own = _metadata(b).where(F.substring("accession", 15, 1).cast("int") < 6).select("accession", F.lit("d__Bacteria;s__c").alias("taxonomy"))
    key = F.concat(F.lit("GB_GCA_9"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit(".2"))
    return own.unionAll(b.supplier.select(key, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("d__Archaea;s__"), "s_name")).otherwise("")))


@query("f20_representative_filter", "SELECT accession FROM meta WHERE lower(trim(coalesce(rep, ''))) IN ('t', 'true', '1', 'yes')", _META)
def _(b: Base):
    return _metadata(b).where(gtdb.truthy(F.col("gtdb_representative"))).select("accession")


@query("s19_metadata_lineages", "SELECT acc AS accession, node, substr(node, 4) AS name FROM (SELECT acc, CASE WHEN taxonomy LIKE '%;s__' THEN split_part(taxonomy, ';', 2) ELSE split_part(taxonomy, ';', 3) END AS node FROM bare WHERE acc LIKE 'GCF%')", _META)
def _(b: Base):
    meta = _metadata(b)
    return gtdb.lineages(meta, meta.where("accession like 'RS%'").select(gtdb.bare(F.col("accession")).alias("accession")))


@query(
    "s20_representatives",
    """SELECT acc AS accession, b.taxonomy, CASE WHEN starts_with(b.taxonomy, 'd__Archaea') THEN 'archaea' ELSE 'bacteria' END AS kingdom, coalesce(nullif(organism, ''), b.taxonomy) AS organism, assembly_name FROM bare b JOIN clus c ON c.accession = b.accession WHERE lower(trim(coalesce(rep, ''))) IN ('t', 'true', '1', 'yes')
    UNION ALL SELECT acc, n, CASE WHEN starts_with(t, 'd__Archaea') THEN 'archaea' ELSE 'bacteria' END, n, '' FROM (SELECT regexp_replace(accession, '^(RS_|GB_)', '') AS acc, taxonomy AS t, coalesce(nullif(taxonomy, ''), regexp_replace(accession, '^(RS_|GB_)', '')) AS n FROM clus)
      WHERE acc NOT IN (SELECT acc FROM bare WHERE lower(trim(coalesce(rep, ''))) IN ('t', 'true', '1', 'yes'))""",
    _META,
)
def _(b: Base):
    return gtdb.representatives(_metadata(b), _clusters(b))
