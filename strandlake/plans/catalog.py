"""Queries of the catalogue operations, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandlake.functions import scalars as S
from strandlake.operators import catalog, taxonomy

from .base import Base, query, r6
from .sources import _ACC, accessions


@query("f18_column_filter", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) IN ('o', 'f') AND o_totalprice > 1000 AND o_orderkey % 7 <> 0")
def _(b: Base):
    return catalog.chosen(b.orders, {"o_orderstatus": ["O", "f"]}, "o_totalprice > 1000 AND o_orderkey % 7 <> 0").select("o_orderkey")


@query("f19_date_range", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19940101' AND '19951231'")
def _(b: Base):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return catalog.dated(b.orders, day, "1994/01/01", "1995-12-31").select("o_orderkey", S.plain_date(day).alias("day"))


@query("f21_rank_normalisation", "SELECT c_custkey, coalesce(a.anc, t.taxid) AS node FROM customer JOIN tree t ON t.taxid = 1000 + c_custkey LEFT JOIN (SELECT c.taxid, arg_min(anc, dist) AS anc FROM closure c JOIN tree x ON x.taxid = anc AND x.rank = 'family' GROUP BY 1) a ON a.taxid = t.taxid")
def _(b: Base):
    at = taxonomy.at_rank(taxonomy.closure(b.tree.select("taxid", "parent")), b.tree, "family", True)
    return b.customer.select("c_custkey", (1000 + F.col("c_custkey")).cast("int").alias("taxid")).join(at, "taxid").select("c_custkey", F.col("at").alias("node"))


@query("j14_update_non_null", "SELECT p_partkey, coalesce(n.name, p_name) AS p_name, p_size FROM part LEFT JOIN (SELECT l_partkey, CASE WHEN max(l_quantity) > 45 THEN 'many' END AS name FROM lineitem GROUP BY 1) n ON n.l_partkey = p_partkey")
def _(b: Base):
    new = b.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.when(F.max("l_quantity") > 45, "many").alias("p_name"))
    return catalog.overwritten(b.part.select("p_partkey", "p_name", "p_size"), new, "p_partkey", ["p_name"])


@query("j15_first_accession_match", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) THEN o_custkey ELSE o_custkey + 1 END AS c_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) OR o_custkey + 1 IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(b: Base):
    rows = b.orders.withColumn("next", F.col("o_custkey") + 1)
    return catalog.first_match(rows, ["o_custkey", "next"], "o_orderkey", b.customer.where("c_acctbal > 5000"), "c_custkey")


@query("j16_lineage_inclusion", "SELECT c_custkey FROM customer WHERE 1000 + c_custkey IN (SELECT taxid FROM closure WHERE anc IN (11, 12)) AND 1000 + c_custkey NOT IN (SELECT taxid FROM closure WHERE anc IN (102, 108))")
def _(b: Base):
    lineage = taxonomy.closure(b.tree.select("taxid", "parent"))
    items = b.customer.select("c_custkey", (1000 + F.col("c_custkey")).cast("int").alias("node"))
    return catalog.included(items, lineage, "node", [11, 12], [102, 108]).select("c_custkey")


@query(
    "j17_snapshot_diff",
    "SELECT k, CASE WHEN o.k2 IS NULL THEN 'new' WHEN n.k1 IS NULL THEN 'removed' ELSE 'updated' END AS change FROM (SELECT coalesce(k1, k2) AS k, * FROM (SELECT o_orderkey AS k1, o_totalprice * 2 AS p1, o_orderstatus AS s1 FROM orders WHERE o_orderkey % 5 <> 0) n0 FULL JOIN (SELECT o_orderkey AS k2, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice * 2 END AS p2, o_orderstatus AS s2 FROM orders WHERE o_orderkey % 4 <> 0) o0 ON k1 = k2) z, (SELECT 1) WHERE k1 IS NULL OR k2 IS NULL OR p1 IS DISTINCT FROM p2 OR s1 IS DISTINCT FROM s2".replace("o.k2", "k2").replace("n.k1", "k1"),
)
def _(b: Base):
    new = b.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 2).alias("p"), F.col("o_orderstatus").alias("s"))
    old = b.orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 2).alias("p"), F.col("o_orderstatus").alias("s"))
    return catalog.diff(old, new, "k", ["p", "s"])


@query("j18_rank_join", "SELECT c_custkey, coalesce(nullif(CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END, ''), c_nationkey::VARCHAR) AS rank FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(b: Base):
    names = b.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("name"))
    return b.customer.join(names, "c_nationkey").select("c_custkey", F.coalesce(F.nullif("name", F.lit("")), F.col("c_nationkey").cast("string")).alias("rank"))


@query("j19_completeness", "SELECT coalesce(e, f) AS k, CASE WHEN e IS NULL THEN 'extra' WHEN f IS NULL THEN 'missing' ELSE 'complete' END AS status FROM (SELECT DISTINCT o_custkey AS e FROM orders) FULL JOIN (SELECT DISTINCT c_custkey + 3 AS f FROM customer) ON e = f")
def _(b: Base):
    return catalog.completeness(b.orders.select(F.col("o_custkey").alias("k")), b.customer.select((F.col("c_custkey") + 3).alias("k")), "k")


@query("j20_match_report", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(b: Base):
    own = b.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    found = b.customer.select("c_custkey").join(own, "c_custkey")
    return found.unionAll(b.customer.select("c_custkey").join(own, "c_custkey", "left_anti").withColumn("orders", F.lit(0).cast("long")))


@query("w16_top_assemblies", "SELECT p_partkey, p_brand, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 3")
def _(b: Base):
    return catalog.top_n(b.part, ["p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")], 3).select("p_partkey", "p_brand", "place")


@query("t1_profile_order", "SELECT *, row_number() OVER (ORDER BY response DESC, raw DESC, taxid) AS place FROM (SELECT l_suppkey AS taxid, round(sum(l_extendedprice), 2) AS response, count(*) AS raw FROM lineitem GROUP BY 1)")
def _(b: Base):
    rows = b.lineitem.groupBy(F.col("l_suppkey").alias("taxid")).agg(F.round(F.sum("l_extendedprice"), 2).alias("response"), F.count("*").alias("raw"))
    order = [F.desc("response"), F.desc("raw"), F.col("taxid")]
    return rows.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long")).orderBy("place")  # a row a taxon


@query("t2_text_order", "SELECT c_custkey::VARCHAR AS taxid, c_acctbal, row_number() OVER (ORDER BY c_custkey::VARCHAR) AS place FROM customer")
def _(b: Base):
    rows = b.customer.select(F.col("c_custkey").cast("string").alias("taxid"), "c_acctbal")
    return rows.withColumn("place", F.row_number().over(W.orderBy("taxid")).cast("long")).orderBy("place")  # a row a taxon


@query("u1_union_all", "SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders")
def _(b: Base):
    return b.customer.select(F.col("c_custkey").alias("k")).unionAll(b.orders.select("o_custkey"))


@query("u2_union_distinct", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def _(b: Base):
    return b.customer.select(F.col("c_custkey").alias("k")).union(b.supplier.select("s_suppkey")).distinct()


@query("u3_distinct_pairs", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(b: Base):
    return b.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("u4_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(b: Base):
    return b.customer.select(F.col("c_custkey").alias("k")).distinct().join(b.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("u5_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(b: Base):
    return b.customer.select(F.col("c_custkey").alias("k")).intersect(b.orders.select("o_custkey"))


@query("u6_bitmap_or", "SELECT event_type, count(DISTINCT user_id % 2048)::BIGINT AS bits FROM events GROUP BY 1")
def _(b: Base):
    """Sketches of each user group, then the or of them a type: as partial and final sketches are merged."""
    bit = F.pmod("user_id", F.lit(2048)) + 1
    parts = b.events.groupBy("event_type", (F.col("user_id") % 7).alias("g")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m"))
    return parts.groupBy("event_type").agg(F.bitmap_count(F.bitmap_or_agg("m")).alias("bits"))


@query("x8_unique_edge_bonus", "SELECT l_partkey, round(1 + (CASE WHEN deg = 1 AND bins = 1 AND n <= 1 THEN 1.0 WHEN deg = 1 AND bins > 1 THEN 0.25 ELSE 0.0 END) * (2 / (1 + log2(bins))), 6) AS bonus FROM (SELECT l_partkey, count(DISTINCT l_returnflag) AS deg, count(DISTINCT l_suppkey) AS bins, count(*) AS n FROM lineitem GROUP BY 1)")
def _(b: Base):
    rows = b.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("deg"), F.countDistinct("l_suppkey").alias("bins"), F.count("*").alias("n"))
    strength = F.when((F.col("deg") == 1) & (F.col("bins") == 1) & (F.col("n") <= 1), 1.0).when((F.col("deg") == 1) & (F.col("bins") > 1), 0.25).otherwise(0.0)
    return rows.select("l_partkey", r6(1 + strength * (2 / (1 + F.log2("bins"))), "bonus"))


@query("x9_smoothstep", "SELECT doc_id, round(1 - t * t * (3 - 2 * t), 6) AS weight FROM (SELECT doc_id, greatest(0.0, least(1.0, (n_chars - 1024) / 3072.0::DOUBLE)) AS t FROM documents)")
def _(b: Base):
    return b.documents.select("doc_id", r6(S.length_weight(F.col("n_chars")), "weight"))


@query("x10_dispersion", "SELECT c_custkey, round(v / (1 + v), 6) AS u, round(1 - exp(-pow(v, 4)), 6) AS s FROM (SELECT c_custkey, (1 - (c_custkey % 10) / 10.0::DOUBLE) * ln(1 + 1 + c_custkey % 5) AS v FROM customer)")
def _(b: Base):
    u, s = S.dispersion((F.col("c_custkey") % 10) / F.lit(10.0), (1 + F.col("c_custkey") % 5).cast("double"))
    return b.customer.select("c_custkey", r6(u, "u"), r6(s, "s"))


@query("x11_evidence_strength", "SELECT l_suppkey, round(greatest(0.0, (w - 0.5 * r) / (w + 0.5 * r)), 6) AS strength FROM (SELECT l_suppkey, avg(l_quantity) AS w, max(l_quantity) AS r FROM lineitem GROUP BY 1)")
def _(b: Base):
    rows = b.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("w"), F.max("l_quantity").alias("r"))
    return rows.select("l_suppkey", r6(F.greatest(F.lit(0.0), (F.col("w") - 0.5 * F.col("r")) / (F.col("w") + 0.5 * F.col("r"))), "strength"))


@query("x16_clean_labels", "SELECT conv_id, turn, regexp_replace(split_part(text, '|contig=', 1), '[\\t\\n\\r]', ' ', 'g') AS label FROM conversations")
def _(b: Base):
    return b.conversations.select("conv_id", "turn", S.clean_tsv(F.substring_index("text", "|contig=", 1)).alias("label"))


@query("x17_accession_parts", "SELECT acc, regexp_extract(acc, '_([0-9]+)', 1) AS number, regexp_extract(acc, '\\.([0-9]+)$', 1) AS version FROM acc", _ACC)
def _(b: Base):
    return accessions(b).select("acc", F.regexp_extract("acc", "_([0-9]+)", 1).alias("number"), F.regexp_extract("acc", "\\.([0-9]+)$", 1).alias("version"))


@query("x19_deepest_lineage", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'g__' || c_mktsegment ELSE 's__' || c_name END AS deepest FROM customer")
def _(b: Base):
    lineage = F.concat(F.lit("d__Bacteria;g__"), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, ";s__").otherwise(F.concat(F.lit(";s__"), F.col("c_name"))))
    return b.customer.select("c_custkey", S.deepest(lineage).alias("deepest"))


@query("x20_primary_accession", "SELECT o_orderkey, 'GCF_' || lpad(o_orderkey::VARCHAR, 9, '0') || '.1' AS acc FROM orders")
def _(b: Base):
    """Of several accessions of a row the first by prefix."""
    number = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    all_ = F.array(*(F.concat(F.lit(p), number, F.lit(".1")) for p in ("RS_", "GCA_", "GCF_")))
    best = F.array_min(F.transform(all_, lambda a: F.struct(F.when(a.startswith("GCF_"), 0).when(a.startswith("GCA_"), 1).otherwise(2).alias("p"), a.alias("a"))))
    return b.orders.select("o_orderkey", best["a"].alias("acc"))


@query("x21_merged_names", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' ' || p_brand END AS name FROM part")
def _(b: Base):
    strain = F.when(F.col("p_size") % 4 == 0, F.lit(None)).when(F.col("p_size") % 4 == 2, F.concat(F.lit("strain="), F.col("p_name"))).otherwise(F.concat(F.lit("strain="), F.col("p_brand")))
    return b.part.select("p_partkey", S.merged_name(F.col("p_name"), strain).alias("name"))


@query("x22_strict_numbers", "SELECT doc_id, CASE WHEN regexp_matches(w, '^[0-9]{1,10}$') AND try_cast(w AS BIGINT) < 4294967296 THEN try_cast(w AS BIGINT) END AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 4000000)::VARCHAR WHEN doc_id % 3 = 1 THEN '-' || doc_id ELSE source END AS w FROM documents)")
def _(b: Base):
    w = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") * 4000000).cast("string")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), F.col("doc_id").cast("string"))).otherwise(F.col("source"))
    return b.documents.select("doc_id", S.parse_u32(w).alias("n"))


@query("x23_fixed_point", "SELECT event_id, round(value * 1048576)::BIGINT AS fixed, bit_count(user_id)::INTEGER AS bits FROM events")
def _(b: Base):
    return b.events.select("event_id", S.fixed_point(F.col("value")).alias("fixed"), F.bit_count("user_id").alias("bits"))


@query("x24_md5", "SELECT doc_id, md5(text) AS md5 FROM documents")
def _(b: Base):
    return b.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("x25_number_formats", "SELECT o_orderkey, printf('%.6f', round(o_totalprice, 2)) AS fixed, format('{:,}', o_orderkey) AS grouped FROM orders")
def _(b: Base):
    return b.orders.select("o_orderkey", F.printf(F.lit("%.6f"), F.round("o_totalprice", 2)).alias("fixed"), F.format_number("o_orderkey", 0).alias("grouped"))
