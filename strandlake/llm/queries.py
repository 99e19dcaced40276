"""The corpus operators' registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, lines, minhash, packing, sharding, tokens, topk, toxicity, urls
from .common import held_out, table

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), WORDS))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.described(packing.pack(table(spark, sf_dir, "documents"), WORDS))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count(table(spark, sf_dir, "documents"), BYTES)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.junk_list(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_topk, op3_line_dedup, op4_bpe, op5_exact_dedup, op6_sharding, op7_packing, op8_minhash, op9_token_counts, op10_url_filter)
}


def _op2_sql() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _op5_sql() -> str:
    return r"""
    WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS d FROM documents),
    w AS (SELECT doc_id, d, first_value(doc_id) OVER (PARTITION BY d ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY d) AS group_size FROM t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, d AS text_sha256 FROM w"""


def _op6_sql() -> str:
    held = ", ".join(map(str, sharding.fill(sharding.names(sharding.SHARDS))))
    return f"""
    WITH t AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
    SELECT doc_id, slot, list_extract([{held}], (slot + 1)::BIGINT)::INTEGER AS shard FROM t"""


def _op8_sql(percent: int = 85) -> str:
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    c AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b),
    m AS (SELECT a, min(b) AS component_id FROM c GROUP BY 1)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
    FROM w JOIN m ON m.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""


def _op10_sql() -> str:
    rest = "CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])))
    return f"""
    WITH a AS (SELECT page_id, {rest} AS rest FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') AS key, CASE {fits} END AS r FROM b),
    k AS (SELECT DISTINCT key FROM c WHERE regexp_matches(host, '{urls.pattern(urls.JUNK)}'))
    SELECT page_id, host, path, split_part(r, ' ', 2) AS rule,
           coalesce(split_part(r, ' ', 1), CASE WHEN key IN (SELECT key FROM k) THEN 'block' ELSE 'allow' END) AS verdict,
           key IN (SELECT key FROM k) AS listed FROM c""".replace("\\\\", "\\")


ORACLES: dict[str, str] = {"op2_topk": _op2_sql(), "op5_exact_dedup": _op5_sql(), "op6_sharding": _op6_sql(), "op8_minhash": _op8_sql(), "op10_url_filter": _op10_sql()}
