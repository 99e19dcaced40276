"""A training-data pipeline: toxicity, line dedup, near-dedup, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last
returns the packed pieces. Stages are cut apart by written Parquet tables.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import lines, minhash, packing, toxicity
from strandlake.llm.common import remove, shared_dir, table
from strandlake.llm.queries import WORDS


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half stay; rows without an id are scored like any other."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without the lines whose like stands earlier; n_chars follows the text."""
    return lines.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return minhash.drop_near(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.described(packing.pack(docs, WORDS))


STAGES = [("toxicity", remove_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("packing", pack)]
#: No stage but the last could be put into SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes once the next one is written."""
    docs, top, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    atexit.register(remove, spark, top)
    return docs
