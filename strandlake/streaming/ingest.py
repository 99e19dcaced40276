"""Read ingestion as micro-batches: each batch of files is classified and appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, folder: str, schema: StructType, classify: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 16) -> StreamingQuery:
    """Classify what arrives in a folder of Parquet files, at most `files` a batch, and stop when nothing is left.

    A batch has its own folder, so a batch that is run again after a failure replaces its rows.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
