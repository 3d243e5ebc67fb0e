"""Incremental ingest of replay corpora (an extension: batch merging stays the reference behaviour)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.replay import merge_corpora
from ..sources.readers import REPLAY_SCHEMA, pages_of


def stream_pages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New corpus files of a folder as long pages."""
    raw = spark.readStream.schema(REPLAY_SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", max_files).json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_path")).filter("episodes IS NOT NULL")
    fields = ["case_id", "attribute", "place", "gold_value", "search_attempts", "attempts", "final_decision"]
    return pages_of(raw.select("file", F.explode("episodes").alias("e")).select("file", *[F.col(f"e.{f}").alias(f) for f in fields]))


def merge_stream(pages: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch with what ``target`` holds, under a new version folder each time."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.drop("final_decision")
        if number:
            old = spark.read.parquet(f"{target}/v{number - 1}").withColumn("file", F.lit(""))
            rows = rows.unionByName(old.select(*rows.columns))
        merge_corpora(rows).write.mode("overwrite").parquet(f"{target}/v{number}")

    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
