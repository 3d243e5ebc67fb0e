"""Sinks: CSV with fixed headers, JSON reports, JSON lines and replay corpora."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replay import nest


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, single: bool = False) -> None:
    """CSV with a header; missing columns are written blank.  One file if ``single`` (for small tables only)."""
    if fields is not None:
        df = df.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields])
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, rows: int = 10_000) -> str:
    """A metrics table (a few rows by design) as sorted, indented JSON."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a report of more than {rows} rows is a table; write it as one")
    return json.dumps([r.asDict(recursive=True) for r in got], indent=2, sort_keys=True, default=str)


def write_replay(pages: DataFrame, path: str) -> None:
    """Nested episodes as JSON lines, one episode a line, partitioned by nothing: readers take folders."""
    nest(pages).write.mode("overwrite").json(path)


def write_replay_object(pages: DataFrame, path: str, generated_at: str, schema_version: int = 1) -> None:
    """A replay corpus as objects with ``schema_version``, ``generated_at`` and ``episodes``, one a file.

    Every task writes an object of its own, so no task holds the whole corpus.
    """
    part = F.spark_partition_id().alias("part")
    made = nest(pages).select(part, F.struct("*").alias("e")).groupBy("part").agg(F.collect_list("e").alias("episodes"))
    made.select(F.lit(schema_version).alias("schema_version"), F.lit(generated_at).alias("generated_at"), "episodes").write.mode("overwrite").json(path)


def write_object(path: str, spark: SparkSession, **fields) -> None:
    """A small payload (synthetic cases, a spatial cache) as one JSON object in a file of ``path``."""
    text = json.dumps(fields, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_object(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> dict:
    """What ``write_object`` wrote; an error if it is no object or lacks a required field."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    found = json.loads(rows[0]["value"]) if len(rows) == 1 else None
    if not isinstance(found, dict) or any(f not in found for f in required):
        raise ValueError(f"{path} must hold one JSON object with {', '.join(required) or 'any fields'}")
    return found


def write_episodes(records: DataFrame, path: str) -> None:
    """Flat evidence records in one folder per episode."""
    records.write.mode("overwrite").partitionBy("episode_id").json(path)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_episodes`` wrote, ``episode_id`` as text."""
    return spark.read.json(path).withColumn("episode_id", F.col("episode_id").cast("string"))


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A small table as Markdown; an error beyond ``rows``."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"a Markdown table of more than {rows} rows is a table; write it as one")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got]
    return "\n".join(lines)
