"""op2 -- two-pass external shuffle into shards of near equal row counts.

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash of the record.  Pass 2
loads one bucket at a time, Fisher-Yates shuffles it with a generator seeded by (seed, bucket) and
writes it.  Bucket after bucket, the written files are one uniform permutation of all records;
shards are equal cuts of it, so their counts differ by at most one (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, materialize, scratch_path, table

#: UTF-8 bytes of text a bucket should hold.  A task holds one bucket about three times over.
BUCKET_BYTES = 16 << 20
SHARDS = 8


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of ``range(n)``."""
    rng = np.random.default_rng(seed)
    draw = (rng.random(max(n - 1, 0)) * np.arange(n, 1, -1)).astype(np.int64).tolist()
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), draw, strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def external_shuffle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` as shuffled buckets; returns the written rows with ``bucket, place``.

    Rows are ordered by (bucket, place).  Equal rows are kept, each with its own place.  Null keys
    and texts are ordinary values.  An empty table gives an empty result.  A key that fills far
    more than its share of a bucket is scattered by its row's position instead of its key.
    """
    spark = docs.sparkSession
    where, place, tie = free_name(docs, "bucket", "place", "tie")
    total = docs.agg(F.coalesce(F.sum(text_size(F.col(text))), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    buckets = max(1, -(-total["b"] // bucket_bytes))
    base = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets))
    # A bucket far above the mean holds a hot key; fewer than half of the buckets can.
    mean = max(1, total["n"] / buckets)
    hot = docs.groupBy(base.alias("b")).count().filter(F.col("count") > 2 * mean + 100)
    hot = [r["b"] for r in hot.select("b").collect()] if buckets > 1 else []
    if hot:
        anywhere = F.pmod(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()), F.lit(buckets))
        base = F.when(base.isin(hot), anywhere).otherwise(base)
    tied = F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text).cast("binary")))
    scattered = docs.withColumn(tie, tied).withColumn(where, base.cast("int")).repartitionById(buckets, F.col(where))
    schema = T.StructType([*docs.schema.fields, T.StructField(where, T.IntegerType()), T.StructField(place, T.LongType())])
    names = [*docs.columns, where]

    def shuffle(batches):
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is None:
            return
        for b in sorted(pc.unique(held[where]).to_pylist()):
            rows = np.flatnonzero(pc.equal(held[where], b).to_numpy())
            # Ties are sorted first, so that the outcome does not hang on the order of arrival.
            order = rows[np.argsort(held[tie].to_numpy()[rows], kind="stable")][fisher_yates(len(rows), [seed, b])]
            for i in range(0, len(order), 1024):
                part = held.select(names).take(pa.array(order[i : i + 1024])).append_column(place, pa.array(np.arange(i, min(i + 1024, len(order)))))
                yield from part.combine_chunks().to_batches()
        del held
        give_back()

    path = scratch_path(spark, "shuffled")
    scattered.mapInArrow(shuffle, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shard(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """``docs`` with ``shard, slot``: equal cuts of the shuffled order, slots gapless from 0."""
    keep = docs.columns
    shuffled = external_shuffle(docs, **options)
    where, place = shuffled.columns[-2:]
    counts = materialize(shuffled.groupBy(where).agg(F.count("*").alias("rows")), "bucket-rows")
    # One row a bucket: a running sum over the bucket list, not over records.
    before = F.coalesce(F.sum("rows").over(Window.orderBy(where).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    starts = counts.select(F.col(where).alias("_b"), before.alias("_start"))
    if counts.count() <= 100_000:  # 12 bytes each
        starts = F.broadcast(starts)
    at, cut = free_name(shuffled, "at", "cut")
    out = free_name(docs, "shard", "slot")
    placed = shuffled.join(starts, F.col(where) == F.col("_b")).withColumn(at, F.col("_start") + F.col(place))
    placed = placed.withColumn(cut, F.expr(f"(`{at}` * {shards}) div {max(total, 1)}"))
    first = F.expr(f"(`{cut}` * {total} + {shards - 1}) div {shards}")  # the first place of this shard
    return placed.select(*keep, F.col(cut).cast("int").alias(out[0]), (F.col(at) - first).alias(out[1]))


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One folder a shard, for trainers that read files."""
    sharded.write.partitionBy(shard_col).parquet(path)


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = shard(docs)
    return out.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
