"""op6 -- mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a uniform hash.  Words are summed by (source, top hash bits); per source a
running sum over those few buckets finds the bucket in which the word budget runs out.  Only that
bucket is histogrammed again by the next hash bits, until the threshold is exact to one document.
Filtering compares hashes with thresholds, so documents are never sorted or ranked.

A target of ``(a + f)`` times a source's size takes every document ``a`` times and those below the
threshold for the fraction ``f`` once more; larger budgets take supersets (nested thresholds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table

#: Hash bits per histogram level: 4096 buckets a source and level whatever the input's size.
LEVEL_BITS = 12
LEVELS = 3
#: Fixed values of the mix: weights that repeat over the sources in code point order.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Targets are ``least(most * size, level * weight)`` where ``level`` uses up ``share`` of all
    words; sources with the least room per weight reach their cap first, so running sums in that
    order give the level without iterating.  Works on the table of sources, not of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    room = sizes.withColumn("_weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    total = room.agg(F.sum("source_size").alias("_total"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    staged = (
        room.crossJoin(F.broadcast(total))  # one row
        .withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_weight").over(onward))
        .withColumn("_level", (F.lit(share) * F.col("_total") - F.col("_used")) / F.col("_left"))
    )
    # The true level is that of the first source in ratio order which does not reach its cap.
    uncapped = F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.col("_level"))
    level = F.first(uncapped, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return staged.withColumn("_level", level).select(
        "source",
        "source_size",
        F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), F.col("_cap")).alias("target"),
    )


def _bucket(hash_col: str, level: int) -> Column:
    """Bits of the non-negative 63-bit hash that level ``level`` looks at."""
    return F.shiftright(F.col(hash_col), 63 - LEVEL_BITS * (level + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1).cast("long"))


def plan_mix(sized: DataFrame, share: float = SHARE, weights=WEIGHTS, most: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """Thresholds for documents ``(source, size, hash)``.

    Returns ``(plan, hist)``.  ``plan`` has a row per source: ``source, source_size, target, base,
    limit``; a document is taken ``base`` times, and once more if ``hash < limit``.  ``hist`` has a
    row per (source, ``b0``) that holds documents.
    """
    keyed = sized.withColumn("b0", _bucket("hash", 0))
    hist = materialize(keyed.groupBy("source", "b0").agg(F.sum("size").alias("words")), "mix-hist")
    goals = targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), share, weights, most)
    goals = goals.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = materialize(goals.withColumn("need", F.col("target") - F.col("base") * F.col("source_size")), "mix-goals")

    # Per source, the first bucket whose running sum passes the budget is the boundary.
    def boundary(h: DataFrame, bucket: str) -> DataFrame:
        run = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = h.withColumn("_cum", F.sum("words").over(run)).filter(F.col("_cum") > F.col("need"))
        left = (F.col("need") - F.col("_cum") + F.col("words")).alias("left")
        return cum.groupBy("source").agg(F.min(F.struct(F.col(bucket).alias("bucket"), "words", left)).alias("_at"))

    with_need = hist.join(goals.select(F.col("source").alias("_s"), "need"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at = boundary(with_need, "b0")
    low = F.shiftleft(F.col("_at.bucket"), 63 - LEVEL_BITS).alias("low")
    edge = materialize(at.select("source", F.col("_at.bucket").alias("b0"), F.col("_at.left").alias("need"), low), "mix-edge")
    for level in range(1, LEVELS):
        # Only the boundary bucket of each source is read on: a 4096th of its documents, then of those.
        step = 63 - LEVEL_BITS * (level + 1)
        e = edge.select(F.col("source").alias("_s"), F.col("b0").alias("_b"), "need", "low")
        inside = keyed.join(e, F.col("source").eqNullSafe(F.col("_s")) & (F.col("b0") == F.col("_b"))).filter(
            (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(1 << (step + LEVEL_BITS)))
        )
        h = inside.groupBy("source", _bucket("hash", level).alias("fine")).agg(F.sum("size").alias("words"), F.max("need").alias("need"))
        nxt = boundary(h, "fine").select(F.col("source").alias("_s"), F.col("_at.bucket").alias("_n"), F.col("_at.left").alias("_left"), F.col("_at.words").alias("_words"))
        low = F.coalesce(F.col("low") + F.shiftleft(F.col("_n"), step), F.col("low"))
        if level == LEVELS - 1:  # what is left is one document, or equal hashes: the nearer side of it
            low = low + F.when(F.col("_left") * 2 > F.col("_words"), F.lit(1 << step)).otherwise(F.lit(0)).cast("long")
        edge = edge.join(nxt, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "b0", F.coalesce("_left", F.lit(0.0)).alias("need"), low.alias("low"))
        edge = materialize(edge, "mix-edge")

    e = edge.select(F.col("source").alias("_e"), "low")
    limit = F.when(F.col("need") <= 0, F.lit(0)).otherwise(F.coalesce(F.col("low"), F.lit((1 << 63) - 1))).cast("long")
    plan = goals.join(e, F.col("source").eqNullSafe(F.col("_e")), "left").select("source", "source_size", "target", "base", limit.alias("limit"))
    return materialize(plan, "mix-plan"), hist


#: Per-source rows are broadcast up to this many sources (under 100 bytes each); beyond, they are
#: joined by (source, first-level bucket), which spreads a hot source over 4096 keys.
BROADCAST_SOURCES = 50_000


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 7, keep: list[str] | None = None, **options) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``: how often the mix takes each document.

    ``keep`` names the columns carried through (default: all).  Null texts have size 0, a null
    source is a source of its own, last in order.  Repeated rows share their hash and so are taken
    alike.  Added names that clash with kept columns get a leading underscore.  An empty table
    gives an empty result.  Reruns give the same mix: hashes depend on ``key``, text and ``seed``.
    """
    keep = docs.columns if keep is None else keep
    spread = F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text).cast("binary"))).bitwiseAND(F.lit((1 << 63) - 1))
    rows = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)], F.col(source).alias("source"), word_count(F.col(text)).alias("size"), spread.alias("hash"))
    if text in keep:  # histograms read a narrow copy; whole rows are read once more, to filter
        narrow = materialize(rows.select("source", "size", "hash"), "mix-sizes")
    else:
        narrow = rows = materialize(rows, "mix-sizes")
    plan, hist = plan_mix(narrow.select("source", "size", "hash"), **options)
    p = plan.withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    if plan.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(p), same)
    else:
        spread_plan = hist.select("source", F.col("b0").alias("_b")).join(p, same).drop("source")
        joined = rows.withColumn("b0", _bucket("hash", 0)).join(spread_plan, same & (F.col("b0") == F.col("_b")))
    out = free_name(docs.select(*keep), "size", "source_size", "target", "copies")
    copies = F.col("base") + (F.col("hash") < F.col("limit")).cast("long")
    return joined.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("size").alias(out[0]), F.col("source_size").alias(out[1]), F.col("target").alias(out[2]), copies.alias(out[3]),
    )


def repeat_rows(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """The mix itself: each row as often as ``copies`` says."""
    some = mixed.filter(F.col(copies) > 0)
    return some.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int"))))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
