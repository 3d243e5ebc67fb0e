"""op7 -- substring deduplication with a log-structured fingerprint index.

Documents arrive in batches, in document order.  Every window of 13 words holds one anchor (see
``winnow``), and a run of windows under one anchor is a context.  The index keeps, in one shared
folder that can be opened again:

* ``runs``: immutable sorted runs, one a batch.  A row is a kind of context (anchor fingerprint and
  digest of its window hashes) with its earliest place.  Runs are bucketed by fingerprint, so a new
  batch is merge-joined with history without moving history, and copies of a passage are one row.
* ``docs``: the texts, bucketed by document, so contexts are read again without moving texts.

A batch's contexts are compared with the kinds of new and historical documents under the same
fingerprints.  First whole contexts: one that an earlier document holds too is a repeat.  Where a
fingerprint has different kinds, the windows of each kind's earliest place are hashed from the
text and compared one by one.  Equality is that of 128 bits (fingerprint and digest, or fingerprint,
place and window hash); words themselves are not compared.

Runs are levelled: ``FAN_IN`` runs of one level are compacted into one of the next, bucket by bucket.
"""

from __future__ import annotations

import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, materialize, mix, release, remove, scratch_path, shingle_hashes, signed, table, text_blocks, word_hashes
from .winnow import contexts, ranges

WINDOW = 13
GRAM = 5
BATCHES = 3
#: Runs of one level that are compacted into one of the next.
FAN_IN = 2
_LAST = (1 << 63) - 1


def _keys(docs: DataFrame, key: str, text: str) -> list[Column]:
    """``o, t``: a document's order (null last) and, where keys repeat, what tells their rows apart."""
    order = F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    unique = docs.groupBy(order).count().filter("count > 1").isEmpty()
    return [order.alias("o"), (F.lit(0).cast("long") if unique else F.xxhash64(F.col(text))).alias("t")]


def window_hashes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the windows at ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(WINDOW):
        out += words[starts + j] * np.uint64(pow(0xE7037ED1A0B428DB, j + 1, 1 << 64))
    return mix(out)


#: A context's first window, its place against the anchor (0 to -12) and its windows (13 at most), in one long.
_PLACE, _START = 256, 65536
_CONTEXT = "fp long, digest long, o long, t long, at long"
_KIND = ["fp", "digest", "o", "t", "at", "more"]


def _first() -> list[Column]:
    """A kind's earliest place; aggregates of numbers need no sort."""
    return [F.min("o").alias("o"), F.min_by("t", "o").alias("t"), F.min_by("at", "o").alias("at")]


def _contexts(batches):
    """All contexts of rows ``o, t, text``: first window, its place against the anchor, windows."""
    names = ["fp", "digest", "o", "t", "at"]
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column(2), 1 << 19):
            words, at = word_hashes(data, offsets)
            grams = shingle_hashes(words, GRAM)
            row, lo, hi, anchor = contexts(grams, at, WINDOW, GRAM)
            starts, which = ranges(lo, hi)
            digest = np.zeros(len(row), np.uint64)
            np.add.at(digest, which, mix(window_hashes(words, starts) + (starts - anchor[which]).astype(np.uint64)))
            take = pa.array(first + row)
            columns = [pa.array(signed(grams[anchor])), pa.array(signed(mix(digest))), batch.column(0).take(take), batch.column(1).take(take)]
            columns.append(pa.array((lo - at[row]) * _START + (anchor - lo) * _PLACE + hi - lo + 1))
            for i in range(0, max(len(row), 1), 65536):
                yield pa.RecordBatch.from_arrays([c[i : i + 65536] for c in columns], names=names)


_WINDOW = "fp long, place int, h long, o long, t long, start int, new boolean"


def _windows(batches):
    """Each window of the contexts ``wants`` of rows ``o, t, text, wants, new``, with its place and hash."""
    for batch in batches:
        lists = batch.column(3)
        ends = np.cumsum(np.r_[0, lists.value_lengths().to_numpy(zero_copy_only=False)])
        flat = lists.flatten()
        fp, packed = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        start, place, n = packed // _START, -(packed % _START // _PLACE), packed % _PLACE
        for first, data, offsets in text_blocks(batch.column(2), 1 << 19):
            words, at = word_hashes(data, offsets)
            a, b = int(ends[first]), int(ends[first + len(offsets) - 1])
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(ends[first : first + len(offsets)]))
            begin = at[row] + start[a:b]
            starts, which = ranges(begin, begin + n[a:b] - 1)
            step = starts - begin[which]
            take = pa.array(first + row[which])
            columns = [pa.array(fp[a:b][which]), pa.array((place[a:b][which] + step).astype(np.int32)), pa.array(signed(window_hashes(words, starts)))]
            columns += [batch.column(0).take(take), batch.column(1).take(take), pa.array((start[a:b][which] + step).astype(np.int32)), batch.column(4).take(take)]
            for i in range(0, max(len(starts), 1), 65536):
                yield pa.RecordBatch.from_arrays([c[i : i + 65536] for c in columns], names=["fp", "place", "h", "o", "t", "start", "new"])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class FingerprintIndex:
    """Runs and texts of the documents seen so far, in ``path``; the same path opens them again.

    ``columns`` (name and type, DDL) are carried beside ``o, t, text``.  The number of buckets is
    fixed when an index is made; it is part of the folders' names.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str = "", buckets: int | None = None):
        self.spark, self.path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = [s.getPath().getName() for s in files.listStatus(hadoop)] if files.exists(hadoop) else []
        made = next((int(x.removeprefix("runs-")) for x in old if x.startswith("runs-")), None)
        self.buckets = made or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"attestra_{uuid.uuid4().hex}"
        self.runs, self.docs = f"{name}_runs", f"{name}_docs"
        self._make(self.runs, f"{_CONTEXT}, more boolean, level int, run int", "level, run", "fp", "SORTED BY (fp)", f"{path}/runs-{self.buckets}", made)
        self._make(self.docs, f"o long, t long, text string{', ' * bool(columns)}{columns}, batch int", "batch", "o, t", "", f"{path}/docs-{self.buckets}", made)

    def _make(self, name: str, columns: str, parts: str, by: str, order: str, path: str, made: int | None) -> None:
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY ({parts}) CLUSTERED BY ({by}) {order} INTO {self.buckets} BUCKETS LOCATION '{path}'")
        if made:
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def levels(self) -> list[tuple[int, int]]:
        """``(level, run)`` of every run."""
        rows = self.spark.sql(f"SHOW PARTITIONS {self.runs}").collect()
        return sorted(tuple(int(x.split("=")[1]) for x in r[0].split("/")) for r in rows)

    def close(self) -> None:
        """Forget the tables; the files stay."""
        for name in (self.runs, self.docs):
            self.spark.sql(f"DROP TABLE {name}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Add documents ``o, t, text`` (and columns), all later than those before.

        Returns ``o, t, spans`` of their windows that start in an earlier document.
        """
        spark = self.spark
        number = 1 + max((r for _, r in self.levels()), default=0)
        batch.withColumn("batch", F.lit(number)).repartition(self.buckets, "o", "t").write.insertInto(self.docs)
        release(spark)
        texts = spark.table(self.docs).filter(F.col("batch") == number)
        found = materialize(texts.select("o", "t", "text").mapInArrow(_contexts, _CONTEXT), "contexts")
        # A kind's copies meet in partial sums, so a hot passage moves one row a task.
        kinds = found.groupBy("fp", "digest").agg(*_first(), (F.max("o") > F.min("o")).alias("more"))
        kinds.select(*_KIND, F.lit(0).alias("level"), F.lit(number).alias("run")).repartition(self.buckets, "fp").write.insertInto(self.runs)
        release(spark)
        repeats = self._verify(found, number)
        self.compact()
        release(spark)
        return repeats

    def _verify(self, found: DataFrame, number: int) -> DataFrame:
        spark = self.spark
        # History and the new run lie in the same buckets: a merge join by fingerprint moves no row.
        runs = spark.table(self.runs)
        per = runs.groupBy("fp").agg(F.count("*").alias("rows"), F.min("o").alias("a"), F.max("o").alias("b"), F.max("run").alias("newest"), F.max("more").alias("more"))
        per = per.filter((F.col("newest") == number) & ((F.col("rows") > 1) & (F.col("a") < F.col("b")) | F.col("more"))).select("fp")
        met = runs.join(per.hint("merge"), "fp", "left_semi")
        every = met.groupBy("fp", "digest").agg(*_first(), F.max(F.when(F.col("run") < number, F.lit(True)).otherwise(False)).alias("old"), (F.max("more") | (F.max("o") > F.min("o"))).alias("more"))
        every = materialize(every, "every")
        # Fingerprints of several kinds, not all of one document: of each kind its earliest document
        # asks, with all its places, if it is new, and one place of it is evidence for the others.
        several = every.groupBy(F.col("fp").alias("_s")).agg(F.count("*").alias("kinds"), F.min("o").alias("a"), F.max("o").alias("b")).filter("kinds > 1 AND a < b").select("_s")
        k = every.join(several, F.col("fp") == F.col("_s"), "left").withColumn("several", F.col("_s").isNotNull()).filter("several OR more")
        k = materialize(k.select("fp", "digest", "o", "t", "at", "old", "several"), "several")
        discard(spark, every)
        kk = k.select(F.col("fp").alias("_f"), F.col("digest").alias("_d"), F.col("o").alias("o0"), "several")
        hits = found.join(kk, (F.col("fp") == F.col("_f")) & (F.col("digest") == F.col("_d"))).filter("o > o0 OR o = o0 AND several")
        hits = materialize(hits.select("fp", "o", "t", "at", (F.col("o") > F.col("o0")).alias("gone")), "hits")
        discard(spark, found)
        release(spark)
        evidence = k.filter("several AND old").select("fp", "o", "t", "at", F.lit(False).alias("new"))
        asks = hits.filter("NOT gone").select("fp", "o", "t", "at", F.lit(True).alias("new")).unionByName(evidence)
        lists = asks.groupBy(F.col("o").alias("_o"), F.col("t").alias("_t")).agg(F.max("new").alias("new"), F.collect_list(F.struct("fp", "at")).alias("wants"))
        lists = materialize(lists, "wants")
        discard(spark, k)
        release(spark)
        own = (F.col("o") == F.col("_o")) & (F.col("t") == F.col("_t"))
        # Texts stay in their buckets; only the lists move.
        each = spark.table(self.docs).join(lists.repartition(self.buckets, "_o", "_t").hint("merge"), own).select("o", "t", "text", "wants", "new").mapInArrow(_windows, _WINDOW)
        each = materialize(each, "windows")
        discard(spark, lists)
        release(spark)
        firsts = each.groupBy("fp", "place", "h").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter("first < last").drop("last")
        single = each.filter("new").join(firsts, ["fp", "place", "h"]).filter(F.col("o") > F.col("first")).select("o", "t", "start", F.lit(1).alias("n"))
        whole = hits.filter("gone").select("o", "t", F.expr(f"cast(at div {_START} as int)").alias("start"), F.expr(f"cast(at % {_PLACE} as int)").alias("n"))
        out = whole.unionByName(single).groupBy("o", "t").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
        out = materialize(out, "repeats")
        for done in (hits, each):
            discard(spark, done)
        release(spark)
        return out

    def compact(self) -> None:
        """Merge runs while ``FAN_IN`` of them share a level: each kind keeps its earliest place."""
        while True:
            levels = self.levels()
            full = next((at for at, _ in levels if sum(x == at for x, _ in levels) >= FAN_IN), None)
            if full is None:
                return
            runs = [r for at, r in levels if at == full]
            rows = self.spark.table(self.runs).filter((F.col("level") == full) & F.col("run").isin(runs))
            # Buckets hold all rows of their fingerprints, so neither grouping nor writing moves a row.
            merged = rows.groupBy("fp", "digest").agg(*_first(), (F.max("more") | (F.max("o") > F.min("o"))).alias("more"))
            merged = merged.select(*_KIND, F.lit(full + 1).alias("level"), F.lit(max(runs)).alias("run"))
            merged.write.insertInto(self.runs)
            for run in runs:
                self.spark.sql(f"ALTER TABLE {self.runs} DROP PARTITION (level = {full}, run = {run})")
                remove(self.spark, f"{self.path}/runs-{self.buckets}/level={full}/run={run}")


def _trim(batches, names):
    """Cut the words of the windows in ``spans`` (first window, number of windows) out of each text."""
    for batch in batches:
        texts, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        kept_texts, totals, removed = [], [], []
        for text, cut in zip(texts, spans, strict=True):
            words = (text.as_py() or "").encode().split()
            total = len(words)
            if cut.is_valid and len(cut):
                gone = np.zeros(total + 1, np.int32)
                at, n = (cut.values.field(i).to_numpy() for i in (0, 1))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + n - 1 + WINDOW, -1)
                words = list(compress(words, (np.cumsum(gone[:-1]) == 0).tolist()))
            kept_texts.append(b" ".join(words).decode())
            totals.append(total)
            removed.append(total - len(words))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(kept_texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=names)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", batches: int = BATCHES, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with ``kept_text, n_words, n_removed``.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller
    key.  A null key counts as larger than all others; rows of equal keys do not cover each other.
    Null texts have no words.  Kept words are joined by one space.  Added names that clash with
    kept columns get a leading underscore.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    ins = [F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)]
    keyed = docs.select(*_keys(docs, key, text), F.col(text).cast("string").alias("text"), *ins)
    cuts = [k / batches for k in range(1, batches)]
    marks = keyed.select(F.percentile_approx("o", F.array(*map(F.lit, cuts)))).first()[0] if cuts else []
    marks = sorted(set(marks or []))
    index = FingerprintIndex(spark, scratch_path(spark, "index"), _ddl(keyed.select([f"in_{i}" for i in range(len(keep))])))
    found = None
    for low, high in zip([None, *marks], [*marks, None], strict=True):
        batch = keyed
        batch = batch if low is None else batch.filter(F.col("o") > low)
        batch = batch if high is None else batch.filter(F.col("o") <= high)
        repeats = index.add(batch)
        found = repeats if found is None else found.unionByName(repeats)
    remove(spark, f"{index.path}/runs-{index.buckets}")
    found = found.withColumnsRenamed({"o": "_o", "t": "_t"}).repartition(index.buckets, "_o", "_t").hint("merge")
    rows = spark.table(index.docs).join(found, (F.col("o") == F.col("_o")) & (F.col("t") == F.col("_t")), "left")
    out = free_name(docs.select(*keep), "kept_text", "n_words", "n_removed")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.LongType()), T.StructField(out[2], T.LongType())])
    return rows.select(*[f"in_{i}" for i in range(len(keep))], "text", "spans").mapInArrow(lambda it: _trim(it, schema.names), schema)


def op7_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return trimmed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first_doc FROM win GROUP BY g),
bad AS (SELECT doc_id, i FROM win JOIN f USING (g) WHERE doc_id > first_doc),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM bad, (SELECT unnest(range(13)) AS o)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
