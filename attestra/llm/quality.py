"""op3 -- quality by a document classifier shrunk through hosts and paths (empirical Bayes).

1. A document classifier, fitted on a bounded sample of labelled rows, turns whole-text statistics
   into a probability.
2. Grouped sums of those probabilities give each host, and each path below it, a rate.  Between-group
   variance over all hosts (then paths) sets how many documents' worth the level above counts
   (method of moments), so sparse sites stay near the global prior and large ones speak for
   themselves.
3. A document's score is its own evidence (log odds against the global rate) on top of the shrunk
   rate of its path, with its own share taken out of the site's sums first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, free_name, lower_ascii, materialize, prefix_hash, shingle_hashes, span_hash, table, text_blocks, word_spans
from .linear import fit_logistic, sigmoid

#: Labelled rows the classifier is fitted on, at most.
SAMPLE_ROWS = 8000
BINS = 8
#: A document is kept at this score or more.
KEEP_SCORE = 0.5

# Byte classes that are counted per text.
_CLASS = np.zeros(256, np.int64)
_CLASS[0x80:] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[[0x20, 0x09]] = 5
_CLASS[[0x0A, 0x0D]] = 6
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 7
_CLASS[ord("!")] = 8
_CLASS[[ord(c) for c in "#$%&*@^~+=_"]] = 9
_CLASS[[ord(c) for c in "|<>[]{}\\/"]] = 10
_N_CLASS = 11
#: Names of the statistics, in order.
FEATURES = [
    "log_words", "word_length", "non_ascii", "lower", "upper", "digit", "blank", "newline", "stop", "bang", "symbol", "frame", "control",
    "distinct_words", "distinct_trigrams", "repeats", "top_word", "words_a_line", "plain_words",
]


def _per_row(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    return counts / np.maximum(total, 1)


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys per row, and the count of each row's commonest key."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])] if len(r) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(r)])
    top = np.zeros(n)
    np.maximum.at(top, r[starts], sizes)
    return np.bincount(r[starts], minlength=n).astype(float), top


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; null and empty texts give zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, data, offsets in text_blocks(column):
        n = len(offsets) - 1
        size = np.diff(offsets)
        row_of = np.repeat(np.arange(n) * _N_CLASS, size)
        classes = np.bincount(row_of + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
        starts, ends, at = word_spans(data, offsets)
        words = np.diff(at)
        rows = np.repeat(np.arange(n), words)
        hashes = span_hash(prefix_hash(lower_ascii(data)), starts, ends)
        same = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
        distinct, top = _distinct(rows, hashes, n)
        tri = shingle_hashes(hashes, 3)
        whole = rows[2:] == rows[:-2] if len(rows) > 2 else np.zeros(0, bool)
        tri_rows = rows[: len(tri)][whole]
        distinct_tri, _ = _distinct(tri_rows, tri[whole], n)
        tail = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
        plain = np.bincount(rows, weights=np.isin(_CLASS[tail], (1, 2)), minlength=n)
        f = out[first : first + n]
        f[:, 0] = np.log1p(words)
        f[:, 1] = _per_row(np.bincount(rows, weights=ends - starts, minlength=n), words)
        f[:, 2:12] = _per_row(classes[:, 1:], size[:, None])
        f[:, 12] = _per_row(classes[:, 0], size)
        f[:, 13] = _per_row(distinct, words)
        f[:, 14] = _per_row(distinct_tri, np.bincount(tri_rows, minlength=n))
        f[:, 15] = _per_row(np.bincount(rows[1:][same], minlength=n), words)
        f[:, 16] = _per_row(top, words)
        f[:, 17] = np.log1p(_per_row(words, classes[:, 6] + 1))
        f[:, 18] = _per_row(plain, words)
    return out


class AdditiveModel:
    """Logistic regression on quantile bins of every statistic, so effects need not be linear."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0) if len(x) else np.zeros((BINS - 1, len(FEATURES)))
        self.cuts = cuts.T.copy()
        self.mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        if len(x) and 0 < y.sum() < len(y):
            self.weights, self.bias = fit_logistic(self.bins(x), y, l2=1.0, steps=500)
        else:
            self.weights, self.bias = np.zeros(BINS * len(FEATURES)), float(np.log(self.mean / (1 - self.mean)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), x.shape[1] * BINS))
        for j, cuts in enumerate(self.cuts):
            out[np.arange(len(x)), j * BINS + np.searchsorted(cuts, x[:, j])] = 1
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, cuts in enumerate(self.cuts):
            total += self.weights[j * BINS + np.searchsorted(cuts, x[:, j])]
        return sigmoid(total)


def fit_classifier(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on at most ``rows`` labelled documents, those with the smallest hashed keys.

    Keys whose crc32 mod 5 is 0 are held out.  Labels other than 0 and 1, and of null keys, are
    ignored.  With one class only, the model gives that class's rate for every text.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    ids = usable.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(rows)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("y").cast("double").alias("y"))
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("t")).join(F.broadcast(ids), F.col("_k") == F.col("_id"))  # bounded: ``rows`` rows

    def measure(batches):
        for b in batches:
            x = text_statistics(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "y", "x"])

    got = sample.select("_id", "y", "t").mapInArrow(measure, "_id long, y double, x array<double>")
    got = got.dropDuplicates(["_id"]).orderBy("_id").limit(rows).toPandas()
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, len(FEATURES)))
    return AdditiveModel(x.reshape(-1, len(FEATURES)), got["y"].to_numpy(float))


def classify(docs: DataFrame, model: AdditiveModel, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the classifier's probability of good quality as ``name``; texts stay in the JVM."""

    bound_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(model.probability(text_statistics(texts)))

    return docs.withColumn(name, probability(F.col(text)))


def site_of(source: Column) -> tuple[Column, Column]:
    """Host and path of a source or URL; a null source is a host of its own, a bare name has no path."""
    plain = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    plain = F.regexp_replace(plain, r"[?#].*$", "")
    host = F.lower(F.substring_index(plain, "/", 1))
    path = F.regexp_extract(plain, r"^[^/]*(/.*/|/[^/]*)", 1)
    return host, path


def site_posteriors(scored: DataFrame) -> DataFrame:
    """Per (host, path): sums and the prior each level passes down, from rows ``host, path, p``.

    Returns ``host, path, hn, hs, hk, pn, ps, pk, m``: host sums and strength, path sums and
    strength (path sums are 0 for bare hosts) and the global mean.  Aggregation is partial before
    the shuffle, so a hot host costs one row a task.
    """
    sums = [F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "site-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    overall = hosts.agg((F.sum("s") / F.sum("n")).alias("m"))
    hk = hosts.crossJoin(F.broadcast(overall)).groupBy().agg(F.first("m").alias("m"), _strength().alias("hk"))
    h = hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")).crossJoin(F.broadcast(hk))  # one row
    named = paths.filter("path != ''").join(h.select(F.col("host").alias("_h"), ((F.col("hs") + F.col("hk") * F.col("m")) / (F.col("hn") + F.col("hk"))).alias("m")), F.col("host") == F.col("_h"))
    pk = named.groupBy().agg(_strength().alias("pk"))
    full = paths.join(h.withColumnRenamed("host", "_h"), F.col("host") == F.col("_h")).crossJoin(F.broadcast(pk))
    bare = F.col("path") == ""
    return full.select(
        "host", "path", "hn", "hs", "hk", F.when(bare, 0.0).otherwise(F.col("n")).alias("pn"), F.when(bare, 0.0).otherwise(F.col("s")).alias("ps"),
        F.coalesce("pk", F.lit(1e6)).alias("pk"), "m",
    )


def _strength() -> Column:
    """Documents' worth of the level above: ``m (1 - m) / between - 1`` by the method of moments.

    Aggregates group rows ``n, s, q`` (count, sum and sum of squares of probabilities) with ``m``,
    the rate of the level above.  A group weighs by its documents, whatever their number.  Without
    variance between groups, the level above rules.
    """
    rate = F.col("s") / F.col("n")
    within = F.greatest(F.col("q") / F.col("n") - rate * rate, F.lit(1e-6)) / F.col("n")
    weight = F.col("n")
    between = F.sum(weight * ((rate - F.col("m")) * (rate - F.col("m")) - within)) / F.sum(weight)
    mean = F.sum(weight * F.col("m")) / F.sum(weight)
    return F.least(F.greatest(mean * (1 - mean) / F.greatest(between, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1e6))


def _score(p: Column) -> dict[str, Column]:
    """Posterior columns of a document with probability ``p`` beside its site's sums."""
    host = (F.col("hs") - p + F.col("hk") * F.col("m")) / (F.col("hn") - 1 + F.col("hk"))
    has_path = F.col("pn") > 0
    path = F.when(has_path, (F.col("ps") - p + F.col("pk") * host) / (F.col("pn") - 1 + F.col("pk"))).otherwise(host)
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda x: F.log(clip(x) / (1 - clip(x)))
    score = 1 / (1 + F.exp(-(odds(p) - odds(F.col("m")) + odds(path))))
    return {"host_rate": host, "path_rate": path, "score": score}


#: Sites' rows are broadcast up to this many (about 100 bytes each).
BROADCAST_SITES = 50_000


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``document_score, host_rate, path_rate, score, predicted``.

    ``predicted`` is 1 at ``KEEP_SCORE`` or more.  Null and empty texts are scored by their (zero)
    statistics.  Added names that clash with kept columns get a leading underscore.
    """
    keep = docs.columns if keep is None else keep
    model = fit_classifier(docs, labels, text)
    host, path = site_of(F.col(source))
    names = [f"in_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"), host.alias("host"), path.alias("path"))
    rows = materialize(classify(rows, model, "p").drop("text"), "quality-scored")
    sites = materialize(site_posteriors(rows.select("host", "path", "p")), "quality-sites")
    s = sites.withColumnsRenamed({"host": "_h", "path": "_p"})
    s = F.broadcast(s) if sites.count() <= BROADCAST_SITES else s
    joined = rows.join(s, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")))
    out = free_name(docs.select(*keep), "document_score", "host_rate", "path_rate", "score", "predicted")
    got = _score(F.col("p"))
    return joined.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        F.col("p").alias(out[0]), got["host_rate"].alias(out[1]), got["path_rate"].alias(out[2]), got["score"].alias(out[3]),
        (got["score"] >= KEEP_SCORE).cast("int").alias(out[4]),
    )


def op3_quality_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.withColumn("held_out", F.coalesce(held, F.lit(False)))
