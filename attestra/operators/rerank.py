"""The small logistic reranker: native features, sequential training, native scoring.

Training is online gradient descent over examples in a given order, so it is one task per model
key.  Examples stream through it, sorted by Spark, and wait for later passes in a compressed file of
the task, so their number is not bounded.  Scoring joins no model: weights are a literal map in the expression.
"""

from __future__ import annotations

import itertools
import json
import math
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add, itemgetter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import authority as A
from ..functions import normalize as N

# Words of page texts and paths that are features.
STALE_WORDS = ("former", "formerly", "moved", "closed", "directory", "listing")
PATH_WORDS = ("contact", "about", "locations", "location", "store-locator", "store locator", "directions", "hours", "menu", "services", "home")
TEXT_WORDS = ("contact", "about", "hours", "menu", "services")
RECENT = (30, 90, 180, 365)
ORDER = ("case_id", "attribute", "attempt", "page")


def with_page_features(pages: DataFrame) -> DataFrame:
    """Scored page rows with ``features``, sparse as ``map<string, double>``; zeros are kept out."""
    pairs = [*((n, yes.cast("double")) for n, yes in _page_marks()), *_page_figures()]
    named = [(F.concat(F.lit("source:"), F.col("_kind")), F.lit(1.0)), (F.concat(F.lit("layer:"), N.text(F.col("layer"))), F.lit(1.0)), *((F.lit(n), v) for n, v in pairs)]
    entries = F.filter(F.array(*[F.struct(k.alias("k"), v.alias("v")) for k, v in named]), lambda e: e["v"] != 0)
    return _in_steps(pages).withColumn("features", F.map_from_entries(entries)).drop(*_STEPS)


_STEPS = ("_host", "_path", "_words", "_asked", "_kind")


def _in_steps(pages: DataFrame) -> DataFrame:
    """Pages with what many features are made of.

    It is computed in a step of its own: inside one expression of all features each mention would be
    evaluated again.
    """
    words = F.lower(F.concat_ws(" ", *[F.nullif(N.text(F.col(c)), F.lit("")) for c in ("title", "page_text", "page_text")]))
    made = dict(zip(_STEPS, (N.url_host(F.col("url")), N.url_path(F.col("url")), words, F.lower(N.strip(N.text(F.col("query"))))), strict=False))
    return pages.withColumns(made).withColumn("_kind", A.classify_site(F.col("_host"), F.col("_path")))


def _page_marks() -> list[tuple[str, Column]]:
    """Features that are 1 or 0, as conditions on the columns of ``_in_steps``."""
    host, path, words, asked, kind = map(F.col, _STEPS)
    days = F.greatest(F.col("recency_days"), F.lit(0.0))
    marks = {f"url:{name}": kind == value for name, value in (("official_site", "official_site"), ("government", "government"), ("registry", "business_registry"), ("aggregator", "aggregator"), ("social", "social"))}
    marks["url:site_restricted"] = (host != "") & asked.contains(F.concat(F.lit("site:"), host))
    marks |= {f"text:{w}": words.contains(w) for w in TEXT_WORDS}
    marks |= {
        "text:schema": words.contains("schema.org") | words.contains("ld+json"),
        "text:official": words.contains("official") | asked.contains("official"),
        "text:current": words.contains("current"),
        "text:updated": words.contains("updated"),
        "text:stale": A.any_of(words, STALE_WORDS),
        "text:review": words.contains("review"),
        "text:directory": words.contains("directory") | words.contains("listing"),
        "query:match": (asked != "") & words.contains(asked),
    }
    marks |= {f"path:{w.replace(' ', '_')}": path.contains(w) for w in PATH_WORDS}
    marks["path:root"] = path.isin("", "/", "/index.html", "/index.htm")
    marks |= {f"recency:recent_{d}": F.col("recency_days").isNotNull() & (days <= d) for d in RECENT}
    return [(n, F.coalesce(c, F.lit(False))) for n, c in marks.items()]


def _page_figures() -> list[tuple[str, Column]]:
    """Features that are numbers."""
    norm = F.when(F.col("recency_days").isNotNull(), 1.0 / (1.0 + F.greatest(F.col("recency_days"), F.lit(0.0)))).otherwise(0.0)
    figures = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in ("zombie_score", "identity_change_score")} | {"recency:days_norm": norm}
    return list(figures.items())


def _packed(pages: DataFrame) -> DataFrame:
    """Pages with the same features as ``kind``, ``layer``, ``bits``, which of the others are not 0, and ``values``, the numbers."""
    pairs = [*_page_marks(), *((n, v != 0) for n, v in _page_figures())]
    bits = reduce(add, [F.when(yes, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, (_, yes) in enumerate(pairs)])
    made = {"kind": F.col("_kind"), "layer": N.text(F.col("layer")), "bits": bits, "values": F.array(*[v for _, v in _page_figures()])}
    return _in_steps(pages).withColumns(made).drop(*_STEPS)


_PATTERN = ("bits", "kind", "layer")


def _unpacker() -> Callable[[str], tuple[list[str], list[tuple[int, str]], int]]:
    """Reads ``_PATTERN``, a line each: names of features that are 1, places and names of the numbers, their count."""
    marks, figures = [n for n, _ in _page_marks()], [n for n, _ in _page_figures()]

    def unpack(pattern: str) -> tuple[list[str], list[tuple[int, str]], int]:
        bits, kind, layer = pattern.split("\n", 2)
        on = [int(bits) >> i & 1 for i in range(len(marks) + len(figures))]
        ones = [f"source:{kind}", f"layer:{layer}", *itertools.compress(marks, on)]
        return ones, [(i, n) for i, n in enumerate(figures) if on[len(marks) + i]], len(figures)

    return unpack


def _page_score(bias: float, weights: dict[str, float]) -> Column:
    """``score`` of a page of ``_packed``, without a map of its features."""

    def look_up(name: str, prefix: str) -> Column:
        table = [F.lit(x) for k, w in sorted(weights.items()) if k.startswith(prefix) for x in (k, w)]
        return F.coalesce(F.try_element_at(F.create_map(*table), F.concat(F.lit(prefix), F.col(name))), F.lit(0.0)) if table else F.lit(0.0)

    z = F.lit(float(bias)) + look_up("kind", "source:") + look_up("layer", "layer:")
    for i, (n, _) in enumerate(_page_marks()):
        if n in weights:
            z = z + F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.lit(weights[n])).otherwise(0.0)
    for i, (n, _) in enumerate(_page_figures()):
        if n in weights:
            z = z + F.get("values", i) * F.lit(weights[n])
    return 1.0 / (1.0 + F.exp(-z))


def with_conflict_features(rows: DataFrame) -> DataFrame:
    """Queued query rows with ``features``, made in steps as in ``with_page_features``."""
    low = {f"_{c}": F.lower(N.strip(N.text(F.col(c)))) for c in ("attribute", "priority", "layer", "query", "preferred_sources", "current_value", "base_value", "truth", "truth_source", "prediction")}
    sites = {"_current_site": N.url_host(F.col("_current_value")), "_base_site": N.url_host(F.col("_base_value")), "_truth_site": N.url_host(F.col("_truth"))}
    asked = {f"{c}_asked": F.col(c).contains(".") & F.col("_query").contains(F.col(c)) for c in sites}
    steps = rows.withColumns(low).withColumns(sites).withColumns(asked)
    return steps.withColumn("features", _conflict_features()).drop(*low, *sites, *asked)


def _conflict_features() -> Column:
    """Sparse features of a queued query row, from the columns of ``with_conflict_features``."""
    attribute, priority, layer, query, sources = (F.col(f"_{c}") for c in ("attribute", "priority", "layer", "query", "preferred_sources"))
    current, base = F.col("_current_value"), F.col("_base_value")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    host = lambda name: F.col(f"_{name}_site").contains(".")
    asked = lambda name: F.col(f"_{name}_site_asked")
    like = lambda c: c.contains(".") & ~c.contains(" ")
    pairs = [(F.concat(F.lit("attr:"), attribute), yes(attribute != "")), (F.concat(F.lit("priority:"), priority), yes(priority != "")), (F.concat(F.lit("layer:"), layer), yes(layer != ""))]
    named = {
        "query:official": query.contains("official"),
        "query:site_restricted": query.contains("site:"),
        "query:quoted_anchor": F.length(query) - F.length(F.replace(query, F.lit('"'), F.lit(""))) >= 2,
        "query:authority": A.any_of(query, ("contact", "about", "locations", "store", "schema.org", "registry", "permit", "license")),
        "query:freshness": A.any_of(query, ("current", "updated", "hours", "open now", "now open", "latest")),
        "query:fallback": layer == "fallback",
        "source_pref:official_site": sources.contains("official_site"),
        "source_pref:government": sources.contains("government"),
        "source_pref:registry": sources.contains("business_registry"),
        "source_pref:corroboration": A.any_of(sources, ("google_places", "osm")),
        "value:current_url_like": current.rlike("^https?://"),
        "value:base_url_like": base.rlike("^https?://"),
        "value:current_domain_like": like(current),
        "value:base_domain_like": like(base),
        "value:current_equals_base": (current != "") & (current == base),
        "value:truth_source_present": F.col("_truth_source") != "",
        "value:prediction_present": F.col("_prediction") != "",
        "domain:current_present": host("current"),
        "domain:base_present": host("base"),
        "domain:truth_present": host("truth"),
        "domain:query_current": asked("current"),
        "domain:query_base": asked("base"),
        "domain:query_truth": asked("truth"),
        "domain:query_any_candidate": asked("current") | asked("base") | asked("truth"),
    }
    pairs += [(F.lit(k), yes(v)) for k, v in named.items()]
    pairs += [(F.lit("value:current_len_norm"), 1.0 / (1.0 + F.length(current))), (F.lit("value:base_len_norm"), 1.0 / (1.0 + F.length(base)))]
    entries = F.filter(F.array(*[F.struct(k.alias("k"), v.cast("double").alias("v")) for k, v in pairs]), lambda e: e["v"] != 0)
    return F.map_from_entries(entries)


def train(examples: DataFrame, epochs: int = 25, learning_rate: float = 0.1, l2: float = 0.0) -> DataFrame:
    """``key, bias, weights`` from ``key, ordinal, features, label``, one model per key.

    Passes run in ``ordinal`` order without shuffling; the penalty touches the features present.
    """
    entries = F.coalesce(F.map_entries("features"), F.array().cast("array<struct<key:string,value:double>>"))
    one = lambda e: F.coalesce(e["value"] == 1, F.lit(False))
    ones, others = F.filter(entries, one), F.filter(entries, lambda e: ~one(e))
    pattern = F.to_json(F.struct(ones["key"].alias("ones"), others["key"].alias("others")))
    packed = examples.select("key", "ordinal", pattern.alias("pattern"), others["value"].cast("array<double>").alias("values"), F.col("label").cast("double").alias("label"))
    ordered = packed.repartition("key").sortWithinPartitions("key", "ordinal", "pattern", "label", "values")

    def run(batches):
        model = None
        for batch in batches:
            keys = batch.column(0)
            for lo, hi in itertools.pairwise([0, *_ends(keys)]):
                if model is None or model.key != keys[lo]:
                    if model is not None:
                        yield model.fitted()
                    model = _Model(keys[lo], epochs, learning_rate, l2, _read_names)
                model.learn(batch.slice(lo, hi - lo).select([1, 2, 3]))
        if model is not None:
            yield model.fitted()

    key = examples.schema["key"].dataType.simpleString()
    return ordered.select("key", "pattern", "values", "label").mapInArrow(run, f"key {key}, bias double, weights map<string,double>")


def _blocks(rows: DataFrame) -> DataFrame:
    """``pattern, values, label`` in order of ``ORDER`` (with ``_`` before), packed by all tasks to ``part, n, block``."""

    def pack(batches):
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            held = pa.RecordBatch.from_arrays([batch.column(0).dictionary_encode(), *batch.columns[1:]], names=["pattern", "values", "label"])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(held)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["part", "n", "block"])

    # Ranges of cases that the rows come in stay; parts of a sort are numbered in its order.
    return rows.sort(*[f"_{c}" for c in ORDER], "pattern", "label", "values").select("pattern", "values", "label").mapInArrow(pack, "part int, n int, block binary")


def _train_pages(blocks: DataFrame, epochs: int, learning_rate: float, l2: float) -> DataFrame:
    """``train`` on the pages in ``_blocks``; no row where they are of one class."""
    unpack = _unpacker()

    def run(batches):
        model = _Model(pa.scalar(0), epochs, learning_rate, l2, unpack)
        for blocks in batches:
            for block in blocks.column(0):
                with pa.ipc.open_stream(block.as_buffer()) as stored:
                    for batch in stored:
                        model.learn(batch)
        if len(model.classes) == 2:
            yield model.fitted().select(["bias", "weights"])

    return blocks.repartition(1).sortWithinPartitions("part", "n").select("block").mapInArrow(run, "bias double, weights map<string,double>")


def _read_names(pattern: str) -> tuple[list[str], list[tuple[int, str]], int]:
    names = json.loads(pattern)
    return names["ones"], list(enumerate(names["others"])), len(names["others"])


def _ends(keys: pa.Array) -> list[int]:
    """Ends of the runs of equal values."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return [*(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]


class _Model:
    """One key's weights; examples are learned as they come, and again from a file in each later pass."""

    def __init__(self, key: pa.Scalar, epochs: int, learning_rate: float, l2: float, read: Callable):
        self.key, self.epochs, self.rate, self.l2, self.read = key, epochs, learning_rate, l2, read
        self.bias, self.weights = 0.0, [0.0]  # the first weight is no feature's and stays 0
        self.ids: dict[str, int] = {}  # features, in order of their first example
        self.patterns: list[tuple] = []  # sets of features that occur together: those that are 1, places and ids of others, count of values
        self.known: dict[str, int] = {}
        self.classes: set[float] = set()
        self.file, self.writer = None, None

    def learn(self, batch: pa.RecordBatch) -> None:
        """A batch of ``pattern, values, label``."""
        coded = batch.column(0) if pa.types.is_dictionary(batch.column(0).type) else batch.column(0).dictionary_encode()
        texts = coded.dictionary.to_pylist()
        for text in texts:
            if text not in self.known:
                self.known[text] = len(self.patterns)
                ones, others, width = self.read(text)
                ids = [self.ids.setdefault(n, len(self.ids) + 1) for n in ones]
                self.patterns.append((itemgetter(0, 0, *ids), ids, [(i, self.ids.setdefault(n, len(self.ids) + 1)) for i, n in others], width))
        self.weights += [0.0] * (len(self.ids) + 1 - len(self.weights))
        ours = np.array([self.known[t] for t in texts], np.int32)
        which, values, labels = ours[coded.indices.to_numpy()], batch.column(1).flatten(), batch.column(2)
        self.classes.update(labels.unique().to_pylist())
        self._pass(which.tolist(), values.to_pylist(), labels.to_pylist())
        if self.epochs > 1:
            kept = pa.record_batch([pa.array([which], pa.list_(pa.int32())), pa.ListArray.from_arrays([0, len(values)], values), pa.ListArray.from_arrays([0, len(labels)], labels)], names=["which", "values", "labels"])
            if self.writer is None:
                self.file = tempfile.TemporaryFile()
                self.writer = pa.ipc.new_stream(self.file, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            self.writer.write_batch(kept)

    def _pass(self, which: list[int], values: list[float], labels: list[float]) -> None:
        bias, w, rate, patterns, at, exp = self.bias, self.weights, self.rate, self.patterns, 0, math.exp
        left = 1.0 - rate * self.l2
        for i, y in zip(which, labels, strict=True):
            present, ones, others, width = patterns[i]
            z = sum(present(w), bias)
            for k, f in others:
                z += w[f] * values[at + k]
            step = rate * (y - (1.0 / (1.0 + exp(-z)) if z >= 0 else exp(z) / (1.0 + exp(z))))
            bias += step
            for f in ones:
                w[f] = left * w[f] + step
            for k, f in others:
                w[f] = left * w[f] + step * values[at + k]
            at += width
        self.bias = bias

    def fitted(self) -> pa.RecordBatch:
        if self.writer is not None:
            self.writer.close()
            for _ in range(self.epochs - 1):
                self.file.seek(0)
                with pa.ipc.open_stream(self.file) as stored:
                    for kept in stored:
                        self._pass(*(c.flatten().to_pylist() for c in kept.columns))
            self.file.close()
        kinds = [self.key.type, pa.float64(), pa.map_(pa.string(), pa.float64())]
        made = self.key.as_py(), self.bias, list(zip(self.ids, self.weights[1:], strict=True))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, kinds, strict=True)], names=["key", "bias", "weights"])


def score(features: Column, bias: float, weights: dict[str, float]) -> Column:
    """Probability by a trained model; the model is small (a few dozen names) and becomes a literal."""
    table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv]) if weights else F.lit(None).cast("map<string,double>")
    z = F.aggregate(F.map_entries(features), F.lit(float(bias)), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(table, e["key"]), F.lit(0.0)))
    return 1.0 / (1.0 + F.exp(-z))


def training_examples(scored: DataFrame, key: str = "reranker") -> DataFrame:
    """One example per page of a replay corpus, in order of case, attempt and page; label: it matches gold."""
    rows = with_page_features(scored.filter("page IS NOT NULL"))
    return rows.select(F.lit(key).alias("key"), F.struct(*ORDER).alias("ordinal"), "features", F.col("matches").cast("int").alias("label"), "case_id", "attribute")


def compare(scored: DataFrame, fraction: float = 0.25, epochs: int = 30, learning_rate: float = 0.1, l2: float = 0.001, episodes: DataFrame | None = None) -> DataFrame:
    """Held-out pages with the plain score and the reranked one; empty where training is not possible.

    Training needs both classes and at least two episodes.  ``episodes``: rows to split by, where
    these are cheaper to read than ``scored``.
    """
    from .replay import held_out

    held = held_out(scored if episodes is None else episodes, fraction)
    # Filters on episodes reach the tables: pages of either side are read and dealt once, and only tested ones are scored.
    pages = scored.filter("page IS NOT NULL")
    place = [F.col(c).alias(f"_{c}") for c in ORDER]  # new names: below a view's, Spark doesn't see that the rows come in ranges
    learned = _packed(pages.filter(~held)).select(*place, F.concat_ws("\n", *_PATTERN).alias("pattern"), "values", F.col("matches").cast("double").alias("label"))
    tested = _packed(pages.filter(held)).select(*ORDER, "matches", "score", *_PATTERN, "values").persist(StorageLevel.DISK_ONLY)
    blocks = _blocks(learned).persist(StorageLevel.DISK_ONLY)
    blocks.count()
    with ThreadPoolExecutor(1) as other:  # tested pages are made on the cores that training leaves idle
        made = other.submit(tested.count)
        model = _train_pages(blocks, epochs, learning_rate, l2).first()
        made.result()
    blocks.unpersist()
    if model is None:
        return tested.select(*ORDER, "matches", "score", F.lit(None).cast("double").alias("reranked")).limit(0)
    fresh = 0.4 * F.col("score") + 0.6 * _page_score(model["bias"], model["weights"])
    return tested.select(*ORDER, "matches", "score", F.least(F.lit(1.0), fresh).alias("reranked"))


def balanced_queue(rows: DataFrame, positives: DataFrame) -> DataFrame:
    """Queue rows as examples per attribute, positives repeated to weigh as much as the first negatives.

    ``positives``: ``id, attribute, layer, query`` that led to an authoritative page with the gold value.
    """
    from pyspark.sql import Window

    keys = ["id", "attribute", "layer", "query"]
    hits = positives.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_y", F.lit(1))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    tagged = rows.join(hits, same[0] & same[1] & same[2] & same[3], "left").withColumn("label", F.coalesce("_y", F.lit(0))).drop("_y", *[f"_{k}" for k in keys])
    counts = tagged.groupBy(F.col("attribute").alias("_a")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    counts = counts.filter("pos > 0 AND neg > 0").withColumn("take", F.least("neg", F.greatest(F.col("pos") * 20, F.lit(200))))
    counts = counts.withColumn("times", F.greatest(F.lit(1), F.floor(F.col("take") / F.col("pos")).cast("int")))
    order = Window.partitionBy("attribute", "label").orderBy(*keys)
    placed = tagged.withColumn("_r", F.row_number().over(order)).join(F.broadcast(counts), F.col("attribute") == F.col("_a"))  # a row per attribute
    kept = with_conflict_features(placed.filter((F.col("label") == 1) | (F.col("_r") <= F.col("take"))))
    # A positive's copies follow each other, and negatives follow all copies: ranks need no second sort.
    out = kept.withColumn("_t", F.explode(F.sequence(F.lit(1), F.when(F.col("label") == 1, F.col("times")).otherwise(1))))
    rank = F.when(F.col("label") == 1, (F.col("_r") - 1) * F.col("times") + F.col("_t")).otherwise(F.col("pos") * F.col("times") + F.col("_r"))
    return out.select(F.col("attribute").alias("key"), rank.alias("ordinal"), "features", "label")
