"""Prior results, golden values in literal form, the replay benchmark and small row rules around them."""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import authority as A
from ..functions import normalize as N
from ..functions import pagetext as P
from . import queryplan, replay, resolver
from .metrics import ratio

# Raw columns of golden files, and the columns of an evidence template.
GOLDEN_COLUMNS = {"name": "names", "category": "categories", "website": "websites", "phone": "phones", "address": "addresses"}
TEMPLATE = ["case_id", "attribute", "layer", "query", "url", "title", "page_text", "source_type", "extracted_value", "notes"]


# ------------------------------------------------------------------ prior results


def canonical_rows(truth: DataFrame, predictions: DataFrame, subset: str = "website", limit: int | None = None) -> DataFrame:
    """One wide row per id: source, value, prediction and confidence of every attribute.

    ``truth``: ``id, attribute, source, value``; ``predictions``: ``id, attribute, prediction,
    ordinal``.  Ids are those predicted for ``subset`` (the first ``limit`` by ordinal, if given)
    that have truth; a missing prediction is blank, with confidence 0.0.  Both tables meet in one
    grouped aggregation instead of a join per attribute.
    """
    ids = predictions.filter(F.col("attribute") == subset).groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    ids = ids if limit is None else ids.orderBy("ordinal").limit(limit)
    known = truth.select("id", "attribute", N.text(F.col("source")).alias("source"), N.text(F.col("value")).alias("value"), F.lit("").alias("prediction"), F.lit(1).alias("known"))
    said = predictions.select("id", "attribute", F.lit("").alias("source"), F.lit("").alias("value"), N.text(F.col("prediction")).alias("prediction"), F.lit(0).alias("known"))
    pick = lambda a, c: F.coalesce(F.max(F.when(F.col("attribute") == a, F.col(c))), F.lit(""))
    cells = []
    for a in N.ATTRIBUTES:
        cells += [pick(a, "source").alias(f"{a}_truth"), pick(a, "value").alias(f"{a}_truth_value"), pick(a, "prediction").alias(f"{a}_prediction")]
    wide = known.unionByName(said).groupBy("id").agg(F.max("known").alias("known"), *cells).filter("known = 1").drop("known")
    sure = {f"{a}_confidence": F.when(F.col(f"{a}_prediction") != "", "1.0").otherwise("0.0") for a in N.ATTRIBUTES}
    return wide.withColumns(sure).join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")


def website_accuracy(rows: DataFrame) -> DataFrame:
    """Share of website rows whose ``predicted_value`` is ``truth_value``; 0 without any."""
    right = N.text(F.col("predicted_value")) == N.text(F.col("truth_value"))
    out = rows.filter(F.col("attribute") == "website").agg(F.count("*").alias("website_rows"), F.coalesce(F.sum(right.cast("int")), F.lit(0)).alias("right"))
    return out.select(F.coalesce(ratio(F.col("right"), F.col("website_rows")), F.lit(0.0)).alias("website_accuracy"), "website_rows")


# ------------------------------------------------------------------ golden values


def _structure(text: str):
    """A text as JSON, as a Python literal, or as it is."""
    for parse in (json.loads, ast.literal_eval):
        try:
            return parse(text)
        except (ValueError, SyntaxError):
            continue
    return text


def _golden(attribute: str, text: str | None) -> str:
    found = _structure(text) if text else None
    several = attribute in ("website", "phone", "address")
    if several and isinstance(found, list):
        items = (x.get("freeform") if attribute == "address" and isinstance(x, dict) else x for x in found)
        found = next((x for x in items if x), None)
    elif not several and isinstance(found, dict):
        found = found.get("primary")
    return str(found) if found else ""


def golden_value(attribute: str, column: Column) -> Column:
    """An attribute's value from a golden file's cell: JSON, a Python literal or plain text.

    Lists give their first item that is not empty, objects their ``primary`` (an address its
    ``freeform``).  Literals of Python have no native parser, so this is an Arrow UDF.
    """
    if attribute not in GOLDEN_COLUMNS:
        raise ValueError(f"unknown attribute {attribute!r}")

    @F.arrow_udf("string")
    def parse(cells: pa.Array) -> pa.Array:
        return pa.array([_golden(attribute, c) for c in cells.to_pylist()], pa.string())

    return parse(column)


# ------------------------------------------------------------------ replay benchmark


def benchmark_rows(pages: DataFrame) -> DataFrame:
    """One row per episode: the resolver's decision on extracted values, against the gold value.

    Candidates are the gold value and what pages extracted.  The selected page is the first, by
    attempt and page, of those that support the best value, also where the resolver abstains.
    """
    valued = pages.filter(F.col("page").isNotNull() & (N.text(F.col("extracted_value")) != ""))
    valued = valued.withColumn("ordinal", (F.col("attempt") * 100_000 + F.col("page")).cast("long"))
    heads = pages.groupBy(*replay.EPISODE).agg(F.first("gold_value").alias("gold_value"))
    every = heads.select(*replay.EPISODE, N.text(F.col("gold_value")).alias("value"), F.lit(-1).cast("long").alias("ordinal"))
    every = every.unionByName(valued.select(*replay.EPISODE, F.col("extracted_value").alias("value"), "ordinal"))
    every = every.withColumn("norm", N.normalize(F.col("attribute"), F.col("value"))).filter("norm != ''")
    candidates = every.groupBy(*replay.EPISODE, "norm").agg(F.min_by("value", "ordinal").alias("value"), F.min("ordinal").alias("ordinal")).drop("norm")
    decisions = resolver.resolve(heads.select(*replay.EPISODE), candidates, valued)
    # The best value is the one with the greatest sum; its first page is found in one more pass.
    scored = resolver.score_values(valued).filter("norm != ''")
    per = scored.groupBy(*replay.EPISODE, "norm").agg(F.round(F.sum("score"), resolver.PLACES).alias("s"), F.min(F.struct("ordinal", "source_type", "url")).alias("first"))
    best = per.groupBy(*replay.EPISODE).agg(F.min(F.struct((-F.col("s")).alias("m"), F.col("first.ordinal").alias("o"), "first"))["first"].alias("page"))
    items = valued.groupBy(*replay.EPISODE).agg(F.count("*").alias("evidence_items"))
    rows = decisions.join(heads, replay.EPISODE).join(best, replay.EPISODE, "left").join(items, replay.EPISODE, "left")
    gold, said = N.normalize(F.col("attribute"), F.col("gold_value")), N.normalize(F.col("attribute"), F.col("decision"))
    correct = (F.col("decision") != "") & (N.text(F.col("gold_value")) != "") & (gold == said)
    return rows.select(
        *replay.EPISODE, "gold_value", F.col("decision").alias("prediction"), correct.alias("correct"), "abstained", "confidence", "reason", F.coalesce("evidence_items", F.lit(0)).alias("evidence_items"),
        N.text(F.col("page.source_type")).alias("selected_source_type"), N.text(F.col("page.url")).alias("selected_url"),
    )


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """Counts and rates of ``benchmark_rows``, over all episodes and over websites, in one aggregation."""
    tried, site = ~F.col("abstained"), F.col("attribute") == "website"
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    out = rows.agg(
        F.count("*").alias("episodes"), count(tried).alias("attempted"), count(tried & F.col("correct")).alias("right"),
        count(site).alias("website_episodes"), count(site & tried).alias("website_attempted"), count(site & tried & F.col("correct")).alias("website_right"),
    )
    rate = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return out.select(
        "episodes", "attempted", (F.col("episodes") - F.col("attempted")).alias("abstained"), rate("attempted", "episodes").alias("coverage"), rate("right", "attempted").alias("accuracy_when_attempted"),
        rate("right", "episodes").alias("end_to_end_accuracy"), "website_episodes", "website_attempted", rate("website_right", "website_attempted").alias("website_accuracy_when_attempted"),
    )


# ------------------------------------------------------------------ plans and pages


def measured_weights(plans: DataFrame) -> DataFrame:
    """``attribute, weight`` from audited gap plans ``attribute, authority_coverage``.

    A weight is the mean coverage.  Websites without any weigh 1, categories then as websites, 0.75
    at most; names never weigh.
    """
    mean = lambda a: F.coalesce(F.avg(F.when(F.col("attribute") == a, F.col("authority_coverage"))), F.lit(0.0))
    both = plans.agg(mean("website").alias("w"), mean("category").alias("c"))
    both = both.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    both = both.withColumn("c", F.when(F.col("c") > 0, F.col("c")).otherwise(F.least("w", F.lit(0.75))))
    return both.select(F.explode(F.create_map(F.lit("website"), F.col("w"), F.lit("category"), F.col("c"), F.lit("name"), F.lit(0.0))).alias("attribute", "weight"))


def evidence_template(rows: DataFrame) -> DataFrame:
    """One row per (case, attribute) to fill in: the query of the best layer, blank evidence columns."""
    layer = A.look_up(F.col("layer"), queryplan.LAYER_ORDER, 99).cast("int")
    best = rows.groupBy("case_id", "attribute").agg(F.min(F.struct(layer.alias("l"), N.text(F.col("query")).alias("query"), N.text(F.col("layer")).alias("layer"))).alias("b"))
    given = {"case_id": F.col("case_id"), "attribute": F.col("attribute"), "layer": F.col("b.layer"), "query": F.col("b.query")}
    return best.select(*[given.get(c, F.lit("")).alias(c) for c in TEMPLATE])


def rewrite_notes(notes: Column, status: Column, http_status: Column, error: Column) -> Column:
    """Notes with older fetch results taken out and the newest put last."""
    kept = N.text(notes)
    for field in ("fetch_status", "http_status", "fetch_error", "curl_error"):  # fixed values
        kept = F.btrim(F.regexp_replace(kept, f";? ?{field}=[^;]+", ""), F.lit("; "))
    part = lambda name, c: F.when(N.text(c) != "", F.concat(F.lit(f"{name}="), N.text(c)))
    return F.concat_ws("; ", F.nullif(kept, F.lit("")), F.concat(F.lit("fetch_status="), N.text(status)), part("http_status", http_status), part("fetch_error", error))


def rerank_by_hash(rows: DataFrame) -> DataFrame:
    """``query, candidate, ordinal`` with ``score`` and ``rank`` from 1: the offline stand-in of a reranking model."""
    score = P.hash_score(F.concat(N.text(F.col("query")), F.lit("\n"), N.text(F.col("candidate"))))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "ordinal")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def batch_progress(batch_rows: DataFrame, evidenced: DataFrame) -> DataFrame:
    """Per ``batch``: its (case, attribute) pairs, how many have evidence, and the share."""
    have = evidenced.select(F.col("case_id").alias("_c"), F.col("attribute").alias("_a")).distinct()
    cases = batch_rows.select("batch", "case_id", "attribute").distinct()
    met = cases.join(have, (F.col("case_id") == F.col("_c")) & (F.col("attribute") == F.col("_a")), "left")
    out = met.groupBy("batch").agg(F.count("*").alias("cases"), F.count("_c").alias("evidenced"))
    return out.withColumn("share", ratio(F.col("evidenced"), F.col("cases")))
