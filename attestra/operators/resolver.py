"""The evidence resolver: weigh evidence per candidate value, choose the best or abstain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import authority as A
from ..functions import normalize as N
from .metrics import ratio

# Least support, confidence and margin per attribute.
MIN_SUPPORT = {"website": 0.65, "category": 0.65, "name": 0.60, "phone": 0.55, "address": 0.55}
MIN_CONFIDENCE = {"website": 0.58, "category": 0.60, "name": 0.58, "phone": 0.55, "address": 0.55}
MIN_MARGIN = {"website": 0.08, "category": 0.08, "name": 0.06, "phone": 0.05, "address": 0.05}
NO_MATCH = "No evidence matched candidate values."
WEAK_SUPPORT = "Best evidence support is below the minimum authority threshold; abstaining."
TIED = "Evidence is too weak or tied; abstaining."
#: Sums of scores are rounded to so many places before they are compared, so the order of addition cannot matter.
PLACES = 9


def score_values(evidence: DataFrame) -> DataFrame:
    """Evidence ``case_id, attribute, ordinal, extracted_value, source_type, ...`` with ``norm`` and ``score``."""
    score = A.evidence_score(F.col("source_type"), F.col("recency_days"), F.col("zombie_score"), F.col("identity_change_score"))
    return evidence.withColumn("norm", N.normalize(F.col("attribute"), F.col("extracted_value"))).withColumn("score", score)


def resolve(cases: DataFrame, candidates: DataFrame, evidence: DataFrame, min_confidence: float = 0.55, min_support: float = 0.55) -> DataFrame:
    """One decision per row of ``cases (case_id, attribute)``.

    ``candidates``: ``case_id, attribute, value, ordinal`` (of equal normal forms, the last value is
    reported); ``evidence`` as for ``score_values``.  Evidence only counts for values among the
    candidates.  Best and second value come from one aggregation per case, as the two greatest of
    an array of sums, so no window over cases is needed.
    """
    norm = N.normalize(F.col("attribute"), F.col("value"))
    options = candidates.filter(N.text(F.col("value")) != "").withColumn("norm", norm).groupBy("case_id", "attribute", "norm").agg(F.max_by("value", "ordinal").alias("value"))
    matched = score_values(evidence).filter("norm != ''").join(options, ["case_id", "attribute", "norm"])
    sums = matched.groupBy("case_id", "attribute", "norm").agg(
        F.round(F.sum("score"), PLACES).alias("s"), F.max("score").alias("top"), F.count("*").alias("items"), F.min("ordinal").alias("seen"), F.first("value").alias("value")
    )
    per = _ranked(sums.groupBy("case_id", "attribute").agg(F.round(F.sum("s"), PLACES).alias("total"), F.array_sort(F.collect_list(_entry())).alias("v")))
    return _decided(cases.select("case_id", "attribute").join(per, ["case_id", "attribute"], "left"), min_confidence, min_support)


def _entry() -> Column:
    """A value of a case, so that the best comes first: the greatest sum, the first seen."""
    return F.struct((-F.col("s")).alias("minus"), "seen", "value", "norm", "s", "top", "items")


def _ranked(per: DataFrame, *keep: str) -> DataFrame:
    """Best value, confidence and margin of cases with sorted entries ``v`` and the sums' ``total``."""
    best, second = F.get("v", F.lit(0)), F.coalesce(F.get("v", F.lit(1))["s"], F.lit(0.0))
    return per.select("case_id", "attribute", *keep, best["value"].alias("value"), best["top"].alias("top"), best["items"].alias("items"),
                      ratio(best["s"], F.col("total")).alias("confidence"), F.round(best["s"] - second, PLACES).alias("margin"))


def _decided(out: DataFrame, min_confidence: float, min_support: float, *keep: str) -> DataFrame:
    floor = lambda table, least: F.greatest(F.lit(least), A.look_up(F.col("attribute"), table, least))
    weak = F.col("top") < floor(MIN_SUPPORT, min_support)
    tied = (F.col("confidence") < floor(MIN_CONFIDENCE, min_confidence)) | (F.col("margin") <= A.look_up(F.col("attribute"), MIN_MARGIN, 0.0))
    reason = F.when(F.col("top").isNull(), NO_MATCH).when(weak, WEAK_SUPPORT).when(tied, TIED)
    chosen = F.concat(F.lit("Selected value supported by "), F.col("items").cast("string"), F.lit(" evidence item(s)."))
    return out.select(
        "case_id", "attribute", *keep, F.when(reason.isNull(), F.col("value")).otherwise("").alias("decision"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        reason.isNotNull().alias("abstained"), F.coalesce(reason, chosen).alias("reason"), F.coalesce("items", F.lit(0)).alias("supporting"),
    )


def resolve_pages(pages: DataFrame, given: list[Column], min_confidence: float = 0.55, min_support: float = 0.55) -> DataFrame:
    """Decisions of ``resolve`` where all values of the evidence are candidates, and ``given`` ones before them.

    ``pages``: evidence rows of all cases, those that only name their case with a null ``ordinal``;
    ``given``: candidate values of a case in order, the same on each of its rows.  All is aggregated by case, with no
    join, so rows that come dealt by case are not exchanged.  Decisions also have ``gold_values``, the distinct ones of the case (structs, as a value may be null).
    """
    norm = lambda v: N.normalize(F.col("attribute"), v)
    rows = score_values(pages).withColumn("_e", F.col("ordinal").isNotNull() & (F.col("norm") != ""))
    when = lambda c: F.when(F.col("_e"), F.col(c))
    valued = F.when(F.col("_e") & (N.text(F.col("extracted_value")) != ""), F.col("ordinal"))
    sums = rows.withColumn("_g", F.array(*map(N.text, given))).groupBy("case_id", "attribute", F.when(F.col("_e"), F.col("norm")).alias("norm")).agg(
        F.round(F.sum(when("score")), PLACES).alias("s"), F.max(when("score")).alias("top"), F.count(when("score")).alias("items"), F.min(when("ordinal")).alias("seen"),
        F.min_by("extracted_value", valued).alias("value"), F.first("_g").alias("_g"), F.collect_set(F.struct("gold_value")).alias("gold"),
    )
    real = F.col("norm").isNotNull()
    per = sums.groupBy("case_id", "attribute").agg(
        F.round(F.sum(F.when(real, F.col("s"))), PLACES).alias("total"), F.collect_list(F.when(real, _entry())).alias("v"), F.first("_g").alias("_g"), F.array_distinct(F.flatten(F.collect_list("gold"))).alias("gold_values")
    )
    # A given value stands for its normal form; normal forms of given values are made once a case.
    per = per.withColumn("_g", F.filter(F.transform("_g", lambda g: F.struct(g.alias("value"), norm(g).alias("norm"))), lambda o: o["value"] != ""))
    mine = lambda e: F.get(F.filter("_g", lambda o: o["norm"] == e["norm"]), F.lit(0))["value"]
    per = per.withColumn("v", F.array_sort(F.transform("v", lambda e: e.withField("value", F.coalesce(mine(e), e["value"])))))
    return _decided(_ranked(per, "gold_values"), min_confidence, min_support, "gold_values")


def decision_metrics(decisions: DataFrame, gold: DataFrame | None = None, threshold: float = 0.75) -> DataFrame:
    """Per attribute and overall (``attribute`` null): counts and rates over cases with gold values.

    Without ``gold``, decisions have their ``gold_value``.  One GROUPING SETS aggregation gives both levels.
    """
    rows = decisions if gold is None else decisions.join(gold.select("case_id", "attribute", "gold_value"), ["case_id", "attribute"])
    g, d = N.normalize(F.col("attribute"), F.col("gold_value")), N.normalize(F.col("attribute"), F.col("decision"))
    has = g != ""
    right = has & (d != "") & (d == g) & ~F.col("abstained")
    wrong = has & ~right & ~F.col("abstained") & (F.col("confidence") >= threshold)
    flags = rows.select("attribute", has.cast("int").alias("has"), right.cast("int").alias("right"), F.col("abstained").cast("int").alias("abstained"), wrong.cast("int").alias("wrong"))
    out = flags.rollup("attribute").agg(F.count("*").alias("total"), F.sum("has").alias("gold_total"), F.sum("right").alias("correct"), F.sum("abstained").alias("abstained"), F.sum("wrong").alias("high_confidence_wrong"))
    return out.select(
        F.coalesce("attribute", F.lit("(all)")).alias("attribute"), "total", "gold_total", "correct", "abstained", "high_confidence_wrong",
        ratio(F.col("correct"), F.col("gold_total")).alias("accuracy"), ratio(F.col("abstained"), F.col("total")).alias("abstention_rate"),
        ratio(F.col("high_confidence_wrong"), F.col("gold_total")).alias("high_confidence_wrong_rate"),
    )
