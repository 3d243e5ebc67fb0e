"""Scoring predictions against truths: one conditional aggregation per report, never a loop over attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

HIGH_CONFIDENCE = 0.8


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _outcomes(right: Column, threshold: float) -> tuple[Column, Column, Column]:
    silent = (N.text(F.col("prediction")) == "") | (F.col("prediction") == N.ABSTAIN)
    sure = F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold
    return silent, ~silent & right, ~silent & ~right & sure


def golden_metrics(rows: DataFrame, by: list[str] | None = None, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    """Per group, attribute and scope (``all`` rows, or pairs in ``conflict``): counts and rates.

    Rows: ``attribute, truth, prediction, confidence, pair_differs``; blank truths are left out and
    values are compared in normal form.  Both scopes come from one pass: a conflict row counts
    in an array of two scopes before the partial aggregation.
    """
    by = [*(by or []), "attribute"]
    if {"prediction_norm", "truth_norm"} <= set(rows.columns):
        right = F.col("prediction_norm") == F.col("truth_norm")
    else:
        right = N.normalize(F.col("attribute"), F.col("prediction")) == N.normalize(F.col("attribute"), F.col("truth"))
    silent, good, bad = _outcomes(right, threshold)
    scopes = F.when(F.col("pair_differs"), F.array(F.lit("all"), F.lit("conflict"))).otherwise(F.array(F.lit("all")))
    scored = rows.filter(N.text(F.col("truth")) != "").select(*by, F.explode(scopes).alias("scope"), silent.alias("silent"), good.alias("good"), bad.alias("bad"))
    counts = scored.groupBy(*by, "scope").agg(
        F.count("*").alias("total"), _count(~F.col("silent")).alias("covered"), _count(F.col("good")).alias("correct"), _count(F.col("silent")).alias("abstained"),
        _count(F.col("bad")).alias("high_confidence_wrong"),
    )
    precision, recall = ratio(F.col("correct"), F.col("covered")), ratio(F.col("correct"), F.col("total"))
    return counts.select(
        "*", precision.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"),
        ratio(F.col("covered"), F.col("total")).alias("coverage"), ratio(F.col("abstained"), F.col("total")).alias("abstention_rate"),
        ratio(F.col("high_confidence_wrong"), F.col("covered")).alias("high_confidence_wrong_rate"),
    )


def attribute_scores(rows: DataFrame, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    """Per attribute: counts, rates and macro F1 over values compared as they are.

    Rows: ``attribute, truth, prediction, confidence``.
    """
    known = rows.filter(N.text(F.col("truth")) != "")
    silent, good, bad = _outcomes(F.col("prediction") == F.col("truth"), threshold)
    counts = known.groupBy("attribute").agg(
        F.count("*").alias("total"), _count(~silent).alias("covered"), _count(good).alias("correct"), _count(silent).alias("abstained"), _count(bad).alias("_bad")
    )
    scored = counts.join(macro_f1(known), "attribute", "left")
    return scored.select(
        "attribute", "total", "covered", "correct", "abstained", ratio(F.col("correct"), F.col("covered")).alias("accuracy"),
        ratio(F.col("covered"), F.col("total")).alias("coverage"), ratio(F.col("abstained"), F.col("total")).alias("abstention_rate"),
        F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"), ratio(F.col("_bad"), F.col("covered")).alias("high_confidence_wrong_rate"),
    )


def macro_f1(rows: DataFrame) -> DataFrame:
    """``attribute, macro_f1``: the mean F1 over every class seen as truth or prediction in covered rows.

    Each row counts once for its truth's class and once for its prediction's: two rows into one
    aggregation by class, instead of a pass per class.
    """
    silent = (N.text(F.col("prediction")) == "") | (F.col("prediction") == N.ABSTAIN)
    hit = (F.col("truth") == F.col("prediction")).cast("int")
    sides = F.array(F.struct(F.col("truth").alias("k"), hit.alias("tp"), F.lit(0).alias("said"), F.lit(1).alias("was")), F.struct(F.col("prediction").alias("k"), F.lit(0).alias("tp"), F.lit(1).alias("said"), F.lit(0).alias("was")))
    per = rows.filter((N.text(F.col("truth")) != "") & ~silent).select("attribute", F.explode(sides).alias("s")).groupBy("attribute", "s.k")
    per = per.agg(F.sum("s.tp").alias("tp"), F.sum("s.said").alias("said"), F.sum("s.was").alias("was"))
    # 2pr / (p + r) with p = tp / said and r = tp / was.
    return per.groupBy("attribute").agg(F.avg(ratio(2.0 * F.col("tp"), F.col("said") + F.col("was"))).alias("macro_f1"))


def coverage_report(rows: DataFrame) -> DataFrame:
    """Known truths per attribute; attributes without any are absent."""
    return rows.filter(N.text(F.col("truth")) != "").groupBy("attribute").agg(F.count("*").alias("known"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(N.text(F.col(key)) != "").groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("times")).filter("times > 1")


def binary_scores(rows: DataFrame, positive: str = "supports") -> DataFrame:
    """Precision, recall and F1 of one label against all others, from ``truth, prediction``."""
    t, p = F.col("truth") == positive, F.col("prediction") == positive
    counts = rows.agg(_count(t & p).alias("tp"), _count(~t & p).alias("fp"), _count(t & ~p).alias("fn"))
    counts = counts.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def label_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("rows"))


def validate(rows: DataFrame, required: list[str], key: str, most: int = 10_000) -> dict:
    """Missing columns and repeated keys; the row counts are one aggregate each.

    More than ``most`` repeated keys are a table (``duplicate_keys``), not a report: an error.
    """
    missing = sorted(set(required) - set(rows.columns))
    got = duplicate_keys(rows, key).limit(most + 1).collect() if key in rows.columns else []
    if len(got) > most:
        raise ValueError(f"more than {most} values of {key!r} are repeated; use duplicate_keys for all of them")
    repeated = {r["key"]: r["times"] for r in got}
    return {"rows": rows.count(), "missing_columns": missing, "duplicate_keys": repeated}
