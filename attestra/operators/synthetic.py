"""Synthetic evidence: six rotating scenarios that a resolver must get right or abstain on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from . import resolver
from .metrics import ratio

# Scenarios, in the order in which cases take them.
SCENARIOS = ("authoritative_truth", "truth_with_decoy", "tied_authority", "decoy_only", "no_matching_evidence", "truth_not_candidate")
UNMATCHED = "__unmatched_synthetic_value__"


def cases(conflicts: DataFrame, edges: bool = True) -> DataFrame:
    """Conflicts (``ordinal, id, attribute, truth, prediction, current_value, base_value``) with scenario, decoy and evidence."""
    norm = lambda c: N.normalize(F.col("attribute"), c)
    truth, current, base = (N.text(F.col(c)) for c in ("truth", "current_value", "base_value"))
    decoy = F.when(norm(current) != norm(truth), current).when(norm(base) != norm(truth), base).when(current != "", current).otherwise(base)
    scenario = F.get(F.array(*map(F.lit, SCENARIOS)), (F.col("ordinal") % len(SCENARIOS)).cast("int")) if edges else F.lit("truth_with_decoy")
    item = lambda kind, value: F.struct(F.lit(kind).alias("source_type"), value.alias("extracted_value"))
    mine, other = item("official_site", truth), item("aggregator", decoy)
    evidence = {
        "authoritative_truth": F.array(mine),
        "truth_with_decoy": F.array(mine, other),
        "tied_authority": F.array(mine, item("official_site", decoy)),
        "decoy_only": F.array(other),
        "no_matching_evidence": F.array(item("official_site", F.lit(UNMATCHED))),
        "truth_not_candidate": F.array(mine),
    }
    chosen = F.when(F.lit(False), F.array(mine))
    for name, items in evidence.items():
        chosen = chosen.when(F.col("scenario") == name, items)
    case = F.concat_ws(":", "id", "attribute", F.col("ordinal").cast("string"))
    return conflicts.withColumn("scenario", scenario).withColumn("case_id", case).withColumn("decoy", decoy).withColumn("evidence", chosen)


def decide(made: DataFrame) -> DataFrame:
    """The resolver's decision on each case, and whether it is right."""
    values = F.array(*[F.struct(N.text(F.col(c)).alias("value"), F.lit(i).alias("ordinal")) for i, c in enumerate(("current_value", "base_value", "truth"))])
    options = made.select("case_id", "attribute", F.explode(values).alias("v")).select("case_id", "attribute", "v.*")
    none = F.lit(None).cast("double")
    evidence = made.select("case_id", "attribute", F.posexplode("evidence").alias("ordinal", "e")).select("case_id", "attribute", "ordinal", "e.*")
    evidence = evidence.withColumns({"recency_days": none, "zombie_score": F.lit(0.0), "identity_change_score": F.lit(0.0)})
    # Of candidates with one normal form the first given is reported.
    firsts = options.filter("value != ''").withColumn("norm", N.normalize(F.col("attribute"), F.col("value"))).groupBy("case_id", "attribute", "norm").agg(F.min_by("value", "ordinal").alias("value"), F.min("ordinal").alias("ordinal"))
    out = resolver.resolve(made, firsts.drop("norm"), evidence)
    rows = made.select("case_id", "attribute", "scenario", "truth", F.col("prediction").alias("baseline_prediction")).join(out, ["case_id", "attribute"])
    norm = lambda c: N.normalize(F.col("attribute"), F.col(c))
    return rows.withColumn("correct", ~F.col("abstained") & (norm("decision") == norm("truth"))).withColumn("baseline_correct", norm("baseline_prediction") == norm("truth"))


def evaluate(decided: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Counts and rates overall, by scenario and by attribute, in one grouping-sets pass."""
    flags = decided.select(
        "scenario", "attribute", (~F.col("abstained")).cast("int").alias("covered"), F.col("correct").cast("int").alias("correct"), F.col("abstained").cast("int").alias("abstained"),
        (~F.col("correct") & ~F.col("abstained") & (F.col("confidence") >= threshold)).cast("int").alias("wrong"),
    )
    out = flags.groupingSets([[], ["scenario"], ["attribute"]], "scenario", "attribute").agg(F.count("*").alias("total"), *[F.sum(c).alias(c) for c in ("covered", "correct", "abstained", "wrong")])
    return out.select(
        F.coalesce("scenario", F.lit("(all)")).alias("scenario"), F.coalesce("attribute", F.lit("(all)")).alias("attribute"), "total", "covered", "correct", "abstained", F.col("wrong").alias("high_confidence_wrong"),
        ratio(F.col("correct"), F.col("covered")).alias("accuracy"), ratio(F.col("covered"), F.col("total")).alias("coverage"), ratio(F.col("abstained"), F.col("total")).alias("abstention_rate"),
        ratio(F.col("wrong"), F.col("covered")).alias("high_confidence_wrong_rate"),
    )
