"""Label importers: agreement, positional values, attribute-level verdicts; and review order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N

#: Columns of a label file, in order.
LABEL_FIELDS = ["id", "base_id", "label_status", *[f"{a}_{x}" for a in N.ATTRIBUTES for x in ("truth_choice", "truth_value", "evidence_url", "label_source")], "notes"]
# Other names of attributes, and what verdicts mean.
ATTRIBUTE_NAMES = {
    "web": "website",
    "website": "website",
    "websites": "website",
    "phone": "phone",
    "phones": "phone",
    "address": "address",
    "addresses": "address",
    "category": "category",
    "categories": "category",
    "name": "name",
    "names": "name",
}
VERDICTS = {"left": "current", "right": "base", "both": "same"}
URGENT_LABELS = ("contradicts", "stale", "unclear")


def _mapped(c, table: dict):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(N.strip(N.text(c)))), F.lit(""))


def agreement_labels(pairs: DataFrame, min_attributes: int = 1) -> DataFrame:
    """Pairs whose values agree in normal form on enough attributes, labelled ``same`` there."""
    agree = {}
    for a in N.ATTRIBUTES:
        norm = N.NORMALIZERS[a]
        x, y = F.col(a), F.col(f"base_{a}")
        agree[a] = (N.text(x) != "") & (N.text(y) != "") & (norm(x) == norm(y))
    total = sum((c.cast("int") for c in agree.values()), F.lit(0))
    choices = [F.when(c, "same").otherwise("").alias(f"{a}_truth_choice") for a, c in agree.items()]
    return pairs.select("id", "base_id", F.lit("silver_agreement").alias("label_status"), *choices, total.alias("agreed")).filter(F.col("agreed") >= min_attributes)


def positional_labels(pairs: DataFrame, golden: DataFrame) -> DataFrame:
    """Labels from golden values by row number: ``golden (sample_idx, <attribute>)`` against ``pairs.ordinal``.

    An equi-join on the ordinal; a value that matches neither side is kept as the explicit truth.
    """
    g = golden.select(F.expr("try_cast(sample_idx AS bigint)").alias("_i"), *[N.text(F.col(a)).alias(f"g_{a}") for a in N.ATTRIBUTES])
    rows = pairs.join(g, F.col("ordinal") == F.col("_i"))
    out = []
    for a in N.ATTRIBUTES:
        norm = N.NORMALIZERS[a]
        value = F.col(f"g_{a}")
        mine, theirs = norm(value) == norm(F.col(a)), norm(value) == norm(F.col(f"base_{a}"))
        known = norm(value) != ""
        choice = F.when((value == "") | ~known, "").when(mine & theirs, "same").when(mine, "current").when(theirs, "base").otherwise("")
        out += [choice.alias(f"{a}_truth_choice"), F.when((value != "") & (choice == ""), value).otherwise("").alias(f"{a}_truth_value")]
    return rows.select("id", "base_id", *out)


def attribute_labels(verdicts: DataFrame) -> DataFrame:
    """One label row per (pair, base) from rows ``pair_id, base_id, attribute, final_decision, ordinal``; the last verdict wins."""
    rows = verdicts.select(
        N.text(F.col("pair_id")).alias("id"), N.text(F.col("base_id")).alias("base_id"), _mapped(F.col("attribute"), ATTRIBUTE_NAMES).alias("attribute"), _mapped(F.col("final_decision"), VERDICTS).alias("choice"), "ordinal"
    )
    good = rows.filter("attribute != '' AND choice != '' AND (id != '' OR base_id != '')")
    last = [F.coalesce(F.max_by(F.when(F.col("attribute") == a, F.col("choice")), F.when(F.col("attribute") == a, F.col("ordinal"))), F.lit("")).alias(f"{a}_truth_choice") for a in N.ATTRIBUTES]
    out = good.groupBy("id", "base_id").agg(*last)
    return out.withColumn("labeled_attributes", sum(((F.col(f"{a}_truth_choice") != "").cast("int") for a in N.ATTRIBUTES), F.lit(0)))


def review_order(rows: DataFrame) -> DataFrame:
    """Urgent labels first, then the surest."""
    return rows.orderBy((~N.text(F.col("weak_label")).isin(*URGENT_LABELS)).cast("int"), F.desc("confidence"))


def seed_episodes(batch: DataFrame, evidence: DataFrame) -> DataFrame:
    """Episodes from a batch of queries and the evidence found for them: long pages, attempts in order of (layer, query).

    Evidence may add attempts that the batch does not have (a full outer join per case).
    """
    keys = ["case_id", "attribute", "layer", "query"]
    tries = batch.select(*keys).distinct().withColumn("_b", F.lit(True))
    found = evidence.join(batch.select("case_id", "attribute").distinct(), ["case_id", "attribute"], "left_semi")
    both = tries.join(found, keys, "full_outer")
    case = Window.partitionBy("case_id", "attribute").orderBy("layer", "query")
    out = both.withColumn("attempt", F.dense_rank().over(case) - 1).drop("_b")
    heads = batch.groupBy("case_id", "attribute").agg(F.min("truth").alias("gold_value"))
    return out.join(heads, ["case_id", "attribute"])
