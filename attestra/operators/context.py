"""Spatial corroboration: nearby places and address points support one of two values, or neither."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from .metrics import ratio

MARGIN = 0.01
NEAREST = 25
# Words of addresses that tell nothing.
ADDRESS_STOP_WORDS = ("st", "street", "rd", "road", "ave", "avenue", "dr", "drive", "ln", "lane", "the")


def nearby(cases: DataFrame, points: DataFrame, order: list[Column], margin: float = MARGIN, limit: int = NEAREST) -> DataFrame:
    """Up to ``limit`` points within ``margin`` degrees of each case, first by ``order``.

    Range join as an equi-join: points are dealt to cells as wide as the margin and cases to the
    nine cells around them, so only near rows meet; the exact box is checked after.  Where ``order``
    is by the points' columns alone, points and cases at one place are met once.
    """
    p = points.withColumnsRenamed({x: f"p_{x}" for x in points.columns})
    try:
        p.select(*order).schema  # noqa: B018
    except AnalysisException:  # the order depends on the case, so each case has its own
        return _in_box(cases, p, order, ["case_id"], margin, limit)
    # Of points at one place only the first can count, and all cases at one place have the same points.
    spot = Window.partitionBy("p_lon", "p_lat").orderBy(*order)
    p = p.withColumn("_n", F.row_number().over(spot)).filter(F.col("_n") <= limit).drop("_n")
    spots = _in_box(cases.select("lon", "lat").distinct(), p, order, ["lon", "lat"], margin, limit).drop("place")
    spots = spots.withColumnsRenamed({"lon": "_lon", "lat": "_lat"})
    met = cases.join(spots, (F.col("lon") == F.col("_lon")) & (F.col("lat") == F.col("_lat"))).drop("_lon", "_lat")
    first = Window.partitionBy("case_id").orderBy(*order)  # a case may have several places
    return met.select(*cases.columns, *p.columns, F.row_number().over(first).alias("place")).filter(F.col("place") <= limit)


def _in_box(cases: DataFrame, p: DataFrame, order: list[Column], by: list[str], margin: float, limit: int) -> DataFrame:
    """The first points of each group of cases ``by``; points' columns are named ``p_...``."""
    cell = lambda c: F.floor(c / F.lit(margin)).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    c = cases.withColumn("_x", F.explode(F.transform(around, lambda d: cell(F.col("lon")) + d))).withColumn("_y", F.explode(F.transform(around, lambda d: cell(F.col("lat")) + d)))
    p = p.withColumn("_px", cell(F.col("p_lon"))).withColumn("_py", cell(F.col("p_lat")))
    met = c.join(p, (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py")))
    met = met.filter(F.col("p_lon").between(F.col("lon") - margin, F.col("lon") + margin) & F.col("p_lat").between(F.col("lat") - margin, F.col("lat") + margin))
    first = Window.partitionBy(*by).orderBy(*order)
    return met.drop("_x", "_y", "_px", "_py").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)


def address_tokens(c: Column) -> Column:
    words = F.split(c, " ")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*ADDRESS_STOP_WORDS)))


def address_support(a: Column, b: Column) -> Column:
    """Support of one normal address for another: 1 if equal, 0.9 if contained, else the tokens' overlap."""
    digits = a.rlike(r"\d") & b.rlike(r"\d")
    x, y = address_tokens(a), address_tokens(b)
    shared = F.size(F.array_intersect(x, y))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"))
    overlap = shared / F.greatest(F.size(x), F.size(y))
    fits = (shared > 0) & F.arrays_overlap(numbers(a), numbers(b)) & (overlap >= 0.5)
    return F.when((a == "") | (b == "") | ~digits, 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.9).when(fits, overlap).otherwise(0.0)


def address_point(number: Column, street: Column, unit: Column, city: Column, postcode: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(N.text(c), F.lit("")) for c in (number, street, unit, city, postcode)])


def support(attribute: Column, value: Column, candidate_norm: Column) -> Column:
    norm = N.normalize(attribute, value)
    equal = F.when((norm != "") & (norm == candidate_norm), 1.0).otherwise(0.0)
    return F.when(attribute == "address", address_support(norm, candidate_norm)).otherwise(equal)


def decide(cases: DataFrame, context: DataFrame) -> DataFrame:
    """Decisions for ``cases (case_id, attribute, current, base, ...)`` by values ``context (case_id, attribute, value)``.

    Supports are summed per side; equal values need none.  Sums are rounded to 9 places.
    """
    norm = lambda c: N.normalize(F.col("attribute"), F.col(c))
    rows = cases.withColumn("cn", norm("current")).withColumn("bn", norm("base"))
    met = rows.select("case_id", "attribute", "cn", "bn").join(context, ["case_id", "attribute"])
    sums = met.groupBy("case_id", "attribute").agg(
        F.round(F.sum(support(F.col("attribute"), F.col("value"), F.col("cn"))), 9).alias("cs"), F.round(F.sum(support(F.col("attribute"), F.col("value"), F.col("bn"))), 9).alias("bs")
    )
    out = rows.join(sums, ["case_id", "attribute"], "left").fillna(0.0, ["cs", "bs"])
    same = (F.col("cn") != "") & (F.col("cn") == F.col("bn"))
    cs, bs = F.when(same, 1.0).otherwise(F.col("cs")), F.when(same, 1.0).otherwise(F.col("bs"))
    total = F.col("cs") + F.col("bs")
    decision = F.when(same, "same").when(F.col("cs") == F.col("bs"), "").when(F.col("cs") > F.col("bs"), "current").otherwise("base")
    sure = F.when(same, 1.0).when(total == 0, 0.0).when(F.col("cs") == F.col("bs"), 0.5).otherwise(F.greatest("cs", "bs") / total)
    value = F.when(decision == "same", F.when(F.col("current") != "", F.col("current")).otherwise(F.col("base"))).when(decision == "current", F.col("current")).when(decision == "base", F.col("base")).otherwise("")
    return out.select(*cases.columns, decision.alias("decision"), value.alias("predicted_value"), sure.alias("confidence"), cs.alias("current_support"), bs.alias("base_support"), (decision == "").alias("abstained"))


def high_risk() -> Column:
    """Whether a baseline's prediction is too doubtful to fall back on."""
    number = lambda c: c.rlike(r"\p{Nd}")
    span = lambda c: c.rlike(r"\b\d+\s*[-/]\s*\d+\b")
    mine = N.text(F.col("baseline_prediction"))
    other = F.when(N.normalize_address(mine) == N.normalize_address(F.col("current")), F.col("base")).otherwise(F.col("current"))
    doubt = (~number(mine) & number(other)) | (span(mine) & ~span(other))
    return (mine == "") | ((F.col("attribute") == "address") & doubt)


def gate(decisions: DataFrame) -> DataFrame:
    """Context where it decides, else nothing where the baseline is risky, else the baseline."""
    mine = N.text(F.col("baseline_prediction"))
    source = F.when(~F.col("abstained"), "context").when(high_risk(), "abstain").otherwise("baseline_safe_fallback")
    falls = source == "baseline_safe_fallback"
    return decisions.withColumns(
        {
            "gated_source": source,
            "gated_value": F.when(falls, mine).otherwise(F.col("predicted_value")),
            "gated_confidence": F.when(falls, F.col("baseline_confidence")).otherwise(F.col("confidence")),
            "gated_abstained": F.when(falls, mine == "").otherwise(F.col("abstained")),
        }
    )


def evaluate(gated: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Counts and rates per variant (context, gated, baseline), by attribute and overall: one grouping-sets pass."""
    variant = lambda name, value, sure, silent: F.struct(F.lit(name).alias("variant"), value.alias("value"), sure.cast("double").alias("confidence"), silent.alias("silent"))
    mine = N.text(F.col("baseline_prediction"))
    tried = F.array(
        variant("context", F.col("predicted_value"), F.col("confidence"), F.col("abstained")), variant("gated", F.col("gated_value"), F.col("gated_confidence"), F.col("gated_abstained")),
        variant("baseline", mine, F.col("baseline_confidence"), mine == ""),
    )
    rows = gated.filter(N.text(F.col("truth")) != "").select("attribute", "truth", F.explode(tried).alias("v")).select("attribute", "truth", "v.*")
    right = ~F.col("silent") & (N.normalize(F.col("attribute"), F.col("value")) == N.normalize(F.col("attribute"), F.col("truth")))
    wrong = ~F.col("silent") & ~right & (F.col("confidence") >= threshold)
    flags = rows.select("variant", "attribute", F.col("silent").cast("int").alias("silent"), right.cast("int").alias("right"), wrong.cast("int").alias("wrong"))
    out = flags.groupingSets([["variant"], ["variant", "attribute"]], "variant", "attribute").agg(F.count("*").alias("total"), F.sum(1 - F.col("silent")).alias("covered"), F.sum("right").alias("correct"), F.sum("silent").alias("abstained"), F.sum("wrong").alias("high_confidence_wrong"))
    return out.select(
        "variant", F.coalesce("attribute", F.lit("(all)")).alias("attribute"), "total", "covered", "correct", "abstained", "high_confidence_wrong",
        ratio(F.col("correct"), F.col("covered")).alias("precision"), ratio(F.col("correct"), F.col("total")).alias("recall"), ratio(F.col("abstained"), F.col("total")).alias("abstention_rate"),
        ratio(F.col("high_confidence_wrong"), F.col("covered")).alias("high_confidence_wrong_rate"),
    )


def gap_cases(gated: DataFrame) -> DataFrame:
    """Cases that context leaves open or the baseline gets wrong, with a place to search for."""
    mine = N.text(F.col("baseline_prediction"))
    wrong = N.normalize(F.col("attribute"), mine) != N.normalize(F.col("attribute"), F.col("truth"))
    anchor = F.coalesce(*[F.nullif(N.text(F.col(c)), F.lit("")) for c in ("current", "base", "truth")], F.lit(""))
    at = lambda a: F.when(F.col("attribute") == a, anchor).otherwise("")
    rows = gated.filter(F.col("abstained") | wrong)
    return rows.withColumns({"priority": F.when(wrong, "baseline_wrong").otherwise("context_abstained"), "name": anchor, "city": F.lit(""), "region": F.lit(""), "address": at("address"), "phone": at("phone"), "website": at("website")})
