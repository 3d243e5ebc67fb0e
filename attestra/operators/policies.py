"""Pair policies: which of two values is predicted, and how sure; and what the labels hold true.

Pairs are kept in long form, one row per (pair, attribute):
``id, base_id, attribute, current, base, c, b`` with the two records' confidences ``c`` and ``b``,
the values' normal forms, and what the policies ask of the records' websites and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N

BASELINES = ("current", "base", "completeness", "confidence", "hybrid", "smart_hybrid", "website_authority_hybrid", "agreement_only")
# Path words of a page about one branch.
PLACE_PATH_TOKENS = (
    "branch",
    "branches",
    "clinic",
    "dealer",
    "dealers",
    "location",
    "locations",
    "locator",
    "office",
    "offices",
    "restaurant",
    "restaurants",
    "store",
    "stores",
    "near-me",
)
TIE_BREAK_CONFIDENCE = 0.90
TIE_BREAK_MARGIN = 0.10
#: The grid that the website policy is tuned on.
GRID_CONFIDENCES = (0.90, 0.925, 0.95, 0.975, 0.99)
GRID_MARGINS = (0.025, 0.05, 0.075, 0.10, 0.15)


def long_pairs(pairs: DataFrame) -> DataFrame:
    """Wide pairs (``<attribute>``, ``base_<attribute>``, confidences) to one row per attribute."""
    rest = [c for c in pairs.columns if c not in {"confidence", "base_confidence", *N.ATTRIBUTES, *(f"base_{a}" for a in N.ATTRIBUTES)}]
    # An unreadable confidence is 0; so is one that is not a number, which would else win every comparison.
    sure = [F.coalesce(F.nanvl(F.col(x).cast("double"), F.lit(None)), F.lit(0.0)).alias(y) for x, y in (("confidence", "c"), ("base_confidence", "b"))]
    # Normal forms and site facts are computed once per pair, before it becomes five rows.
    sides = ("", "base_")
    facts = {f"{p}{a}_norm": N.NORMALIZERS[a](F.col(p + a)) for a in N.ATTRIBUTES for p in sides}
    for p in sides:
        site, name = N.text(F.col(f"{p}website")), N.text(F.col(f"{p}name"))
        facts[f"{p}social"] = N.is_social_or_aggregator(site)
        facts[f"{p}locality"] = website_locality(site)
        facts[f"{p}site_quality"] = website_quality(name, site)
        facts[f"{p}name_quality"] = name_quality(name, site)
    known = pairs.select("*", *[c.alias(n) for n, c in facts.items()])
    value = []
    for a in N.ATTRIBUTES:
        quality = {"website": "site_quality", "name": "name_quality"}.get(a)
        score = [(F.col(p + quality) if quality else F.lit(0.0)).alias(f"{p or 'current_'}quality") for p in sides]
        norm = [F.col(f"{p}{a}_norm").alias(f"{p or 'current_'}norm") for p in sides]
        value.append(F.struct(F.lit(a).alias("attribute"), N.text(F.col(a)).alias("current"), N.text(F.col(f"base_{a}")).alias("base"), *norm, *score))
    site = [F.col(f"{p}{x}").alias(f"{p or 'current_'}{x}") for p in sides for x in ("social", "locality")]
    return known.select(*rest, *sure, *site, F.explode(F.array(*value)).alias("v")).select(*rest, "c", "b", *[f"{p or 'current_'}{x}" for p in sides for x in ("social", "locality")], "v.*")


def _struct(value: Column, confidence: Column) -> Column:
    return F.struct(value.alias("prediction"), confidence.cast("double").alias("confidence"))


def _or_abstain(value: Column) -> Column:
    return F.when(value == "", F.lit(N.ABSTAIN)).otherwise(value)


def website_quality(name: Column, website: Column) -> Column:
    """Own, short sites whose host carries the name score best."""
    norm, domain = N.normalize_website(website), N.website_domain(website)
    overlap = F.size(F.array_intersect(N.name_tokens(name), N.domain_tokens(website)))
    score = F.when(norm == domain, 0.2).otherwise(0.0) + F.when(N.is_social_or_aggregator(website), 0.0).otherwise(1.0)
    score = score + F.when(overlap > 0, 0.6 + 0.1 * F.least(overlap, F.lit(3))).otherwise(0.0)
    score = score - F.when(F.length(norm) - F.length(F.replace(norm, F.lit("/"), F.lit(""))) > 1, 0.15).otherwise(0.0)
    return F.when(website == "", -1.0).otherwise(score)


def name_quality(name: Column, website: Column) -> Column:
    """Longer names score better, and those that share words with the website's host."""
    tokens = N.name_tokens(name)
    overlap = F.size(F.array_intersect(tokens, N.domain_tokens(website)))
    score = F.least(F.size(tokens), F.lit(4)) * 0.15
    score = score + F.when(overlap > 0, 0.7 + 0.1 * F.least(overlap, F.lit(2))).otherwise(0.0)
    return F.when(name == "", -1.0).otherwise(score - F.when(name.rlike(r"\p{Nd}"), 0.1).otherwise(0.0))


def website_locality(value: Column) -> Column:
    """How much a path looks like one branch's page."""
    norm = N.normalize_website(value)
    path = F.regexp_replace(F.regexp_extract(norm, r"^[^/]*/(.*)$", 1), r"^/+|/+$", "")
    score = F.lit(1.0) + F.when(path.rlike("|".join(PLACE_PATH_TOKENS)), 2.0).otherwise(0.0) + F.when(path.rlike(r"[^/]/+[^/]"), 1.0).otherwise(0.0)
    return F.when(path.isin("", "home", "home.html", "index.html", "index.htm"), 0.0).otherwise(score)


def _by_confidence() -> Column:
    current, base, c, b = F.col("current"), F.col("base"), F.col("c"), F.col("b")
    mine = _struct(_or_abstain(current), F.when(current != "", c).otherwise(b))
    theirs = _struct(_or_abstain(base), F.when(base != "", b).otherwise(c))
    return F.when(c >= b, mine).otherwise(theirs)


def _settled(rest: Column) -> Column:
    """Agreement and one-sided values, which most policies settle first."""
    current, base = F.col("current"), F.col("base")
    both = (current != "") & (base != "")
    return (
        F.when(both & (F.col("current_norm") == F.col("base_norm")), _struct(current, F.lit(1.0)))
        .when((current != "") & (base == ""), _struct(current, F.col("c")))
        .when((base != "") & (current == ""), _struct(base, F.col("b")))
        .otherwise(rest)
    )


def website_policy(min_confidence: Column, max_margin: Column) -> Column:
    """The parametric website policy; thresholds are columns, so that a grid is a join."""
    current, base, c, b = F.col("current"), F.col("base"), F.col("c"), F.col("b")
    own = (current != "") & ~F.col("current_social")
    chosen = _by_confidence()
    local = (F.col("current_locality") >= 3.0) & (F.col("base_locality") <= 1.0)
    takes_base = (base != "") & (c < b)  # agreement and one-sided values are settled before
    return _settled(
        F.when(own & (c >= min_confidence) & ((b - c) <= max_margin), _struct(current, F.greatest(c, F.lit(0.9))))
        .when(~takes_base, chosen)
        .when(own & (F.col("base_social") | local), _struct(current, F.greatest(c, F.lit(0.8))))
        .otherwise(chosen)
    )


def _smart() -> Column:
    current, base, c, b = F.col("current"), F.col("base"), F.col("c"), F.col("b")
    plain = F.when(current != "", _struct(current, c)).otherwise(_struct(_or_abstain(base), b))

    def better(floor: float) -> Column:
        x, y = F.col("current_quality"), F.col("base_quality")
        mine = _struct(_or_abstain(current), F.greatest(c, F.when(current != "", floor).otherwise(0.0)))
        theirs = _struct(_or_abstain(base), F.greatest(b, F.when(base != "", floor).otherwise(0.0)))
        return F.when(x > y, mine).when(y > x, theirs).otherwise(plain)

    sure = F.when(c >= b, _struct(_or_abstain(current), c)).otherwise(_struct(_or_abstain(base), b))
    return F.when(F.col("attribute") == "website", better(0.8)).when(F.col("attribute") == "name", better(0.75)).otherwise(sure)


def predict(baseline: str) -> Column:
    """``struct<prediction, confidence>`` of a policy over long pair rows."""
    current, base, c, b = F.col("current"), F.col("base"), F.col("c"), F.col("b")
    if baseline == "current":
        return _struct(current, F.when(current != "", c).otherwise(0.0))
    if baseline == "base":
        return _struct(base, F.when(base != "", b).otherwise(0.0))
    if baseline == "completeness":
        return F.when(current != "", _struct(current, c)).when(base != "", _struct(base, b)).otherwise(_struct(F.lit(N.ABSTAIN), F.lit(0.0)))
    if baseline == "confidence":
        mine = F.when(current != "", _struct(current, c)).otherwise(_struct(_or_abstain(base), b))
        theirs = F.when(base != "", _struct(base, b)).otherwise(_struct(_or_abstain(current), c))
        return F.when(c >= b, mine).otherwise(theirs)
    if baseline == "hybrid":
        return _settled(F.when(c >= b, _struct(_or_abstain(current), c)).otherwise(_struct(_or_abstain(base), b)))
    if baseline == "smart_hybrid":
        return _settled(_smart())
    if baseline == "website_authority_hybrid":
        site = website_policy(F.lit(TIE_BREAK_CONFIDENCE), F.lit(TIE_BREAK_MARGIN))
        return F.when(F.col("attribute") == "website", site).otherwise(_settled(_by_confidence()))
    if baseline == "agreement_only":
        return _settled(_struct(F.lit(N.ABSTAIN), F.lit(0.0)))
    raise ValueError(f"unknown baseline {baseline!r}")


def truth(choice: Column, explicit: Column) -> Column:
    """``struct<truth, truth_source>`` of a label: an explicit value, or the side it names."""
    current, base = F.col("current"), F.col("base")
    value, side = N.strip(N.text(explicit)), F.lower(N.strip(N.text(choice)))
    make = lambda v, s: F.struct(v.alias("truth"), s.alias("truth_source"))
    either = F.when(current != "", current).otherwise(base)
    return (
        F.when(value != "", make(value, F.lit("explicit")))
        .when(side == "current", make(current, F.lit("current")))
        .when(side == "base", make(base, F.lit("base")))
        .when((side == "same") & (F.col("current_norm") == F.col("base_norm")), make(either, F.lit("same")))
        .when(side == "same", make(F.lit(""), F.lit("invalid_same")))
        .otherwise(make(F.lit(""), F.when(side == "", F.lit("unlabeled")).otherwise(side)))
    )


def evaluation_rows(rows: DataFrame, baselines=BASELINES) -> DataFrame:
    """Every policy's prediction beside the truth, for labelled long rows with ``truth_choice, truth_value``.

    Policies are one array of structs per row, so pairs are read once for all of them.
    """
    tried = F.explode(F.array(*[F.struct(F.lit(x).alias("baseline"), predict(x).alias("p")) for x in baselines]))
    keep = ["id", "base_id", "attribute", "current", "base", "c", "b", "current_norm", "base_norm"]
    out = rows.select(*keep, truth(F.col("truth_choice"), F.col("truth_value")).alias("t"), tried.alias("x"))
    out = out.select(*keep, "x.baseline", "x.p.prediction", "x.p.confidence", "t.truth", "t.truth_source", (F.col("current_norm") != F.col("base_norm")).alias("pair_differs"))
    return with_norms(out)


def with_norms(rows: DataFrame) -> DataFrame:
    """Normal forms of ``prediction`` and ``truth``, taken from the sides where they are a side's value."""

    def norm(c: Column, other: Column) -> Column:
        return F.when(c == F.col("current"), F.col("current_norm")).when(c == F.col("base"), F.col("base_norm")).otherwise(other)

    explicit = F.when(F.col("truth_source") == "explicit", N.normalize(F.col("attribute"), F.col("truth"))).otherwise("")
    return rows.withColumns({"prediction_norm": norm(F.col("prediction"), F.lower("prediction")), "truth_norm": norm(F.col("truth"), explicit)})


def label_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the pair they name, by ``id`` first and by ``base_id`` where no id matches.

    Two equi-joins on one key; the last of equal keys (by ``ordinal``) wins.
    """
    key = F.when(N.text(F.col("id")) != "", F.col("id")).otherwise(F.col("base_id"))
    wanted = labels.withColumn("label_key", key)
    pair = F.struct(*[F.col(c) for c in pairs.columns])
    last = lambda k: pairs.filter(F.col(k) != "").groupBy(F.col(k).alias("_k")).agg(F.max_by(pair, F.col("ordinal")).alias("pair"))
    by_id, by_base = last("id").withColumnsRenamed({"_k": "_i", "pair": "_p"}), last("base_id").withColumnsRenamed({"_k": "_j", "pair": "_q"})
    out = wanted.join(by_id, F.col("label_key") == F.col("_i"), "left").join(by_base, F.col("label_key") == F.col("_j"), "left")
    return out.withColumn("pair", F.coalesce("_p", "_q")).drop("_i", "_j", "_p", "_q", "label_key").filter(F.col("pair").isNotNull())


def conflict_rows(evaluated: DataFrame) -> DataFrame:
    """Rows whose two sides differ and whose truth is known, as reviewers see them."""
    right = F.col("prediction_norm") == F.col("truth_norm")
    return evaluated.filter(F.col("pair_differs") & (F.col("truth") != "")).select(
        "id", "base_id", "attribute", "baseline", "truth", "truth_source", "prediction", "confidence", right.alias("correct"),
        F.col("current").alias("current_value"), F.col("base").alias("base_value"), F.lit(True).alias("needs_evidence"), F.lit("").alias("evidence_url"), F.lit("").alias("review_notes"),
    )


def grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, y) for x in GRID_CONFIDENCES for y in GRID_MARGINS], "min_confidence double, max_margin double")


def calibrate_website_policy(rows: DataFrame) -> DataFrame:
    """Metrics of each of the 25 threshold pairs on labelled website rows, with its ``rank``.

    The best has the fewest confident errors on conflicts, then on all rows, then the best accuracy
    on conflicts and on all, then the least abstention; ties go to the smaller thresholds.
    """
    from .metrics import golden_metrics

    site = rows.filter(F.col("attribute") == "website").crossJoin(F.broadcast(grid(rows.sparkSession)))  # 25 rows
    out = site.select("*", website_policy(F.col("min_confidence"), F.col("max_margin")).alias("p"), truth(F.col("truth_choice"), F.col("truth_value")).alias("t"))
    keep = ["min_confidence", "max_margin", "attribute", "current", "base", "current_norm", "base_norm"]
    out = with_norms(out.select(*keep, "p.*", "t.*", (F.col("current_norm") != F.col("base_norm")).alias("pair_differs")).filter("truth != ''"))
    m = golden_metrics(out, ["min_confidence", "max_margin"])
    pick = lambda s, x: F.max(F.when(F.col("scope") == s, F.col(x)))
    named = {f"{s}_{x}": pick(s, x) for s in ("all", "conflict") for x in ("total", "accuracy", "abstention_rate", "high_confidence_wrong_rate")}
    wide = m.groupBy("min_confidence", "max_margin").agg(*[e.alias(n) for n, e in named.items()])
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in named}
    wide = wide.withColumns(zero)
    order = Window.orderBy("conflict_high_confidence_wrong_rate", "all_high_confidence_wrong_rate", F.desc("conflict_accuracy"), F.desc("all_accuracy"), "all_abstention_rate", "min_confidence", "max_margin")
    return wide.withColumn("rank", F.row_number().over(order))  # 25 rows
