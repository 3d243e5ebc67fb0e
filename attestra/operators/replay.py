"""Replay corpora: recorded search episodes, scored once and aggregated into every report.

Long form, one row per page: ``case_id, attribute, gold_value, place (map), attempt, layer, query,
page, url, title, page_text, source_type, extracted_value, recency_days, zombie_score,
identity_change_score``.  ``attempt`` and ``page`` are positions; attempts without pages keep a row
whose ``page`` is null, and episodes without attempts one whose ``attempt`` is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import authority as A
from ..functions import normalize as N
from . import resolver
from .metrics import ratio

EPISODE = ["case_id", "attribute"]
# Layers of targeted search.
TARGETED = ("official", "government", "business_registry", "registry", "corroboration", "freshness")
ARMS = ("targeted", "fallback", "all")
USEFUL = 0.75
PAGE_FIELDS = ["url", "title", "page_text", "source_type", "extracted_value", "recency_days", "zombie_score", "identity_change_score"]


def page_value() -> Column:
    """A page's value; for a website its own URL where none was extracted."""
    value = N.text(F.col("extracted_value"))
    return F.when((value == "") & (F.col("attribute") == "website"), N.text(F.col("url"))).otherwise(value)


def evidence_value() -> Column:
    """Like ``page_value``, but only an official site's URL may stand for a website."""
    value = N.text(F.col("extracted_value"))
    return F.when((value == "") & (F.col("attribute") == "website") & (F.col("source_type") == "official_site"), N.text(F.col("url"))).otherwise(value)


def score_pages(pages: DataFrame) -> DataFrame:
    """Pages with ``score``, ``matches`` (value equals gold), rounded so that ties do not hang on rounding.

    What a rank mentions many times is computed in steps of its own.
    """
    steps = {"_host": N.url_host(F.col("url")), "_path": N.url_path(F.col("url")), "_words": F.lower(A.search_words(F.col("title"), F.col("page_text"))), "_asked": F.lower(N.text(F.col("query")))}
    rank = A.rank_page(*map(F.col, ("_kind", *steps)))
    score = A.ranked_score(F.col("_rank"), F.col("layer"), F.col("recency_days"), F.col("zombie_score"), F.col("identity_change_score"))
    matches = N.normalize(F.col("attribute"), page_value()) == N.normalize(F.col("attribute"), F.col("gold_value"))
    made = pages.withColumns(steps).withColumn("_kind", A.classify_site(F.col("_host"), F.col("_path"))).withColumn("_rank", rank)
    made = made.withColumn("score", F.when(F.col("page").isNotNull(), F.round(score, 9))).withColumn("matches", F.col("page").isNotNull() & matches)
    return made.drop(*steps, "_kind", "_rank")


def best_pages(scored: DataFrame) -> DataFrame:
    """One row per attempt with its best page (the first of equals), as ``score, matches, source_type``.

    ``max_by`` on (score, earlier page) is a partial aggregation: pages never meet in a window.
    """
    best = F.max(F.struct(F.coalesce("score", F.lit(-1.0)).alias("score"), (-F.coalesce("page", F.lit(1 << 30))).alias("p"), "matches", "source_type", "url"))
    per = scored.groupBy(*EPISODE, "attempt", "layer").agg(best.alias("b"), F.count("page").alias("pages"), F.max(F.col("source_type").isin(*A.AUTHORITATIVE) & F.col("page").isNotNull()).alias("authoritative"))
    found = F.col("pages") > 0
    return per.select(
        *EPISODE, "attempt", "layer", "pages", F.coalesce("authoritative", F.lit(False)).alias("authoritative"),
        *[F.when(found, F.col(f"b.{c}")).alias(c) for c in ("score", "matches", "source_type", "url")],
    )


def arms(c: Column) -> Column:
    """Arms that an attempt of layer ``c`` belongs to."""
    return F.when(c.isin(*TARGETED), F.array(F.lit("targeted"), F.lit("all"))).when(c == "fallback", F.array(F.lit("fallback"), F.lit("all"))).otherwise(F.array(F.lit("all")))


def arm_metrics(scored: DataFrame, threshold: float = USEFUL) -> DataFrame:
    """Per arm: found rates, citation scores and attempts per case, always over all episodes."""
    total = scored.select(*EPISODE).distinct().agg(F.count("*").alias("total"))
    attempts = best_pages(scored).filter("attempt IS NOT NULL").withColumn("arm", F.explode(arms(F.col("layer"))))
    useful = F.coalesce(F.col("score") >= threshold, F.lit(False))
    # The selected page is the best useful one; earlier attempts win ties.
    pick = F.max(F.when(useful, F.struct("score", (-F.col("attempt")).alias("a"), "matches")))
    cases = attempts.groupBy("arm", *EPISODE).agg(
        F.count("*").alias("attempts"), F.sum(useful.cast("int")).alias("useful"), F.max((useful & F.col("matches")).cast("int")).alias("hit"), pick.alias("s"),
        F.sum(F.col("authoritative").cast("int")).alias("authoritative"), F.count("score").alias("selected"),
        F.sum((F.col("score").isNotNull() & ~F.col("source_type").isin(*A.NOT_CITED)).cast("int")).alias("cited"),
    )
    right = F.coalesce(F.col("s.matches"), F.lit(False)).cast("int")
    sums = cases.groupBy("arm").agg(
        F.sum("attempts").alias("attempts"), F.sum("useful").alias("useful"), F.sum((F.col("useful") > 0).cast("int")).alias("useful_cases"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.sum(right).alias("top"),
        F.sum("authoritative").alias("authoritative"), F.sum("selected").alias("selected"), F.sum("cited").alias("cited"),
    )
    n = F.col("total")
    recall, precision = ratio(F.col("hits"), n), ratio(F.col("top"), n)
    return sums.crossJoin(F.broadcast(total)).select(
        "arm", "total", recall.alias("authoritative_found_rate"), ratio(F.col("useful_cases"), n).alias("useful_found_rate"), precision.alias("citation_precision"),
        recall.alias("citation_recall"), ratio(2 * precision * recall, precision + recall).alias("citation_f1"), precision.alias("top1_authoritative_rate"),
        ratio(F.col("attempts"), n).alias("average_search_attempts"), ratio(F.col("useful"), n).alias("useful_attempts_per_case"),
        ratio(F.col("attempts"), F.col("authoritative")).alias("avg_attempts_per_authoritative"), ratio(F.col("cited"), F.col("selected")).alias("citation_precision_proxy"),
    )


def layer_distribution(scored: DataFrame) -> DataFrame:
    """Pages per arm and layer."""
    rows = scored.filter("attempt IS NOT NULL").withColumn("arm", F.explode(arms(F.col("layer"))))
    return rows.groupBy("arm", "layer").agg(F.count("page").alias("pages"))


def retrieval_proof(scored: DataFrame) -> DataFrame:
    """The arms side by side on one row, with targeted minus fallback."""
    names = ["authoritative_found_rate", "useful_found_rate", "citation_precision", "top1_authoritative_rate", "avg_attempts_per_authoritative", "citation_precision_proxy"]
    wide = arm_metrics(scored).groupBy().agg(*[F.coalesce(F.max(F.when(F.col("arm") == a, F.col(n))), F.lit(0.0)).alias(f"{a}_{n}") for a in ARMS for n in names])
    deltas = [(F.col(f"targeted_{n}") - F.col(f"fallback_{n}")).alias(f"delta_{n}") for n in ("authoritative_found_rate", "citation_precision_proxy", "avg_attempts_per_authoritative")]
    return wide.select("*", *deltas)


def retrieval_gate(proof: DataFrame, max_wrong_rate: float = 0.25, wrong_rate: float | None = None) -> DataFrame:
    """Whether targeted search is nowhere worse than fallback, check by check."""
    checks = {
        "citation_precision_not_worse": F.col("targeted_citation_precision") >= F.col("fallback_citation_precision"),
        "top1_authoritative_not_worse": F.col("targeted_top1_authoritative_rate") >= F.col("fallback_top1_authoritative_rate"),
        "authoritative_found_not_worse": F.col("targeted_authoritative_found_rate") >= F.col("fallback_authoritative_found_rate"),
        "useful_found_not_worse": F.col("targeted_useful_found_rate") >= F.col("fallback_useful_found_rate"),
        "high_confidence_wrong_within_threshold": F.lit(wrong_rate is None or wrong_rate <= max_wrong_rate),
    }
    out = proof.select(*[c.alias(n) for n, c in checks.items()])
    every = F.lit(True)
    for n in checks:
        every = every & F.col(n)
    return out.withColumn("passed", every)


#: Least and greatest figures that a release needs.
RELEASE = {
    "holdout_website_accuracy": (">=", 0.98),
    "holdout_high_confidence_wrong_rate": ("<=", 0.02),
    "holdout_abstention_rate": ("<=", 0.15),
    "replay_pages": (">=", 300),
    "authoritative_pages_rate": (">=", 0.50),
    "targeted_authoritative_delta": (">", 0.0),
    "website_official_found_rate": (">=", 0.05),
    "website_false_official_rate": ("<=", 0.02),
    "resolver_high_confidence_wrong_rate": ("<=", 0.02),
}


def release_gate(figures: dict, tuning_labels: str, holdout_labels: str) -> dict:
    """Checks over the figures of five reports, and that tuning and holdout labels are different files."""
    compare = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b}
    worst = {">=": 0.0, ">": 0.0, "<=": 1.0}
    checks = {"separate_tuning_and_holdout": bool(tuning_labels and holdout_labels and tuning_labels != holdout_labels)}
    checks |= {n: compare[op](float(figures.get(n, worst[op])), bound) for n, (op, bound) in RELEASE.items()}
    return {"passed": all(checks.values()), "checks": checks, "thresholds": {n: b for n, (_, b) in RELEASE.items()}}


def replay_stats(pages: DataFrame) -> DataFrame:
    """Per attribute and overall: episodes, attempts, pages, authoritative and extracted shares."""
    held = F.col("page").isNotNull()
    strong = held & F.col("source_type").isin(*A.AUTHORITATIVE)
    valued = held & (N.text(F.col("extracted_value")) != "")
    per = pages.groupBy(*EPISODE, "attempt").agg(F.count("page").alias("pages"), F.sum(strong.cast("int")).alias("strong"), F.sum(valued.cast("int")).alias("valued"))
    per = per.groupBy(*EPISODE).agg(F.count("attempt").alias("attempts"), *[F.sum(c).alias(c) for c in ("pages", "strong", "valued")])
    out = per.rollup("attribute").agg(F.count("*").alias("episodes"), *[F.sum(c).alias(c) for c in ("attempts", "pages", "strong", "valued")])
    return out.select(
        F.coalesce("attribute", F.lit("(all)")).alias("attribute"), "episodes", "attempts", "pages", F.col("strong").alias("authoritative_pages"),
        ratio(F.col("strong"), F.col("pages")).alias("authoritative_pages_rate"), ratio(F.col("valued"), F.col("pages")).alias("pages_with_value_rate"),
    )


def source_mix(pages: DataFrame) -> DataFrame:
    return pages.filter("page IS NOT NULL").groupBy("source_type").agg(F.count("*").alias("pages"))


def merge_corpora(pages: DataFrame) -> DataFrame:
    """Corpora with a ``file`` column to one: episodes by (case, attribute), attempts by (layer, query), pages by URL.

    Of pages with one URL the longest text stays, the first of equals by (file, attempt, page).
    Attempts are renumbered by (layer, query), pages by URL; pages without URL go, and attempts that
    lose all pages keep a row.  Gold value and place come from the first file that has the episode, and the final decision
    from the first that has one.
    """
    url = N.strip(N.text(F.col("url")))
    rows = pages.withColumn("_o", F.struct("file", "attempt", "page")).withColumn("_h", F.struct("gold_value", "place"))
    rows = rows.withColumn("_d", F.col("final_decision") if (decided := "final_decision" in pages.columns) else F.lit(None).cast("string"))
    # Each step is by more than the case, so rows that come dealt by case are exchanged once at most, and nothing is joined.
    tried = F.col("attempt").isNotNull()
    named = F.col("layer").isNotNull() & F.col("query").isNotNull()
    held = (url != "") & F.col("page").isNotNull() & named
    best = F.struct((-F.length(N.text(F.col("page_text")))).alias("n"), "file", "attempt", "page")
    first = lambda c, at="_o": F.min_by(c, at).alias(c)
    said = F.min(F.when(F.col("_d").isNotNull(), F.col("_o"))).alias("_od")
    say = F.min_by("_d", F.when(F.col("_d").isNotNull(), F.col("_o"))).alias("_d")
    per_url = rows.groupBy(*EPISODE, "layer", "query", F.when(held, url).alias("_u")).agg(
        F.max(tried).alias("_t"), F.min_by(F.struct(*PAGE_FIELDS), best).alias("v"), first("_h"), say, said, F.min("_o").alias("_o")
    )
    again = F.min_by("_d", "_od").alias("_d")
    page = F.when(F.col("_u").isNotNull(), F.struct("_u", "v"))
    per_try = per_url.groupBy(*EPISODE, "layer", "query").agg(
        F.max("_t").alias("_t"), F.array_sort(F.collect_list(page)).alias("p"), first("_h"), again, F.min("_od").alias("_od"), F.min("_o").alias("_o")
    )
    whole = F.col("case_id").isNotNull() & F.col("attribute").isNotNull()
    attempt = F.when(F.col("_t") & whole, F.struct("layer", "query", "p"))
    out = per_try.groupBy(*EPISODE).agg(F.array_sort(F.collect_list(attempt)).alias("a"), first("_h"), again)
    out = out.select(*EPISODE, "_h.*", F.col("_d").alias("final_decision"), F.posexplode_outer("a").alias("attempt", "t"))
    out = out.select("*", F.col("t.layer").alias("layer"), F.col("t.query").alias("query"), F.posexplode_outer("t.p").alias("page", "u"))
    return out.select(*EPISODE, "gold_value", "place", *["final_decision"][:decided], "attempt", "layer", "query", "page", "u.v.*")


def evidence_of(pages: DataFrame) -> DataFrame:
    """Pages as evidence rows for the resolver, in order of attempt and page."""
    rows = pages.filter("page IS NOT NULL").withColumn("extracted_value", evidence_value())
    return rows.withColumn("ordinal", F.col("attempt") * 100_000 + F.col("page"))


def candidates_of(pages: DataFrame, include_gold: bool = True) -> DataFrame:
    """Candidate values per episode: gold (optional), the place's own, then pages' values; of equals the first."""
    place = F.col("place")
    own = [(place["current_value"], -3), (place["base_value"], -2), (F.try_element_at(place, F.col("attribute")), -1)]
    own = ([(F.col("gold_value"), -4)] if include_gold else []) + own
    heads = pages.groupBy(*EPISODE).agg(F.first("gold_value").alias("gold_value"), F.first("place").alias("place"))
    given = heads.select(*EPISODE, F.explode(F.array(*[F.struct(N.text(v).alias("value"), F.lit(i).cast("long").alias("ordinal")) for v, i in own])).alias("x")).select(*EPISODE, "x.*")
    every = given.unionByName(evidence_of(pages).select(*EPISODE, F.col("extracted_value").alias("value"), F.col("ordinal").cast("long")))
    every = every.filter("value != ''").withColumn("norm", N.normalize(F.col("attribute"), F.col("value")))
    return every.groupBy(*EPISODE, "norm").agg(F.min_by("value", "ordinal").alias("value"), F.min("ordinal").alias("ordinal")).drop("norm")


def decisions_of(pages: DataFrame, include_gold: bool = True) -> DataFrame:
    """The resolver's decisions over a corpus, by ``candidates_of`` and ``evidence_of``, in one pass by case; with ``gold_values``."""
    place, held = F.col("place"), F.col("page").isNotNull()
    given = [place["current_value"], place["base_value"], F.try_element_at(place, F.col("attribute"))]
    rows = pages.withColumn("extracted_value", evidence_value()).withColumn("ordinal", F.when(held, F.col("attempt") * 100_000 + F.col("page")))
    return resolver.resolve_pages(rows, [F.col("gold_value"), *given] if include_gold else given)


def website_authority(scored: DataFrame, threshold: float = USEFUL) -> DataFrame:
    """Website episodes: rates of official, place-relevant, generic and finder pages, and of false officials."""
    web = scored.filter("attribute = 'website'")
    held = F.col("page").isNotNull()
    kind = A.page_relevance(F.col("url"), F.col("title"), F.col("page_text"), F.col("source_type"))
    host = lambda c: N.url_host(N.text(c))
    place = F.col("place")
    hosts = F.filter(F.array(*[host(c) for c in (F.col("gold_value"), place["website"], place["current_value"], place["base_value"])]), lambda h: h != "")
    asked = F.exists(hosts, lambda h: F.lower(F.col("query")).contains(F.concat(F.lit("site:"), h)))
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    pages = web.groupBy("case_id").agg(
        flag(held & F.col("source_type").isin(*A.AUTHORITATIVE)).alias("official"), flag(held & kind.isin("place_page", "finder_or_locator")).alias("relevant"),
        flag(held & (kind == "generic_official_homepage")).alias("generic"), flag(held & (kind == "finder_or_locator")).alias("finder"), flag(asked).alias("same_domain"),
    )
    best = best_pages(web).filter(F.col("layer").isin(*TARGETED) & (F.col("score") > 0))
    best = best.groupBy("case_id").agg(F.max(F.struct("score", (-F.col("attempt")).alias("a"), "source_type", "matches")).alias("s"))
    chosen = F.coalesce((F.col("s.score") >= threshold) & F.col("s.source_type").isin(*A.AUTHORITATIVE), F.lit(False))
    rows = pages.join(best, "case_id", "left").withColumn("selected", chosen.cast("int")).withColumn("false", (chosen & ~F.col("s.matches")).cast("int"))
    names = {"official": "official_pages_found", "relevant": "place_relevant_official_found", "generic": "generic_official_homepage_found", "finder": "finder_or_locator_found",
             "same_domain": "same_domain_query_covered", "selected": "selected_official", "false": "false_official"}
    out = rows.agg(F.count("*").alias("total"), *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(n) for c, n in names.items()])
    return out.select("*", *[ratio(F.col(n), F.col("total")).alias(f"{n}_rate") for n in names.values()])


def final_decision_metrics(decisions: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Accuracy, abstention and confident errors, all over all decisions ``attribute, gold_value, decision, confidence, abstained``."""
    g, d = N.normalize(F.col("attribute"), F.col("gold_value")), N.normalize(F.col("attribute"), F.col("decision"))
    right = (d != "") & (d == g) & ~F.col("abstained")
    wrong = ~right & ~F.col("abstained") & (F.col("confidence") >= threshold)
    out = decisions.agg(F.count("*").alias("total"), *[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(n) for c, n in ((F.col("abstained"), "abstained"), (right, "correct"), (wrong, "high_confidence_wrong"))])
    return out.select("*", ratio(F.col("abstained"), F.col("total")).alias("abstention_rate"), ratio(F.col("correct"), F.col("total")).alias("accuracy"), ratio(F.col("high_confidence_wrong"), F.col("total")).alias("high_confidence_wrong_rate"))


def ranker_rows(scored: DataFrame, threshold: float = USEFUL) -> DataFrame:
    """Page rows for training a ranker: score (6 places), match, and whether the page is its attempt's choice."""
    best = best_pages(scored).select(*[F.col(c).alias(f"_{c}") for c in (*EPISODE, "attempt", "url", "score")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*EPISODE, "attempt")]
    rows = scored.filter("page IS NOT NULL").join(best, same[0] & same[1] & same[2])
    chosen = (F.col("url") == F.col("_url")) & (F.col("score") == F.col("_score")) & (F.col("score") >= threshold)
    return rows.select(
        *EPISODE, "attempt", "layer", "query", "page", "url", "source_type", F.round("score", 6).alias("score"), F.col("matches").alias("matched"),
        (F.col("source_type").isin(*A.AUTHORITATIVE) & F.col("matches")).alias("supporting"), chosen.alias("selected"), (chosen & F.col("matches")).alias("selected_correct"),
    )


def holdout(episodes: DataFrame, fraction: float = 0.25) -> DataFrame:
    """Episodes with ``held_out``: the first share of them in order of the SHA-1 of case and attribute.

    At least one and never all; the share is kept between 0.05 and 0.9.
    """
    return episodes.select(*EPISODE).distinct().select(*EPISODE, _digest().alias("digest"), held_out(episodes, fraction).alias("held_out"))


def _digest() -> Column:
    return F.sha1(F.concat(F.col("case_id"), F.char(F.lit(0)), F.col("attribute")).cast("binary"))


def held_out(episodes: DataFrame, fraction: float = 0.25) -> Column:
    """Whether a row's episode is held out, as an expression over any rows with ``case_id, attribute``.

    The bound is the k-th digest: episodes are counted by the digests' beginnings, and only those of
    the bound's beginning are ordered.
    """
    keyed = episodes.select(*EPISODE).distinct().withColumn("digest", _digest())
    start = F.substring("digest", 1, 3)
    counts = {r["s"]: r["n"] for r in keyed.groupBy(start.alias("s")).agg(F.count("*").alias("n")).collect()}  # 4,096 rows at most
    n = sum(counts.values())
    if n < 2:
        return F.lit(False)
    k = min(n - 1, max(1, round(n * min(0.9, max(0.05, fraction)))))
    for s in sorted(counts, key=lambda s: s or ""):
        if k <= counts[s]:
            break
        k -= counts[s]
    edge = keyed.filter(start.eqNullSafe(F.lit(s))).orderBy("digest", *EPISODE).limit(k).agg(F.max(F.struct("digest", *EPISODE)).alias("m")).first()["m"]
    bound = F.struct(*[F.lit(edge[c]).alias(c) for c in ("digest", *EPISODE)])
    return F.struct(_digest().alias("digest"), *EPISODE) <= bound


def nest(pages: DataFrame) -> DataFrame:
    """Long pages to nested episodes: ``search_attempts`` of ``fetched_pages``, in order."""
    page = F.struct("page", *PAGE_FIELDS)
    attempts = pages.groupBy(*EPISODE, "attempt", "layer", "query").agg(F.first("gold_value").alias("gold_value"), F.first("place").alias("place"), F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), page))).alias("p"))
    attempt = F.when(F.col("attempt").isNotNull(), F.struct("attempt", "layer", "query", F.col("p").alias("fetched_pages")))
    out = attempts.groupBy(*EPISODE).agg(F.first("gold_value").alias("gold_value"), F.first("place").alias("place"), F.array_sort(F.collect_list(attempt)).alias("search_attempts"))
    return out
