"""Search-query plans: templates per attribute and layer, audits, queues and work plans.

A place is a row of ``name, city, region, address, phone, website`` (any may be null).  Queries are
arrays built from templates and exploded with their positions, so order is explicit throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import authority as A
from ..functions import normalize as N
from .metrics import ratio

# Sites that queries leave out, and the sources each layer prefers.
EXCLUDED_SITES = ("yelp.com", "tripadvisor.com", "facebook.com", "instagram.com", "doordash.com", "ubereats.com", "grubhub.com")
LAYERS = ("official", "corroboration", "freshness", "fallback")
PREFERRED = {
    "official": ("official_site", "government", "business_registry"),
    "corroboration": ("official_site", "google_places", "osm", "social"),
    "freshness": ("official_site", "google_places", "osm"),
    "fallback": ("google_places", "osm", "social", "aggregator"),
}
# Query templates.  ``{x}`` is a quoted field, ``{minus}`` the exclusions, ``{domain}``
# the known website's host; a template that names ``{domain}`` is dropped where none is known, and
# one that ends in ``?phone`` where the phone is not.
OFFICIAL = {
    "website": (
        "{name} {city} official website {minus}",
        "{name} {address} {city} {minus}",
        "intitle:{name} {city} contact OR locations {minus}",
        "inurl:locations {name} {city} contact",
        "site:.gov {name} {city} business license OR registry",
        "site:bbb.org {name} {city}",
        "site:{domain} contact OR about OR locations OR store-locator",
        "site:{domain} schema.org OR ld+json",
        "site:{domain} {phone}?phone",
    ),
    "phone": (
        "{phone} {name} official contact",
        "{name} {city} phone {minus}",
        "{name} {city} contact OR hours {minus}",
        "site:.gov {name} {city} license OR registry",
        "site:google.com/maps {name} {city} phone",
        "site:openstreetmap.org {name} {city} phone",
        "site:{domain} {phone}",
        "site:{domain} contact OR locations OR hours OR tel",
        "site:{domain} schema.org OR ld+json",
    ),
    "address": (
        "{name} {address}",
        "{name} {city} address {minus}",
        "{address} {city} {region} {minus}",
        "site:.gov {name} {city} address OR permit OR license",
        "site:{domain} {address}",
        "site:{domain} directions OR locations OR contact",
        "site:{domain} schema.org OR ld+json",
    ),
    "category": (
        "{name} {city} services menu about {minus}",
        "{name} {city} {region} category",
        "{name} {city} schema.org LocalBusiness OR Organization {minus}",
        "site:openstreetmap.org {name} {city}",
        "site:{domain} about OR services OR menu",
        "site:{domain} schema.org LocalBusiness OR Organization",
        "site:{domain} contact OR locations",
    ),
    "name": (
        "{address} {city} business name",
        "{phone} {address}",
        "{name} {address} {city} {minus}",
        "{name} {city} official OR contact {minus}",
        "site:.gov {address} {city} business OR license",
        "site:opencorporates.com {name} {region}",
        "site:bbb.org {name} {city}",
        "site:google.com/maps {name} {address}",
        "site:openstreetmap.org {address} {city}",
        "site:{domain} about OR contact OR locations",
        "site:{domain} schema.org LocalBusiness OR Organization",
        "site:{domain} {name}",
    ),
}
_PLACE = (
    "{name} {city} {region} official OR contact OR about",
    "{name} {address} {city}",
    "{phone} {name}?phone",
    "site:google.com/maps {name} {city}",
    "site:openstreetmap.org {name} {city}",
    "site:{domain} contact OR about OR locations",
)
CORROBORATION = {
    "website": _PLACE,
    "phone": _PLACE,
    "address": _PLACE,
    "category": (
        "{name} {city} services OR menu OR about",
        "site:{domain} schema.org LocalBusiness",
        "site:openstreetmap.org {name} {city}",
        "site:google.com/maps {name} {city} category",
        "site:{domain} services OR menu OR about",
    ),
    "name": ("{name} {city}", "{address} {city}", "site:google.com/maps {name}", "site:{domain} about OR contact OR locations"),
}
_OPEN = (
    "{name} {city} open now hours contact",
    "{name} {city} updated contact hours",
    "{name} {city} current address phone",
    "{name} {city} moved OR permanently closed OR formerly",
)
FRESHNESS = {
    "website": _OPEN,
    "phone": _OPEN,
    "address": _OPEN,
    "category": (
        "{name} {city} current menu services hours",
        "{name} {city} updated about services",
        "site:{domain} hours menu updated",
        "{name} {city} new menu OR current services OR latest",
    ),
    "name": ("{name} {city} updated", "{name} {city} current", "{name} {city} former OR formerly OR moved"),
}
# What an audit looks for in a query.
OPERATORS = ("site:", "-site:", "intitle:", "inurl:", "OR", '"')
AUTHORITY_WORDS = ("official", "site:", "contact", "locations", "directions", "schema.org", "license", "registry", "permit")
#: Least shares of a plan's queries, and the greatest share of fallbacks.
AUDIT_THRESHOLDS = {"operator_coverage": 0.75, "quoted_anchor_coverage": 0.70, "site_restricted_coverage": 0.35, "authority_coverage": 0.60}
MAX_FALLBACK_SHARE = 0.12
# Orders of work.
PRIORITY_ORDER = {"needs_evidence": 0, "baseline_wrong": 1, "baseline_missing": 2, "low": 3}
ATTRIBUTE_ORDER = {"website": 0, "name": 1, "category": 2}
LAYER_ORDER = {"official": 0, "government": 1, "business_registry": 2, "registry": 3, "corroboration": 4, "freshness": 5, "fallback": 6}


def quoted(c: Column) -> Column:
    plain = N.strip(N.text(c))
    return F.when(plain == "", "").otherwise(F.concat(F.lit('"'), plain, F.lit('"')))


def loose_query() -> Column:
    parts = [F.nullif(N.text(F.col(x)), F.lit("")) for x in ("name", "city", "region")]
    return N.strip(F.concat_ws(" ", *parts))


def _fill(template: str, fields: dict[str, Column]) -> Column:
    """A template as a column; null where a field it depends on is missing."""
    body, _, needs = template.partition("?")
    pieces = []
    for i, part in enumerate(body.replace("}", "{").split("{")):
        pieces.append(fields[part] if i % 2 else F.lit(part))
    query = N.strip(F.concat(*pieces))
    if "{domain}" in body:
        query = F.when(fields["domain"] != "", query)
    if needs:
        query = F.when(fields[needs] != "", query)
    return F.when(query != "", query)


def with_plan_fields(places: DataFrame) -> DataFrame:
    """Places with the columns that ``plan`` reads.

    What many templates hold is computed in a step of its own: inside them each mention would be evaluated again.
    """
    fields = {x: quoted(F.col(x)) for x in ("name", "city", "region", "address", "phone")} | {"domain": N.website_domain(F.col("website")), "loose": loose_query()}
    return places.withColumns({f"_plan_{x}": c for x, c in fields.items()})


def plan() -> Column:
    """``array<struct<layer, queries>>`` of the row's place and ``attribute``: its four layers in order; the row is of ``with_plan_fields``."""
    fields = {x: F.col(f"_plan_{x}") for x in ("name", "city", "region", "address", "phone", "domain")}
    fields["minus"] = F.lit(" ".join(f"-site:{d}" for d in EXCLUDED_SITES))
    loose = F.col("_plan_loose")

    def layer(name: str, by_attribute: dict, other: Column) -> Column:
        queries = None
        for attribute, templates in by_attribute.items():
            made = F.filter(F.array(*[_fill(t, fields) for t in templates]), lambda q: q.isNotNull())
            queries = F.when(F.col("attribute") == attribute, made) if queries is None else queries.when(F.col("attribute") == attribute, made)
        return F.struct(F.lit(name).alias("layer"), queries.otherwise(other).alias("queries"))

    others = lambda table: F.filter(F.array(*[_fill(t, fields) for t in table["name"]]), lambda q: q.isNotNull())
    anchor = F.coalesce(*[F.nullif(x, F.lit("")) for x in (loose, fields["domain"], N.text(F.col("website")), fields["address"], fields["phone"])], F.lit(""))
    fallback = F.struct(F.lit("fallback").alias("layer"), F.array(anchor).alias("queries"))
    return F.array(
        layer("official", OFFICIAL, F.filter(F.array(loose), lambda q: q != "")), layer("corroboration", CORROBORATION, others(CORROBORATION)),
        layer("freshness", FRESHNESS, others(FRESHNESS)), fallback,
    )


def plan_rows(places: DataFrame, keep: list[str]) -> DataFrame:
    """One row per query: ``keep``, ``attribute, layer, position, query, preferred_sources``."""
    layers = with_plan_fields(places).select(*keep, "attribute", F.posexplode(plan()).alias("_l", "v"))
    rows = layers.select(*keep, "attribute", "_l", "v.layer", F.posexplode("v.queries").alias("_q", "query"))
    preferred = F.when(F.lit(False), F.lit(""))
    for name, kinds in PREFERRED.items():
        preferred = preferred.when(F.col("layer") == name, F.lit(",".join(kinds)))
    return rows.select(*keep, "attribute", "layer", (F.col("_l") * 100 + F.col("_q")).alias("position"), "query", preferred.alias("preferred_sources"))


def audit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of kinds of queries per group of plan rows."""
    q, low = F.col("query"), F.lower(F.col("query"))
    kinds = {
        "operator": F.lit(False),
        "quoted_anchor": F.length(q) - F.length(F.replace(q, F.lit('"'), F.lit(""))) >= 2,
        "site_restricted": q.contains("site:"),
        "exclusion": q.contains("-site:"),
        "fallback": F.col("layer") == "fallback",
        "authority": A.any_of(low, AUTHORITY_WORDS),
    }
    kinds["operator"] = A.any_of(q, OPERATORS)
    out = rows.groupBy(*by).agg(F.count("*").alias("total_queries"), *[F.sum(k.cast("int")).alias(f"{n}_queries") for n, k in kinds.items()])
    shares = [ratio(F.col(f"{n}_queries"), F.col("total_queries")).alias("fallback_share" if n == "fallback" else f"{n}_coverage") for n in kinds]
    return out.select("*", *shares)


def audit_gate(summary: DataFrame) -> DataFrame:
    """Whether an audit's shares reach their thresholds, check by check."""
    checks = [(F.col(n) >= t).alias(f"{n}_ok") for n, t in AUDIT_THRESHOLDS.items()] + [(F.col("fallback_share") <= MAX_FALLBACK_SHARE).alias("fallback_share_ok")]
    named = summary.select("*", *checks)
    every = F.col("fallback_share_ok")
    for n in AUDIT_THRESHOLDS:
        every = every & F.col(f"{n}_ok")
    return named.withColumn("passed", every)


def conflict_places(conflicts: DataFrame) -> DataFrame:
    """Conflict rows with a place to search for: whichever value of the attribute is at hand."""
    value = F.coalesce(F.nullif(N.text(F.col("current_value")), F.lit("")), N.text(F.col("base_value")))
    have = set(conflicts.columns)
    given = lambda c: N.text(F.col(c)) if c in have else F.lit("")
    at = lambda *names: F.col("attribute").isin(*names)
    return conflicts.withColumns(
        {
            "name": F.when(at("name", "category"), value).otherwise(given("name")), "city": given("city"), "region": given("region"),
            "address": F.when(at("address"), value).otherwise(""), "phone": F.when(at("phone"), value).otherwise(""), "website": F.when(at("website"), value).otherwise(""),
        }
    )


def priority() -> Column:
    return (
        F.when(~F.col("correct"), "baseline_wrong").when(N.strip(N.text(F.col("prediction"))) == "", "baseline_missing").when(F.col("needs_evidence"), "needs_evidence").otherwise("low")
    )


CASE = ["id", "base_id", "truth", "truth_source", "prediction", "baseline", "correct", "needs_evidence", "current_value", "base_value"]


def conflict_queries(conflicts: DataFrame, max_queries: int = 8) -> DataFrame:
    """Capped queries per conflict: the first in order, the last place kept for a fallback.

    Conflicts whose values agree in normal form and are right have nothing to find and are left out.
    """
    same = N.normalize(F.col("attribute"), F.col("current_value")) == N.normalize(F.col("attribute"), F.col("base_value"))
    wanted = conflict_places(conflicts.filter(~(same & F.col("correct")))).withColumn("priority", priority())
    rows = plan_rows(wanted, [*CASE, "priority"]).filter("query != ''")
    first = F.lit(",".join(PREFERRED["official"]))
    if max_queries <= 0:
        return rows.withColumn("preferred_sources", first)
    case = Window.partitionBy("id", "base_id", "attribute", "baseline")
    last = F.col("layer") == "fallback"
    rank = F.row_number().over(case.orderBy(last.cast("int"), "position"))  # fallbacks come last anyway
    sized = rows.withColumn("_n", F.count("*").over(case)).withColumn("_r", rank).withColumn("_f", F.sum(last.cast("int")).over(case))
    room = F.when(F.col("_f") > 0, max_queries - 1).otherwise(max_queries)
    kept = (F.col("_n") <= max_queries) | (~last & (F.col("_r") <= room)) | (last & (F.col("_r") == F.col("_n") - F.col("_f") + 1))
    return sized.filter(kept).drop("_n", "_r", "_f").withColumn("preferred_sources", first)


def batches_by_case(queries: DataFrame, cases_per_batch: int = 25) -> DataFrame:
    """Query rows with ``batch`` (from 1): slices of cases in order of their least id."""
    if cases_per_batch < 1:
        raise ValueError("a batch holds at least one case")
    return _slices(queries, [F.col("id"), F.col("base_id")], ["id", "base_id"], cases_per_batch)


def _slices(rows: DataFrame, order: list[Column], keys: list[str], size: int) -> DataFrame:
    """Batch numbers over the table of cases (not of queries), joined back."""
    cases = rows.select(*keys).distinct().withColumn("batch", F.expr(f"cast((row_number() over (order by {', '.join(keys)}) - 1) div {size} + 1 as int)"))
    named = cases.select(*[F.col(k).alias(f"_{k}") for k in keys], "batch")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(named, condition).drop(*[f"_{k}" for k in keys])


def workplan(queries: DataFrame, evidenced: DataFrame | None = None, cases_per_batch: int = 10, max_batches: int = 20, scores: DataFrame | None = None) -> DataFrame:
    """Batches of the most useful cases that have no evidence yet.

    ``evidenced``: ``id, attribute`` with pages already; ``scores``: ``id, attribute, score`` from a
    trained model (absent: 0).  Ordered by score, priority, attribute, best layer, ids and least query.
    """
    rows = queries.filter(F.col("attribute").isin(*ATTRIBUTE_ORDER))
    if evidenced is not None:
        rows = rows.join(evidenced.select("id", "attribute").distinct(), ["id", "attribute"], "left_anti")
    order = lambda c, table: A.look_up(F.col(c), table, 99).cast("int")
    per = rows.groupBy("id", "attribute").agg(
        F.min(order("priority", PRIORITY_ORDER)).alias("p"), F.min(order("layer", LAYER_ORDER)).alias("l"), F.min("base_id").alias("base"), F.min("query").alias("q"), F.count("*").alias("queries")
    )
    per = per.withColumn("score", F.lit(0.0)) if scores is None else per.join(scores, ["id", "attribute"], "left").fillna(0.0, ["score"])
    ranked = Window.orderBy(F.desc("score"), "p", order("attribute", ATTRIBUTE_ORDER), "l", "base", "id", "q")
    # Only the first batches are wanted: a top-k, before any case is numbered.
    top = per.orderBy(F.desc("score"), "p", order("attribute", ATTRIBUTE_ORDER), "l", "base", "id", "q").limit(cases_per_batch * max_batches)
    return top.withColumn("place", F.row_number().over(ranked)).select(
        F.expr(f"cast((place - 1) div {cases_per_batch} + 1 as int)").alias("batch"), "place", "id", F.col("base").alias("base_id"), "attribute", "score", "queries"
    )


#: Share of a batch's rows that each attribute adds to its public score.
PUBLIC_WEIGHTS = {"website": 1.0, "category": 0.75, "name": 0.0}


def public_subset(batch_rows: DataFrame, k: int, weights: dict[str, float] = PUBLIC_WEIGHTS) -> DataFrame:
    """The ``k`` batches with the most public signal per row, then the most urgent, then the first."""
    signal = A.look_up(F.col("attribute"), weights, 0.0)
    urgency = F.lit(3.0) - A.look_up(F.col("priority"), PRIORITY_ORDER, 3.0)
    scored = batch_rows.groupBy("batch").agg(F.count("*").alias("rows"), F.round(F.avg(signal), 9).alias("public_score"), F.round(F.avg(urgency), 9).alias("urgency"))
    return scored.orderBy(F.desc("public_score"), F.desc("urgency"), "batch").limit(k)
