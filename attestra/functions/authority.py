"""Source authority, freshness and page evidence as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normalize as N

# Domains of sites that list, book or link to places.
AGGREGATOR_DOMAINS = (
    "yelp.com",
    "tripadvisor.com",
    "foursquare.com",
    "facebook.com",
    "instagram.com",
    "doordash.com",
    "ubereats.com",
    "grubhub.com",
    "airbnb.com",
    "vrbo.com",
    "homeaway.com",
    "booking.com",
    "expedia.com",
    "hotels.com",
    "agoda.com",
    "orbitz.com",
    "travelocity.com",
    "discogs.com",
    "opentable.com",
    "octotable.com",
    "linktr.ee",
    "taplink.cc",
    "goo.gl",
    "bit.ly",
    "tinyurl.com",
    "justgiving.com",
    "gofundme.com",
    "eventbrite.com",
    "meetup.com",
    "youtube.com",
    "youtu.be",
    "pinterest.com",
    "wa.me",
    "yext-cdn.com",
    "site-solocal.com",
    "jimdosite.com",
)
# Other domains that name a kind of source.
BUSINESS_REGISTRY_DOMAINS = ("bbb.org", "opencorporates.com", "bizapedia.com", "dnb.com", "corporationwiki.com")
# Words that raise or lower a page's rank.
CONTACT_HINTS = ("contact", "about", "locations", "location", "store locator", "store-locator", "directions")
FRESH_HINTS = ("current", "updated", "open now", "now open", "hours", "verified", "today", "latest")
STALE_HINTS = (
    "permanently closed",
    "temporarily closed",
    "moved",
    "former",
    "formerly",
    "old location",
    "under new ownership",
    "duplicate listing",
    "claimed listing",
    "directory",
    "listing",
    "reviews",
    "review",
    "aggregate",
    "outdated",
    "stale",
)
REVIEW_HINTS = ("reviews", "review", "directory", "listing", "aggregate")
SERVICE_HINTS = ("phone", "tel", "address", "hours", "menu", "services")
# What each word in a path adds.
PATH_BONUS = (
    ("contact", 0.05),
    ("about", 0.04),
    ("locations", 0.04),
    ("location", 0.03),
    ("store-locator", 0.05),
    ("store locator", 0.05),
    ("hours", 0.03),
    ("menu", 0.03),
    ("services", 0.03),
    ("directions", 0.03),
    ("home", 0.02),
)
# Base rank of a source's kind when pages are retrieved, and when evidence is weighed.
RETRIEVAL_RANK = {
    "official_site": 0.78,
    "government": 0.96,
    "business_registry": 0.9,
    "google_places": 0.82,
    "osm": 0.7,
    "social": 0.45,
    "aggregator": 0.35,
    "unknown": 0.2,
}
EVIDENCE_RANK = {
    "official_site": 1.0,
    "government": 0.95,
    "business_registry": 0.9,
    "google_places": 0.8,
    "osm": 0.65,
    "social": 0.45,
    "aggregator": 0.35,
    "unknown": 0.2,
}
AUTHORITATIVE = ("official_site", "government", "business_registry")
NOT_CITED = ("aggregator", "social")
LAYER_BONUS = {"official": 0.05, "corroboration": 0.02, "freshness": 0.03, "fallback": -0.02}


def any_of(c: Column, words) -> Column:
    """Whether a text holds any of the words, as plain substrings."""
    return c.rlike("|".join(w.replace(".", r"\.").replace("+", r"\+") for w in words))


def look_up(key: Column, table: dict, default: float) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for k, v in table.items():
        out = out.when(key == k, F.lit(float(v)))
    return out.otherwise(F.lit(float(default)))


def classify_source(url: Column) -> Column:
    """Kind of source a URL points to; the first rule that holds decides."""
    return classify_site(N.url_host(url), N.url_path(url))


def classify_site(host: Column, path: Column) -> Column:
    """``classify_source`` of a URL whose host and path are columns already."""
    below = lambda *d: host.rlike(N.one_of_domains(d))
    google = host.isin("google.com", "maps.google.com") | host.endswith(".google.com")
    osm = host.isin("openstreetmap.org", "osm.org") | host.endswith(".openstreetmap.org")
    return (
        F.when(host.endswith(".gov"), "government")
        .when(below(*BUSINESS_REGISTRY_DOMAINS), "business_registry")
        .when(google & path.rlike("/maps|/place|/search"), "google_places")
        .when(osm, "osm")
        .when(host.isin("facebook.com", "instagram.com"), "social")
        .when(below(*AGGREGATOR_DOMAINS), "aggregator")
        .when(host != "", "official_site")
        .otherwise("unknown")
    )


def rank_source(url: Column, page_text: Column, query: Column) -> Column:
    """Authority of a fetched page: its source's kind, plus what its path, text and query tell."""
    return rank_page(classify_source(url), N.url_host(url), N.url_path(url), F.lower(N.text(page_text)), F.lower(N.text(query)))


def rank_page(kind: Column, host: Column, path: Column, words: Column, asked: Column) -> Column:
    """``rank_source`` where what it reads of a page is in columns already."""
    add = lambda condition, x: F.when(condition, x).otherwise(0.0)
    official = kind == "official_site"
    bonus = add(official & (host != ""), 0.03)
    bonus = bonus + add(official & path.isin("", "/", "/index.html", "/index.htm"), 0.02)
    bonus = bonus + add(any_of(words, CONTACT_HINTS) | any_of(path, CONTACT_HINTS), 0.03)
    bonus = bonus + add(any_of(words, SERVICE_HINTS), 0.03)
    for word, x in PATH_BONUS:
        bonus = bonus + add(path.contains(word), x)
    bonus = bonus + add(any_of(words, ("schema.org", "ld+json")), 0.04)
    bonus = bonus + add(any_of(words, FRESH_HINTS) | any_of(path, ("current", "updated", "hours")), 0.02)
    bonus = bonus + add(asked.contains("site:") & (host != "") & asked.contains(host), 0.06)
    bonus = bonus + add(any_of(words, REVIEW_HINTS), -0.04)
    bonus = bonus + add(any_of(words, STALE_HINTS), -0.08)
    bonus = bonus + add(asked.contains("official") & official, 0.04)
    bonus = bonus + add((asked != "") & words.contains(asked), 0.02)
    return F.least(F.lit(1.0), look_up(kind, RETRIEVAL_RANK, 0.2) + bonus)


def freshness_bonus(days: Column) -> Column:
    # A null age compares as null and so gives no bonus; negative ages are fresh.
    return F.when(days <= 30, 0.12).when(days <= 90, 0.08).when(days <= 180, 0.04).otherwise(0.0)


def staleness_penalty(days: Column, zombie: Column, identity: Column) -> Column:
    aged = F.when(days > 365, 0.15).when(days > 180, 0.05).otherwise(0.0)
    doubts = F.greatest(F.coalesce(zombie, F.lit(0.0)), F.lit(0.0)) * 0.20 + F.greatest(F.coalesce(identity, F.lit(0.0)), F.lit(0.0)) * 0.15
    return F.least(F.lit(0.5), aged + doubts)


def adjusted_score(base: Column, days: Column, zombie: Column, identity: Column) -> Column:
    """A base rank moved by freshness and doubts, kept between 0 and 1; unknown ages move nothing."""
    score = base + freshness_bonus(days) - staleness_penalty(days, zombie, identity)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def evidence_score(source_type: Column, days: Column, zombie: Column, identity: Column, rank: Column | None = None) -> Column:
    base = look_up(source_type, EVIDENCE_RANK, EVIDENCE_RANK["unknown"])
    return adjusted_score(base if rank is None else F.coalesce(rank, base), days, zombie, identity)


def search_score(url: Column, title: Column, snippet: Column, query: Column, layer: Column, days: Column, zombie: Column, identity: Column, model: Column | None = None) -> Column:
    """Score of a search result: rank, freshness and layer; with a model's score, 0.4 and 0.6 of each."""
    return ranked_score(rank_source(url, search_words(title, snippet), query), layer, days, zombie, identity, model)


def search_words(title: Column, snippet: Column) -> Column:
    return F.concat_ws(" ", F.nullif(N.text(title), F.lit("")), F.nullif(N.text(snippet), F.lit("")))


def ranked_score(rank: Column, layer: Column, days: Column, zombie: Column, identity: Column, model: Column | None = None) -> Column:
    """``search_score`` of a page whose rank is a column already."""
    score = adjusted_score(rank, days, zombie, identity) + look_up(layer, LAYER_BONUS, 0.0)
    if model is not None:
        score = score * 0.4 + model * 0.6
    return F.least(F.lit(1.0), score)


# Words of paths and texts that tell what a page is for.
ASIDE_PATHS = ("privacy", "terms", "careers", "jobs", "press", "blog", "news", "sitemap")
FINDER_PATHS = ("store-locator", "storelocator", "locator", "locations", "location")
PLACE_PATHS = ("contact", "about", "location", "locations", "branch", "branches", "store", "stores", "outlet", "outlets", "directions")
PLACE_WORDS = ("address", "phone", "hours", "menu", "location", "locations", "contact", "find us", "visit us", "directions")


def page_relevance(url: Column, title: Column, page_text: Column, source_type: Column) -> Column:
    """What a page says about one place: six buckets, the first that holds."""
    path = N.url_path(url)
    words = F.lower(F.concat(N.text(title), F.lit(" "), N.text(page_text)))
    return (
        F.when(~source_type.isin(*AUTHORITATIVE), "non_place_or_third_party")
        .when(any_of(path, ASIDE_PATHS), "non_place_path")
        .when(any_of(path, FINDER_PATHS), "finder_or_locator")
        .when(path.isin("", "/", "/index.html", "/index.htm") & ~any_of(words, PLACE_WORDS), "generic_official_homepage")
        .when(any_of(path, PLACE_PATHS) | any_of(words, PLACE_WORDS), "place_page")
        .otherwise("unknown_place_relevance")
    )
