"""Expectations on single functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestra.functions import authority as A
from attestra.functions import normalize as N
from attestra.functions import pagetext as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (N.normalize_phone, "+1 (831) 555-1212", "8315551212"),
        (N.normalize_phone, "831.555.1212", "8315551212"),
        (N.normalize_phone, None, ""),
        (N.normalize_website, "https://www.Example.com/Shop//a/?q=1#x", "example.com/shop/a"),
        (N.normalize_website, "example.com/", "example.com"),
        (N.normalize_website, "http://user@h.com:80/a;p=1", "user@h.com:80/a"),
        (N.normalize_website, "", ""),
        (N.normalize_address, "100 Main Street, Suite 2, California", "100 main st ste 2 ca"),
        (N.normalize_address, "2 Z.A. de Cromel", "2 za de cromel"),
        (N.normalize_name, "Tom & Sons, Inc.", "tom and sons inc"),
        (N.normalize_category, "Coffee_Shop - bar", "coffee shop bar"),
        (N.website_domain, "https://a.b.org/x/y", "a.b.org"),
        (N.match_phone, "0011 831 555 1212", "8315551212"),
    ],
)
def test_normal_forms(spark, function, value, expected):
    assert one(spark, function(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize(("url", "expected"), [("https://m.yelp.com/biz", True), ("bit.ly/x", True), ("https://notyelp.com", False), ("", False)])
def test_aggregators(spark, url, expected):
    assert one(spark, N.is_social_or_aggregator(F.lit(url))) is expected


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        ("https://sf.ca.gov/x", "government"), ("https://www.bbb.org/a", "business_registry"), ("https://www.google.com/maps/place/x", "google_places"), ("https://maps.google.com/foo", "official_site"),
        ("https://openstreetmap.org/node/1", "osm"), ("https://facebook.com/x", "social"), ("https://m.facebook.com/x", "aggregator"), ("https://www.yelp.com/biz", "aggregator"), ("https://shop.com", "official_site"), ("", "unknown"),
    ],
)
def test_source_kinds(spark, url, kind):
    assert one(spark, A.classify_source(F.lit(url))) == kind


def test_freshness_of_unknown_age_is_nothing(spark):
    none = F.lit(None).cast("double")
    assert one(spark, A.freshness_bonus(none)) == 0.0
    assert one(spark, A.evidence_score(F.lit("aggregator"), none, F.lit(0.0), F.lit(0.0))) == pytest.approx(0.35)
    assert [one(spark, A.freshness_bonus(F.lit(float(d)))) for d in (-5, 30, 31, 90, 180, 181)] == [0.12, 0.12, 0.08, 0.08, 0.04, 0.0]
    assert one(spark, A.staleness_penalty(F.lit(400.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(0.5)


def test_claims_and_weak_labels(spark):
    c = one(spark, P.claims(F.lit("Call (831) 555-1212 or see https://a.com/x. LocalBusiness")))
    assert (c["phone"], c["website"], c["has_schema_org"]) == ("(831) 555-1212", "https://a.com/x.", True)
    label = lambda *a: one(spark, P.weak_label(*[F.lit(x) for x in a]))
    assert label("A  b", "a B", "official_site", "")["confidence"] == 0.95
    assert label("a", "", "official_site", "")["label"] == "unclear"
    assert label("a", "a", "social", "has moved")["label"] == "stale"
    assert label("a", "b", "social", "")["confidence"] == 0.6


def test_hash_score(spark):
    assert one(spark, P.hash_score(F.lit("q"))) == pytest.approx(0.5555078269062165)


def test_page_relevance(spark):
    kind = lambda u, t, s="official_site": one(spark, A.page_relevance(F.lit(u), F.lit(""), F.lit(t), F.lit(s)))
    assert kind("https://a.com/", "") == "generic_official_homepage"
    assert kind("https://a.com/", "our hours") == "place_page"
    assert kind("https://a.com/store-locator", "") == "finder_or_locator"
    assert kind("https://a.com/careers", "hours") == "non_place_path"
    assert kind("https://a.com/", "hours", "social") == "non_place_or_third_party"
