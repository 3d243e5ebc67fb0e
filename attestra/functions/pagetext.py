"""Claims, weak labels and audits of page texts as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normalize as N
from .authority import AUTHORITATIVE, any_of

# Patterns of claims, and of instructions hidden in untrusted text.
PHONE_PATTERN = r"(?:\+1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}"
URL_PATTERN = r"https?://[^\s\"'<>]+"
SCHEMA_MARKERS = ("schema.org", "ld+json", "localbusiness")
INJECTION_PATTERNS = (r"ignore\s+previous\s+instructions", r"system\s+prompt", r"developer\s+message", r"exfiltrate", r"reveal\s+secrets")
STALE_MARKERS = ("permanently closed", "moved", "formerly", "old location", "duplicate listing")
# Character references that are decoded natively; others stay as written.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def extract_phone(c: Column) -> Column:
    return F.regexp_extract(N.text(c), PHONE_PATTERN, 0)


def extract_website(c: Column) -> Column:
    return F.regexp_extract(N.text(c), URL_PATTERN, 0)


def has_schema_org(c: Column) -> Column:
    return any_of(F.lower(N.text(c)), SCHEMA_MARKERS)


def claims(c: Column) -> Column:
    return F.struct(extract_phone(c).alias("phone"), extract_website(c).alias("website"), has_schema_org(c).alias("has_schema_org"))


def html_text(c: Column) -> Column:
    """Text of a page: no scripts, styles or tags; the common character references decoded; space squeezed."""
    out = F.regexp_replace(N.text(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(N.text(c), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def prompt_audit(c: Column) -> Column:
    """``struct<flagged, matches>``: which patterns of hidden instructions a text holds."""
    low = F.lower(N.text(c))
    hits = F.filter(F.array(*[F.when(low.rlike(p), F.lit(p)) for p in INJECTION_PATTERNS]), lambda x: x.isNotNull())
    return F.struct((F.size(hits) > 0).alias("flagged"), hits.alias("matches"))


def weak_label(candidate: Column, extracted: Column, source_type: Column, page_text: Column) -> Column:
    """``struct<label, confidence, reason>`` for a candidate value against a page."""
    plain = lambda c: N.squeeze(F.lower(N.text(c)))
    strong = source_type.isin(*AUTHORITATIVE)
    make = lambda label, sure, why: F.struct(F.lit(label).alias("label"), sure.alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(any_of(plain(page_text), STALE_MARKERS), make("stale", F.lit(0.8), "stale_page_markers"))
        .when(plain(extracted) == "", make("unclear", F.lit(0.2), "missing_extraction"))
        .when(plain(candidate) == plain(extracted), make("supports", F.when(strong, 0.95).otherwise(0.7), "exact_match"))
        .otherwise(make("contradicts", F.when(strong, 0.9).otherwise(0.6), "value_mismatch"))
    )


def hash_score(c: Column) -> Column:
    """A text's place in [0, 1) by the first 64 bits of its SHA-256."""
    head = F.conv(F.substring(F.sha2(N.text(c).cast("binary"), 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hash_vector(c: Column, dimensions: int = 8) -> Column:
    """Numbers in [0, 1] from successive 16-bit pieces of a text's SHA-256."""
    digest = F.sha2(N.text(c).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("double") / 65535.0 for i in range(dimensions)])
