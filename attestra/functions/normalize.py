"""Attribute normalizers as native column expressions.

Nulls are treated as empty strings throughout, and every function returns a non-null string, so
that two missing values compare equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five attributes that are decided.
ATTRIBUTES = ("website", "phone", "address", "category", "name")
#: What a policy predicts when it does not decide.
ABSTAIN = "__ABSTAIN__"

# Domains whose pages are not a place's own website.
SOCIAL_OR_AGGREGATOR_DOMAINS = (
    "facebook.com",
    "instagram.com",
    "yelp.com",
    "tripadvisor.com",
    "doordash.com",
    "ubereats.com",
    "grubhub.com",
    "opentable.com",
    "foursquare.com",
    "bit.ly",
    "goo.gl",
    "lnkd.in",
    "ow.ly",
    "t.co",
    "tinyurl.com",
)
# Words of addresses and their short forms, applied in this order.
ADDRESS_WORDS = (("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("road", "rd"), ("suite", "ste"), ("california", "ca"))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def one_of_domains(domains) -> str:
    """A pattern for a domain that is one of ``domains`` or below one."""
    return r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in domains) + ")$"


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))  # most texts have no such end, and the pattern tries every place
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_phone(c: Column) -> Column:
    """Digits only; a leading 1 of eleven digits goes."""
    digits = F.regexp_replace(text(c), r"[^\p{Nd}]+", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def _after_scheme(c: Column) -> Column:
    raw = F.lower(strip(text(c)))
    return F.regexp_replace(F.regexp_replace(raw, r"^([a-z][a-z0-9+.\-]*:)?//", ""), r"[?#].*$", "")


def url_host(c: Column) -> Column:
    """Lower-case host (with user and port) without ``www.``."""
    return F.regexp_replace(F.regexp_extract(_after_scheme(c), r"^([^/]*)", 1), r"^www\.", "")


def url_path(c: Column) -> Column:
    """Lower-case path with its leading slash, as written."""
    return F.regexp_extract(_after_scheme(c), r"^[^/]*(.*)$", 1)


def normalize_website(c: Column) -> Column:
    """Host and path: no scheme, ``www.``, query, fragment, parameters, doubled or trailing slashes."""
    path = F.regexp_replace(url_path(c), r";[^/]*$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"/$", "")
    return F.concat(url_host(c), path)


def website_domain(c: Column) -> Column:
    return F.substring_index(normalize_website(c), "/", 1)


def is_social_or_aggregator(c: Column) -> Column:
    return website_domain(c).rlike(one_of_domains(SOCIAL_OR_AGGREGATOR_DOMAINS))


def normalize_name(c: Column) -> Column:
    low = F.regexp_replace(F.lower(text(c)), "&", " and ")
    return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def normalize_address(c: Column) -> Column:
    """Short forms of six words, letters and digits only, single letters joined in pairs."""
    out = F.lower(text(c))
    for word, short in ADDRESS_WORDS:
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    out = F.regexp_replace(out, r"[^a-z0-9]+", " ")
    return squeeze(F.regexp_replace(out, r"\b([a-z])\s+([a-z])\b", "$1$2"))


def normalize_category(c: Column) -> Column:
    return squeeze(F.translate(F.lower(text(c)), "_-", "  "))


#: Extension point: attribute -> function of a column.
NORMALIZERS = {
    "phone": normalize_phone,
    "website": normalize_website,
    "address": normalize_address,
    "name": normalize_name,
    "category": normalize_category,
}


def normalize(attribute: Column, value: Column) -> Column:
    """The normal form of ``value`` for rows that name their attribute."""
    out = None
    for name, function in NORMALIZERS.items():
        out = F.when(attribute == name, function(value)) if out is None else out.when(attribute == name, function(value))
    return out.otherwise(F.lower(strip(text(value))))


# ------------------------------------------------------------------ the matcher's own, simpler forms


def match_text(c: Column) -> Column:
    return squeeze(F.translate(F.lower(text(c)), ",.", "  "))


def match_phone(c: Column) -> Column:
    """The last ten digits."""
    digits = F.regexp_replace(text(c), r"[^\p{Nd}]+", "")
    return F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits)


def name_tokens(c: Column) -> Column:
    """Distinct words of a name without the commonest."""
    words = F.split(normalize_name(c), " ")
    return F.array_distinct(F.filter(words, lambda w: ~w.isin("", "the", "and", "at", "of")))


def domain_tokens(c: Column) -> Column:
    """Distinct alphanumeric parts of the first label of a website's host."""
    host = F.substring_index(website_domain(c), ".", 1)
    return F.array_distinct(F.filter(F.split(host, r"[^a-z0-9]+"), lambda w: ~w.isin("", "www")))
