"""DuckDB SQL for the registered queries, written from the rules, not from the Spark plans."""

from __future__ import annotations

from ..functions import authority as A
from ..functions import normalize as N
from ..functions import pagetext as P
from ..operators import policies, queryplan, resolver
from .fixtures import EVIDENCE, PAIRS, PLACES

_PAIRS = PAIRS.replace("{part}", "part")
_EVIDENCE = EVIDENCE.replace("{lineitem}", "lineitem")


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rx(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(to)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def t(x: str) -> str:
    return f"coalesce({x}, '')"


def phone(x: str) -> str:
    d = rx(t(x), r"[^0-9]+")
    return f"(CASE WHEN length({d}) = 11 AND starts_with({d}, '1') THEN substr({d}, 2) ELSE {d} END)"


def _bare(x: str) -> str:
    return rx(rx(f"lower(trim({t(x)}))", r"^([a-z][a-z0-9+.\-]*:)?//"), r"[?#].*$")


def host(x: str) -> str:
    return rx(f"split_part({_bare(x)}, '/', 1)", r"^www\.")


def path(x: str) -> str:
    return rx(_bare(x), r"^[^/]*")


def site(x: str) -> str:
    return f"concat({host(x)}, {rx(rx(rx(path(x), r';[^/]*$'), r'/+', '/'), r'/$')})"


def domain(x: str) -> str:
    return f"split_part({site(x)}, '/', 1)"


def aggregator(x: str) -> str:
    return has(domain(x), N.one_of_domains(N.SOCIAL_OR_AGGREGATOR_DOMAINS))


def name(x: str) -> str:
    return f"trim({rx(f'''replace(lower({t(x)}), '&', ' and ')''', r'[^a-z0-9]+', ' ')})"


def address(x: str) -> str:
    out = f"lower({t(x)})"
    for word, short in N.ADDRESS_WORDS:
        out = rx(out, rf"\b{word}\b", short)
    out = rx(out, r"[^a-z0-9]+", " ")
    return f"trim({rx(rx(out, r'\b([a-z])\s+([a-z])\b', r'\1\2'), r'\s+', ' ')})"


def category(x: str) -> str:
    return f"trim({rx(f'''translate(lower({t(x)}), '_-', '  ')''', r'\s+', ' ')})"


FORMS = {"website": site, "phone": phone, "address": address, "category": category, "name": name}


def norm(attribute: str, x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {attribute} = '{a}' THEN {f(x)}" for a, f in FORMS.items()) + f" ELSE lower(trim({t(x)})) END)"


LONG = "WITH pairs AS (" + _PAIRS + "), long AS (" + " UNION ALL ".join(
    f"SELECT id, base_id, truth_choice, '{a}' AS attribute, {t(a)} AS cur, {t('base_' + a)} AS bas, confidence AS c, base_confidence AS b, name AS n, base_name AS bn, website AS w, base_website AS bw, "
    f"{FORMS[a](a)} AS cn, {FORMS[a]('base_' + a)} AS bsn FROM pairs" for a in N.ATTRIBUTES
) + ")"

_AB = _q(N.ABSTAIN)
_ORA = lambda x: f"(CASE WHEN {x} = '' THEN {_AB} ELSE {x} END)"


def _settled(p: str, c: str) -> tuple[str, str]:
    pre = "CASE WHEN cur <> '' AND bas <> '' AND cn = bsn THEN {0} WHEN cur <> '' AND bas = '' THEN {1} WHEN bas <> '' AND cur = '' THEN {2} ELSE {3} END"
    return pre.format("cur", "cur", "bas", p), pre.format("1.0", "c", "b", c)


def _name_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({name(x)}, ' '), lambda v: v NOT IN ('', 'the', 'and', 'at', 'of')))"


def _domain_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(split_part({domain(x)}, '.', 1), '[^a-z0-9]+'), lambda v: v NOT IN ('', 'www')))"


def _site_quality(nm: str, w: str) -> str:
    o = f"len(list_intersect({_name_tokens(nm)}, {_domain_tokens(w)}))"
    return (
        f"(CASE WHEN {w} = '' THEN -1.0::DOUBLE ELSE (CASE WHEN {site(w)} = {domain(w)} THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN {aggregator(w)} THEN 0::DOUBLE ELSE 1 END)"
        f" + (CASE WHEN {o} > 0 THEN 0.6::DOUBLE + 0.1::DOUBLE * least({o}, 3) ELSE 0 END) - (CASE WHEN length({site(w)}) - length(replace({site(w)}, '/', '')) > 1 THEN 0.15::DOUBLE ELSE 0 END) END)"
    )


def _name_quality(nm: str, w: str) -> str:
    o = f"len(list_intersect({_name_tokens(nm)}, {_domain_tokens(w)}))"
    return (
        f"(CASE WHEN {nm} = '' THEN -1.0::DOUBLE ELSE least(len({_name_tokens(nm)}), 4) * 0.15::DOUBLE + (CASE WHEN {o} > 0 THEN 0.7::DOUBLE + 0.1::DOUBLE * least({o}, 2) ELSE 0 END)"
        f" - (CASE WHEN {has(nm, '[0-9]')} THEN 0.1::DOUBLE ELSE 0 END) END)"
    )


def _locality(w: str) -> str:
    p = f"trim(CASE WHEN contains({site(w)}, '/') THEN substr({site(w)}, strpos({site(w)}, '/') + 1) ELSE '' END, '/')"
    return f"(CASE WHEN {p} IN ('', 'home', 'home.html', 'index.html', 'index.htm') THEN 0 ELSE 1 + (CASE WHEN {any_of(p, policies.PLACE_PATH_TOKENS)} THEN 2 ELSE 0 END) + (CASE WHEN contains({p}, '/') THEN 1 ELSE 0 END) END)"


def _policy(baseline: str, low: str = "0.90", margin: str = "0.10") -> tuple[str, str]:
    """Prediction and confidence of a policy as SQL."""
    by = (
        f"CASE WHEN c >= b THEN {_ORA('cur')} ELSE {_ORA('bas')} END",
        "CASE WHEN c >= b THEN (CASE WHEN cur <> '' THEN c ELSE b END) ELSE (CASE WHEN bas <> '' THEN b ELSE c END) END",
    )
    sure = (f"CASE WHEN c >= b THEN {_ORA('cur')} ELSE {_ORA('bas')} END", "CASE WHEN c >= b THEN c ELSE b END")
    if baseline == "current":
        return "cur", "CASE WHEN cur <> '' THEN c ELSE 0 END"
    if baseline == "base":
        return "bas", "CASE WHEN bas <> '' THEN b ELSE 0 END"
    if baseline == "completeness":
        return f"CASE WHEN cur <> '' THEN cur WHEN bas <> '' THEN bas ELSE {_AB} END", "CASE WHEN cur <> '' THEN c WHEN bas <> '' THEN b ELSE 0 END"
    if baseline == "confidence":
        return (
            f"CASE WHEN c >= b THEN (CASE WHEN cur <> '' THEN cur ELSE {_ORA('bas')} END) ELSE (CASE WHEN bas <> '' THEN bas ELSE {_ORA('cur')} END) END",
            "CASE WHEN c >= b THEN (CASE WHEN cur <> '' THEN c ELSE b END) ELSE (CASE WHEN bas <> '' THEN b ELSE c END) END",
        )
    if baseline == "hybrid":
        return _settled(*sure)
    if baseline == "agreement_only":
        return _settled(_AB, "0")
    if baseline == "smart_hybrid":

        def better(x: str, y: str, floor: str) -> tuple[str, str]:
            return (
                f"CASE WHEN {x} > {y} THEN {_ORA('cur')} WHEN {y} > {x} THEN {_ORA('bas')} WHEN cur <> '' THEN cur ELSE {_ORA('bas')} END",
                f"CASE WHEN {x} > {y} THEN greatest(c, CASE WHEN cur <> '' THEN {floor} ELSE 0 END) WHEN {y} > {x} THEN greatest(b, CASE WHEN bas <> '' THEN {floor} ELSE 0 END) WHEN cur <> '' THEN c ELSE b END",
            )

        s, m = better(_site_quality("n", "cur"), _site_quality("bn", "bas"), "0.8"), better(_name_quality("cur", "w"), _name_quality("bas", "bw"), "0.75")
        return _settled(*[f"CASE WHEN attribute = 'website' THEN {s[i]} WHEN attribute = 'name' THEN {m[i]} ELSE {sure[i]} END" for i in (0, 1)])
    if baseline == "website_authority_hybrid":
        own = f"cur <> '' AND NOT {aggregator('cur')}"
        base = f"{site(by[0])} <> {site('bas')}"
        local = f"({aggregator('bas')} OR ({_locality('cur')} >= 3 AND {_locality('bas')} <= 1))"
        rule = f"CASE WHEN {own} AND c >= {low} AND (b - c) <= {margin} THEN {{0}} WHEN {base} THEN {{1}} WHEN {own} AND {local} THEN {{2}} ELSE {{1}} END"
        web = _settled(rule.format("cur", by[0], "cur"), rule.format("greatest(c, 0.9)", by[1], "greatest(c, 0.8)"))
        rest = _settled(*by)
        return tuple(f"CASE WHEN attribute = 'website' THEN {web[i]} ELSE {rest[i]} END" for i in (0, 1))
    raise ValueError(baseline)


_TRUTH = "CASE truth_choice WHEN 'current' THEN cur WHEN 'base' THEN bas WHEN 'same' THEN (CASE WHEN cn = bsn THEN (CASE WHEN cur <> '' THEN cur ELSE bas END) ELSE '' END) ELSE '' END"
_SOURCE = "CASE truth_choice WHEN 'same' THEN (CASE WHEN cn = bsn THEN 'same' ELSE 'invalid_same' END) WHEN '' THEN 'unlabeled' ELSE truth_choice END"


def baseline(which: str) -> str:
    p, c = _policy(which)
    return f"{LONG} SELECT id, attribute, {p} AS prediction, CAST({c} AS DOUBLE) AS confidence FROM long"


def _evaluated(baselines) -> str:
    parts = []
    for x in baselines:
        p, c = _policy(x)
        parts.append(f"SELECT id, base_id, attribute, cur, bas, '{x}' AS baseline, {p} AS prediction, CAST({c} AS DOUBLE) AS confidence, {_TRUTH} AS truth, {_SOURCE} AS truth_source, cn <> bsn AS differs FROM long")
    return LONG + ", ev AS (" + " UNION ALL ".join(parts) + ")"


def _golden(baselines, group: str = "baseline", ev: str | None = None) -> str:
    return (ev or _evaluated(baselines)) + f""", f AS (
 SELECT *, (prediction = '' OR prediction = {_AB})::INT AS silent, (prediction <> '' AND prediction <> {_AB} AND {norm('attribute', 'prediction')} = {norm('attribute', 'truth')})::INT AS ok FROM ev WHERE truth <> ''),
 s AS (SELECT *, 'all' AS scope FROM f UNION ALL SELECT *, 'conflict' AS scope FROM f WHERE differs),
 g AS (SELECT {group}, attribute, scope, count(*) AS total, CAST(sum(1 - silent) AS BIGINT) AS covered, CAST(sum(ok) AS BIGINT) AS correct, CAST(sum(silent) AS BIGINT) AS abstained,
  CAST(sum((silent = 0 AND ok = 0 AND confidence >= 0.8)::INT) AS BIGINT) AS high_confidence_wrong FROM s GROUP BY ALL),
 r AS (SELECT *, CASE WHEN covered > 0 THEN correct / covered::DOUBLE ELSE 0 END AS p, correct / total::DOUBLE AS q FROM g)
"""


def golden_metrics() -> str:
    return _golden(policies.BASELINES) + """SELECT baseline, attribute, scope, total, covered, correct, abstained, high_confidence_wrong, round(p, 9) AS accuracy, round(p, 9) AS precision, round(q, 9) AS recall,
 round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 9) AS f1, round(covered / total::DOUBLE, 9) AS coverage, round(abstained / total::DOUBLE, 9) AS abstention_rate,
 round(CASE WHEN covered > 0 THEN high_confidence_wrong / covered::DOUBLE ELSE 0 END, 9) AS high_confidence_wrong_rate FROM r"""


def calibration() -> str:
    parts = []
    for low in policies.GRID_CONFIDENCES:
        for margin in policies.GRID_MARGINS:
            p, c = _policy("website_authority_hybrid", str(low), str(margin))
            parts.append(
                f"SELECT {low}::DOUBLE AS min_confidence, {margin}::DOUBLE AS max_margin, attribute, {p} AS prediction, CAST({c} AS DOUBLE) AS confidence, {_TRUTH} AS truth, cn <> bsn AS differs FROM long WHERE attribute = 'website'"
            )
    ev = LONG + ", ev AS (" + " UNION ALL ".join(parts) + ")"
    pick = ", ".join(
        f"coalesce(max(CASE WHEN scope = '{s}' THEN {e} END), 0) AS {s}_{n}"
        for s in ("all", "conflict")
        for n, e in (("total", "total"), ("accuracy", "round(p, 9)"), ("abstention_rate", "round(abstained / total::DOUBLE, 9)"), ("high_confidence_wrong_rate", "round(CASE WHEN covered > 0 THEN high_confidence_wrong / covered::DOUBLE ELSE 0 END, 9)"))
    )
    return _golden((), "min_confidence, max_margin", ev) + f""", w AS (SELECT min_confidence, max_margin, {pick} FROM r GROUP BY ALL)
 SELECT *, CAST(row_number() OVER (ORDER BY conflict_high_confidence_wrong_rate, all_high_confidence_wrong_rate, conflict_accuracy DESC, all_accuracy DESC, all_abstention_rate, min_confidence, max_margin) AS INT) AS rank FROM w"""


def conflicts(which: str = "hybrid") -> str:
    ok = f"{norm('attribute', 'prediction')} = {norm('attribute', 'truth')}"
    return _evaluated([which]) + f", con AS (SELECT id, base_id, attribute, baseline, truth, truth_source, prediction, confidence, {ok} AS correct, cur AS current_value, bas AS base_value, true AS needs_evidence FROM ev WHERE differs AND truth <> '')"


def attribute_scores() -> str:
    return _evaluated(["agreement_only"]) + f""", k AS (SELECT attribute, truth, prediction, confidence, (prediction IN ('', {_AB})) AS silent FROM ev WHERE truth <> ''),
 cls AS (SELECT attribute, k, sum(tp) AS tp, sum(said) AS said, sum(was) AS was FROM (
  SELECT attribute, truth AS k, (truth = prediction)::INT AS tp, 0 AS said, 1 AS was FROM k WHERE NOT silent UNION ALL SELECT attribute, prediction, 0, 1, 0 FROM k WHERE NOT silent) GROUP BY ALL),
 m AS (SELECT attribute, avg(CASE WHEN said + was > 0 THEN 2.0 * tp / (said + was) ELSE 0 END) AS macro_f1 FROM cls GROUP BY 1)
 SELECT k.attribute, count(*) AS total, count(*) FILTER (NOT silent) AS covered, count(*) FILTER (NOT silent AND truth = prediction) AS correct, count(*) FILTER (silent) AS abstained,
  round(coalesce(count(*) FILTER (NOT silent AND truth = prediction) / nullif(count(*) FILTER (NOT silent), 0)::DOUBLE, 0), 9) AS accuracy, round(coalesce(any_value(macro_f1), 0), 9) AS macro_f1,
  round(coalesce(count(*) FILTER (NOT silent AND truth <> prediction AND confidence >= 0.8) / nullif(count(*) FILTER (NOT silent), 0)::DOUBLE, 0), 9) AS high_confidence_wrong_rate
 FROM k LEFT JOIN m USING (attribute) GROUP BY 1"""


def kind(x: str) -> str:
    h, p = host(x), path(x)
    below = lambda d: has(h, N.one_of_domains(d))
    return (
        f"(CASE WHEN ends_with({h}, '.gov') THEN 'government' WHEN {below(A.BUSINESS_REGISTRY_DOMAINS)} THEN 'business_registry'"
        f" WHEN ({h} IN ('google.com', 'maps.google.com') OR ends_with({h}, '.google.com')) AND {any_of(p, ('/maps', '/place', '/search'))} THEN 'google_places'"
        f" WHEN {h} IN ('openstreetmap.org', 'osm.org') OR ends_with({h}, '.openstreetmap.org') THEN 'osm' WHEN {h} IN ('facebook.com', 'instagram.com') THEN 'social'"
        f" WHEN {below(A.AGGREGATOR_DOMAINS)} THEN 'aggregator' WHEN {h} <> '' THEN 'official_site' ELSE 'unknown' END)"
    )


def look_up(key: str, table: dict, default: float) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in table.items()) + f" ELSE {float(default)!r}::DOUBLE END)"


def rank(url: str, words: str, query: str) -> str:
    k, h, p, w, q = kind(url), host(url), path(url), f"lower({t(words)})", f"lower({t(query)})"
    adds = [(f"{k} = 'official_site' AND {h} <> ''", 0.03), (f"{k} = 'official_site' AND {p} IN ('', '/', '/index.html', '/index.htm')", 0.02),
            (f"{any_of(w, A.CONTACT_HINTS)} OR {any_of(p, A.CONTACT_HINTS)}", 0.03), (any_of(w, A.SERVICE_HINTS), 0.03), *[(f"contains({p}, {_q(x)})", v) for x, v in A.PATH_BONUS],
            (any_of(w, ("schema.org", "ld+json")), 0.04), (f"{any_of(w, A.FRESH_HINTS)} OR {any_of(p, ('current', 'updated', 'hours'))}", 0.02),
            (f"contains({q}, 'site:') AND {h} <> '' AND contains({q}, {h})", 0.06), (any_of(w, A.REVIEW_HINTS), -0.04), (any_of(w, A.STALE_HINTS), -0.08),
            (f"contains({q}, 'official') AND {k} = 'official_site'", 0.04), (f"{q} <> '' AND contains({w}, {q})", 0.02)]
    return f"least(1.0::DOUBLE, {look_up(k, A.RETRIEVAL_RANK, 0.2)} + " + " + ".join(f"(CASE WHEN {c} THEN {v}::DOUBLE ELSE 0 END)" for c, v in adds) + ")"


def adjusted(base: str) -> str:
    d = "recency_days"
    return (
        f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {base} + (CASE WHEN {d} <= 30 THEN 0.12::DOUBLE WHEN {d} <= 90 THEN 0.08 WHEN {d} <= 180 THEN 0.04 ELSE 0 END)"
        " - least(0.5::DOUBLE, (CASE WHEN recency_days > 365 THEN 0.15::DOUBLE WHEN recency_days > 180 THEN 0.05 ELSE 0 END) + greatest(coalesce(zombie_score, 0), 0) * 0.20::DOUBLE + greatest(coalesce(identity_change_score, 0), 0) * 0.15::DOUBLE)))"
    )


_SEARCH = f"round(least(1.0::DOUBLE, {adjusted(rank('url', '''concat_ws(' ', nullif(title, ''), nullif(page_text, ''))''', 'query'))} + {look_up('layer', A.LAYER_BONUS, 0.0)}), 9)"
_VALUE = f"(CASE WHEN {t('extracted_value')} = '' AND attribute = 'website' THEN url ELSE {t('extracted_value')} END)"
_EVALUE = f"(CASE WHEN {t('extracted_value')} = '' AND attribute = 'website' AND source_type = 'official_site' THEN url ELSE {t('extracted_value')} END)"
SCORED = f"WITH e AS ({_EVIDENCE}), sc AS (SELECT *, {_SEARCH} AS score, {norm('attribute', _VALUE)} = {norm('attribute', 'gold_value')} AS matches FROM e)"
_STRONG = "source_type IN ('official_site', 'government', 'business_registry')"
BEST = SCORED + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id, attribute, attempt, layer ORDER BY score DESC, page) AS rn FROM sc),
 auth AS (SELECT case_id, attribute, attempt, layer, bool_or({_STRONG}) AS authoritative FROM sc GROUP BY ALL),
 best AS (SELECT r.case_id, r.attribute, r.attempt, r.layer, r.score, r.matches, r.source_type, r.url, a.authoritative FROM ranked r JOIN auth a USING (case_id, attribute, attempt, layer) WHERE rn = 1),
 tried AS (SELECT *, unnest(CASE WHEN layer IN ('official','government','business_registry','registry','corroboration','freshness') THEN ['targeted','all'] WHEN layer = 'fallback' THEN ['fallback','all'] ELSE ['all'] END) AS arm FROM best)"""
ARMS = BEST + """, n AS (SELECT count(DISTINCT (case_id, attribute)) AS total FROM sc),
 pick AS (SELECT arm, case_id, attribute, matches, row_number() OVER (PARTITION BY arm, case_id, attribute ORDER BY score DESC, attempt) AS rn FROM tried WHERE score >= 0.75),
 sel AS (SELECT arm, count(*) FILTER (matches) AS top FROM pick WHERE rn = 1 GROUP BY 1),
 found AS (SELECT arm, count(DISTINCT (case_id, attribute)) FILTER (score >= 0.75) AS useful_cases, count(DISTINCT (case_id, attribute)) FILTER (score >= 0.75 AND matches) AS hits, count(*) FILTER (score >= 0.75) AS useful,
  count(*) AS attempts, count(*) FILTER (authoritative) AS authoritative, count(*) FILTER (source_type NOT IN ('aggregator', 'social')) AS cited FROM tried GROUP BY 1),
 arms AS (SELECT arm, total, hits / total::DOUBLE AS authoritative_found_rate, useful_cases / total::DOUBLE AS useful_found_rate, coalesce(top, 0) / total::DOUBLE AS citation_precision, attempts / total::DOUBLE AS average_search_attempts,
  useful / total::DOUBLE AS useful_attempts_per_case, CASE WHEN authoritative > 0 THEN attempts / authoritative::DOUBLE ELSE 0 END AS avg_attempts_per_authoritative, cited / attempts::DOUBLE AS citation_precision_proxy
  FROM found LEFT JOIN sel USING (arm), n)"""


def resolve() -> str:
    """The resolver over replay pages, gold among the candidates."""
    rank_ = look_up("source_type", A.EVIDENCE_RANK, 0.2)
    floor = lambda table, x: f"greatest({x}, {look_up('attribute', table, x)})"
    return f"""WITH e AS ({_EVIDENCE}), ev AS (SELECT *, {_EVALUE} AS v, {adjusted(rank_)} AS s, attempt * 100000 + page AS o FROM e),
 cand AS (SELECT case_id, attribute, gold_value AS v, -4 AS o FROM (SELECT DISTINCT case_id, attribute, gold_value FROM e) UNION ALL SELECT case_id, attribute, v, o FROM ev),
 names AS (SELECT case_id, attribute, {norm('attribute', 'v')} AS nv, arg_min(v, o) AS value FROM cand WHERE v <> '' GROUP BY ALL),
 hit AS (SELECT ev.case_id, ev.attribute, s, o, nv, value FROM ev JOIN names n ON n.case_id = ev.case_id AND n.attribute = ev.attribute AND n.nv = {norm('ev.attribute', 'ev.v')} WHERE nv <> ''),
 sums AS (SELECT case_id, attribute, nv, any_value(value) AS value, round(sum(s), 9) AS s, max(s) AS top, count(*) AS items, min(o) AS seen FROM hit GROUP BY ALL),
 two AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(s) OVER w, 0) AS second, round(sum(s) OVER (PARTITION BY case_id, attribute), 9) AS total FROM sums WINDOW w AS (PARTITION BY case_id, attribute ORDER BY s DESC, seen)),
 one AS (SELECT *, CASE WHEN total > 0 THEN s / total ELSE 0 END AS conf, round(s - second, 9) AS margin FROM two WHERE rn = 1),
 d AS (SELECT c.case_id, c.attribute, c.gold_value, o.value, coalesce(o.conf, 0) AS confidence, coalesce(items, 0) AS supporting,
  (top IS NULL OR top < {floor(resolver.MIN_SUPPORT, 0.55)} OR conf < {floor(resolver.MIN_CONFIDENCE, 0.55)} OR margin <= {look_up('attribute', resolver.MIN_MARGIN, 0.0)}) AS abstained
  FROM (SELECT DISTINCT case_id, attribute, gold_value FROM e) c LEFT JOIN one o USING (case_id, attribute))"""


def _fill(template: str) -> str:
    body, _, needs = template.partition("?")
    out = "concat(" + ", ".join(x if i % 2 else _q(x) for i, x in enumerate(body.replace("}", "{").split("{"))) + ")"
    out = f"nullif(trim({out}), '')"
    if "{domain}" in body:
        out = f"CASE WHEN domain <> '' THEN {out} END"
    return f"CASE WHEN {needs} <> '' THEN {out} END" if needs else out


def plans(source: str, keep: str) -> str:
    """CTE ``planned`` (keep, attribute, layer, position, query) over a CTE of places."""
    quote = lambda c: f"CASE WHEN trim({t(c)}) = '' THEN '' ELSE concat('\"', trim({c}), '\"') END AS {c}"
    minus = " ".join(f"-site:{d}" for d in queryplan.EXCLUDED_SITES)
    parts = []
    for i, (layer, table) in enumerate((("official", queryplan.OFFICIAL), ("corroboration", queryplan.CORROBORATION), ("freshness", queryplan.FRESHNESS))):
        for a, templates in table.items():
            lists = "list_filter([" + ", ".join(_fill(x) for x in templates) + "], lambda v: v IS NOT NULL)"
            parts.append(f"SELECT {keep}, attribute, '{layer}' AS layer, {i} AS l, {lists} AS qs FROM fields WHERE attribute = '{a}'")
    parts.append(f"SELECT {keep}, attribute, 'fallback', 3, [coalesce(nullif(loose, ''), nullif(domain, ''), nullif(rawsite, ''), nullif(address, ''), nullif(phone, ''), '')] FROM fields")
    return f""", fields AS (SELECT {keep}, attribute, {quote('name')}, {quote('city')}, {quote('region')}, {quote('address')}, {quote('phone')}, {domain('website')} AS domain, {t('website')} AS rawsite, '{minus}' AS minus,
 trim(concat_ws(' ', nullif(name, ''), nullif(city, ''), nullif(region, ''))) AS loose FROM {source}),
 planned AS (SELECT {keep}, attribute, layer, CAST(l * 100 + unnest(range(len(qs))) AS INT) AS position, unnest(qs) AS query FROM (""" + " UNION ALL ".join(parts) + "))"


def audit(group: str) -> str:
    kinds = {
        "operator": any_of("query", queryplan.OPERATORS), "quoted_anchor": "length(query) - length(replace(query, '\"', '')) >= 2", "site_restricted": "contains(query, 'site:')",
        "exclusion": "contains(query, '-site:')", "fallback": "layer = 'fallback'", "authority": any_of("lower(query)", queryplan.AUTHORITY_WORDS),
    }
    counts = ", ".join(f"count(*) FILTER ({k}) AS {n}_queries" for n, k in kinds.items())
    shares = ", ".join(f"round(count(*) FILTER ({k}) / count(*)::DOUBLE, 9) AS {'fallback_share' if n == 'fallback' else n + '_coverage'}" for n, k in kinds.items())
    return f"SELECT {group}count(*) AS total_queries, {counts}, {shares} FROM planned" + (" GROUP BY ALL" if group else "")


def weak(candidate: str, extracted: str, source: str, words: str) -> str:
    f = lambda x: f"trim({rx(f'lower({t(x)})', r'\s+', ' ')})"
    return f"CASE WHEN {any_of(f(words), P.STALE_MARKERS)} THEN 'stale' WHEN {f(extracted)} = '' THEN 'unclear' WHEN {f(candidate)} = {f(extracted)} THEN 'supports' ELSE 'contradicts' END"
