"""Behaviour of whole operators on small rows."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from attestra.functions import normalize as N
from attestra.operators import context, labels, matching, metrics, policies, queryplan, replay, rerank, resolver
from attestra.sources import readers, writers

PAIR = {"id": "1", "base_id": "b1", "ordinal": 0, "confidence": 0.9, "base_confidence": 0.7}


def pair(spark, **over):
    row = dict(PAIR)
    for a in N.ATTRIBUTES:
        row[a], row[f"base_{a}"] = "", ""
    row |= {"truth_choice": "", "truth_value": ""} | over
    return policies.long_pairs(spark.createDataFrame([row]))


def predicted(spark, baseline, attribute, **over):
    r = pair(spark, **over).filter(F.col("attribute") == attribute).select(policies.predict(baseline).alias("p")).first()["p"]
    return r["prediction"], r["confidence"]


def test_settled_cases(spark):
    assert predicted(spark, "hybrid", "phone", phone="831 555 1212", base_phone="+1 831-555-1212") == ("831 555 1212", 1.0)
    assert predicted(spark, "hybrid", "phone", base_phone="5") == ("5", 0.7)
    assert predicted(spark, "hybrid", "phone") == (N.ABSTAIN, 0.9)
    assert predicted(spark, "agreement_only", "name", name="a", base_name="b") == (N.ABSTAIN, 0.0)
    assert predicted(spark, "confidence", "name", base_name="b") == ("b", 0.7)


def test_website_authority(spark):
    deep, root = "https://chain.com/locations/ca/12", "https://chain.com/"
    rule = lambda **k: predicted(spark, "website_authority_hybrid", "website", **k)
    assert rule(website=deep, base_website=root, confidence=0.5, base_confidence=0.99) == (deep, 0.8)
    assert rule(website=root, base_website=deep, confidence=0.9645, base_confidence=0.99) == (root, pytest.approx(0.9645))
    assert rule(website=root, base_website=deep, confidence=0.89, base_confidence=0.99) == (deep, 0.99)
    assert rule(website=root, base_website="https://yelp.com/biz", confidence=0.1, base_confidence=0.99) == (root, 0.8)


def test_unreadable_confidence_loses(spark):
    assert predicted(spark, "confidence", "name", name="a", base_name="b", confidence=float("nan"), base_confidence=0.1)[0] == "b"


def test_truth(spark):
    def truth(choice, value="", **over):
        t = pair(spark, truth_choice=choice, truth_value=value, **over).filter("attribute = 'name'").select(policies.truth(F.col("truth_choice"), F.col("truth_value")).alias("t")).first()["t"]
        return t["truth"], t["truth_source"]

    assert truth("same", name="A b", base_name="a  B") == ("A b", "same")
    assert truth("same", name="a", base_name="b") == ("", "invalid_same")
    assert truth("base", " x ", name="a", base_name="b") == ("x", "explicit")
    assert truth("", name="a") == ("", "unlabeled")


def test_metrics_small(spark):
    rows = spark.createDataFrame([("a", "x", "x", 0.5), ("a", "x", "y", 0.95), ("a", "x", N.ABSTAIN, 0.0)], "attribute string, truth string, prediction string, confidence double")
    r = metrics.attribute_scores(rows).first()
    assert (r["covered"], r["accuracy"], round(r["abstention_rate"], 6), r["high_confidence_wrong_rate"]) == (2, 0.5, 0.333333, 0.5)


def evidence(spark, *items):
    rows = [("c", "phone", i, kind, v, d, *(z or [0.0]), 0.0) for i, (kind, v, d, *z) in enumerate(items)]
    return spark.createDataFrame(rows, "case_id string, attribute string, ordinal int, source_type string, extracted_value string, recency_days double, zombie_score double, identity_change_score double")


def decide(spark, *items):
    cases = spark.createDataFrame([("c", "phone")], "case_id string, attribute string")
    options = spark.createDataFrame([("c", "phone", "5551111", 0), ("c", "phone", "5552222", 1)], "case_id string, attribute string, value string, ordinal int")
    return resolver.resolve(cases, options, evidence(spark, *items)).first()


def test_resolver(spark):
    assert decide(spark, ("official_site", "555-1111", None), ("aggregator", "5552222", None))["decision"] == "5551111"
    assert decide(spark, ("official_site", "999", None))["reason"] == resolver.NO_MATCH
    weak = decide(spark, ("aggregator", "5551111", None), ("aggregator", "5551111", None))
    assert weak["abstained"] and weak["reason"] == resolver.WEAK_SUPPORT
    assert decide(spark, ("official_site", "5551111", None), ("official_site", "5552222", None))["reason"] == resolver.TIED
    assert decide(spark, ("official_site", "5551111", 900.0, 0.9), ("official_site", "5552222", 5.0))["decision"] == "5552222"


def test_plan_keeps_fallback_under_cap(spark):
    row = {"id": "1", "base_id": "b", "attribute": "website", "truth": "t", "truth_source": "base", "prediction": "p", "baseline": "hybrid", "correct": False, "needs_evidence": True, "current_value": "https://a.com", "base_value": "https://b.com"}
    got = queryplan.conflict_queries(spark.createDataFrame([row]), 3).orderBy("position").collect()
    assert len(got) == 3 and got[-1]["layer"] == "fallback" and got[0]["priority"] == "baseline_wrong"


def replay_file(tmp_path, name, episodes, wrap=True):
    body = {"schema_version": 1, "generated_at": "x", "episodes": episodes} if wrap else episodes
    (tmp_path / name).write_text(json.dumps(body))
    return str(tmp_path / name)


def episode(text, layer="official", key="search_attempts", pages="fetched_pages", url="https://a.com"):
    page = {"url": url, "title": "T", "page_text": text, "source_type": "official_site", "extracted_values": {"website": "https://a.com"}}
    return {"case_id": "1", "attribute": "website", "place": {"current_value": "https://a.com"}, "gold_value": "a.com", key: [{"layer": layer, "query": "q", pages: [page]}]}


def test_replay_shapes_and_merge(spark, tmp_path):
    a = readers.read_replay(spark, replay_file(tmp_path, "a.json", [episode("short")]))
    b = readers.read_replay(spark, replay_file(tmp_path, "b.json", [episode("much longer text", key="attempts", pages="results")], wrap=False))
    assert b.first()["url"] == "https://a.com"
    merged = replay.merge_corpora(a.unionByName(b)).collect()
    assert [r["page_text"] for r in merged] == ["much longer text"]
    m = {r["arm"]: r for r in replay.arm_metrics(replay.score_pages(a)).collect()}
    assert m["targeted"]["authoritative_found_rate"] == 1.0 and "fallback" not in m


def test_replay_round_trip(spark, tmp_path):
    a = readers.read_replay(spark, replay_file(tmp_path, "a.json", [episode("x")]))
    writers.write_replay(a.drop("final_decision"), str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out"))
    assert again.first()["search_attempts"][0]["fetched_pages"][0]["url"] == "https://a.com"


def test_context(spark):
    def run(attribute, current, base, *values):
        cases = spark.createDataFrame([("1", attribute, current, base)], "case_id string, attribute string, current string, base string")
        near = spark.createDataFrame([("1", attribute, v) for v in values], "case_id string, attribute string, value string")
        return context.decide(cases, near).first()

    assert run("phone", "5551111", "5552222", "555-1111")["decision"] == "current"
    tie = run("phone", "5551111", "5552222", "5551111", "5552222")
    assert tie["abstained"] and tie["confidence"] == 0.5
    assert run("address", "Kromme Rijn", "Utrecht", "Kromme Rijn")["abstained"]
    assert run("address", "550 71 Ave SE", "170, 550 71 St SE", "550 71 Ave SE")["decision"] == "current"


def test_matching(spark):
    fields = "place_id string, name string, address string, city string, region string, phone string, website string, category string, source_dataset string"
    left = spark.createDataFrame([("l1", "Blue Cafe", "1 Main St", "X", "CA", "831 555 1212", "", "cafe", "a"), ("l2", "Lonely", "9 Elm", "Y", "ZZ", "", "", "bar", "a")], fields)
    right = spark.createDataFrame([("r1", "Blue Cafe Inc", "1 Main Street", "X", "CA", "+1 8315551212", "", "coffee", "b"), ("r2", "Other", "2 Oak", "X", "CA", "", "", "bar", "b")], fields)
    matched = matching.match_places(left, right)
    pairs = matching.pair_rows(matched).collect()
    assert [(p["left_place_id"], p["right_place_id"], p["phone_match"]) for p in pairs] == [("l1", "r1", True)]
    assert {r["attribute"] for r in matching.conflict_rows(matched).collect()} == {"name", "address", "category"}


def test_training_follows_order(spark):
    rows = [("k", i, {"x": float(i % 2), "y": 1.0}, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, ordinal int, features map<string,double>, label int")
    model = rerank.train(df.repartition(3), epochs=30).first()
    weights = dict(model["weights"])
    assert weights["x"] > 1 and rerank.train(df, epochs=30).first()["bias"] == model["bias"]
    p = df.filter("ordinal < 2").select("ordinal", rerank.score(F.col("features"), model["bias"], weights).alias("p")).collect()
    assert {r["ordinal"]: r["p"] > 0.5 for r in p} == {0: False, 1: True}


def test_queue_is_balanced_and_its_texts_are_read_once(spark):
    rows = [("a", "b", "name", "low", layer, i, f"q{i} www.x.com", "official_site", f"https://www.x.com/{i}", "y.com", "x", "current", "x") for i, layer in enumerate(["official", "official", "freshness", "freshness", "fallback", "fallback", "fallback"])]
    names = "id base_id attribute priority layer position query preferred_sources current_value base_value truth truth_source prediction".split()
    queue = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'position' else 'string'}" for n in names))
    queue = queue.unionByName(queue.withColumn("attribute", F.lit("phone")))
    made = rerank.balanced_queue(queue, queue.filter("layer = 'official' AND attribute = 'name'"))
    got = [(r["ordinal"], r["label"], r["features"]) for r in made.orderBy("ordinal").collect()]
    assert {r["key"] for r in made.collect()} == {"name"} and [(o, y) for o, y, _ in got] == [(i, int(i <= 4)) for i in range(1, 10)]
    assert got[0][2] == got[1][2] != got[8][2] and got[0][2]["domain:query_current"] == got[0][2]["domain:query_any_candidate"] == got[0][2]["domain:base_present"] == 1 and "domain:query_base" not in got[0][2]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 3  # one host for each of three values


def test_labels(spark):
    rows = [("p1", "b1", "web", "left", 0), ("p1", "b1", "website", "right", 1), ("p1", "b1", "fax", "left", 2), ("p2", "", "names", "both", 3), ("p2", "", "phone", "none", 4)]
    got = {r["id"]: r for r in labels.attribute_labels(spark.createDataFrame(rows, "pair_id string, base_id string, attribute string, final_decision string, ordinal int")).collect()}
    assert got["p1"]["website_truth_choice"] == "base" and got["p2"]["name_truth_choice"] == "same" and got["p2"]["labeled_attributes"] == 1


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a ""b"", c"\n2,\n')
    assert [r["name"] for r in readers.read_rows(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == ['a "b", c', ""]
    (tmp_path / "a.json").write_text('{"rows": [{"id": "1"}, {"id": "2"}]}')
    assert readers.read_rows(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(ValueError):
        readers.read_rows(spark, "x.txt")
    raw = {c: None for c in readers.PAIR_COLUMNS} | {f"base_{c}": None for c in readers.PAIR_COLUMNS}
    raw |= {"id": "1", "base_id": "b", "names": '{"primary": "Cafe"}', "websites": '["https://a.com"]', "addresses": '[{"locality": "X", "region": "CA"}]', "base_phones": "plain", "confidence": 0.5, "base_confidence": 0.4, "ordinal": 0}
    schema = ", ".join(f"`{k}` {'double' if 'confidence' in k else 'int' if k == 'ordinal' else 'string'}" for k in raw)
    r = readers.review_rows(spark.createDataFrame([tuple(raw.values())], schema)).first()
    assert (r["name"], r["website"], r["address"], r["base_phone"], r["name_differs"]) == ("Cafe", "https://a.com", "X, CA", "plain", True)


def test_order_of_rows_does_not_matter(spark, sf):
    from attestra.plans import fixtures

    pages = fixtures.evidence(spark, sf)
    a = sorted(map(tuple, replay.arm_metrics(replay.score_pages(pages)).collect()))
    b = sorted(map(tuple, replay.arm_metrics(replay.score_pages(pages.repartition(7).sortWithinPartitions(F.desc("page")))).collect()))
    assert a == b


def test_release_gate():
    good = {"holdout_website_accuracy": 0.99, "holdout_high_confidence_wrong_rate": 0.0, "holdout_abstention_rate": 0.1, "replay_pages": 300, "authoritative_pages_rate": 0.9, "targeted_authoritative_delta": 0.1,
            "website_official_found_rate": 0.2, "website_false_official_rate": 0.0, "resolver_high_confidence_wrong_rate": 0.0}
    assert replay.release_gate(good, "a.csv", "b.csv")["passed"]
    assert not replay.release_gate(good, "a.csv", "a.csv")["passed"]
    assert not replay.release_gate(good | {"replay_pages": 299}, "a.csv", "b.csv")["passed"]


def test_training_takes_any_number_of_examples_in_order(spark):
    n = 2_000_001
    rows = spark.range(n).select(F.lit("k").alias("key"), (n - F.col("id")).alias("ordinal"), F.create_map(F.lit("x"), F.lit(1.0)).alias("features"), F.lit(0).alias("label"))
    model = rerank.train(rows, epochs=1).first()
    assert model["bias"] < -5 and dict(model["weights"])["x"] == pytest.approx(model["bias"])


def test_training_passes_see_every_key_alone(spark):
    def plain(examples, epochs, rate, l2):
        bias, w = 0.0, {}
        for _ in range(epochs):
            for features, y in examples:
                p = 1 / (1 + math.exp(-(bias + sum(w.get(k, 0.0) * v for k, v in features.items()))))
                bias += rate * (y - p)
                w |= {k: w.get(k, 0.0) + rate * ((y - p) * v - l2 * w.get(k, 0.0)) for k, v in features.items()}
        return bias, w

    made = {k: [({f"f{i % 3}": 1.0, "x": i / 7, f'odd "{i % 2}", ': 1.0}, (i * j) % 2) for i in range(1, 40)] for j, k in enumerate("abc", 1)}
    df = spark.createDataFrame([(k, i, f, y) for k, rows in made.items() for i, (f, y) in enumerate(rows)], "key string, ordinal int, features map<string,double>, label int")
    got = {r["key"]: (r["bias"], dict(r["weights"])) for r in rerank.train(df.repartition(5), 4, 0.1, 0.001).collect()}
    for k, rows in made.items():
        bias, w = plain(rows, 4, 0.1, 0.001)
        assert got[k][0] == pytest.approx(bias) and got[k][1] == pytest.approx(w)


def test_reranked_pages_are_dealt_once_and_equal_plain_training(spark, sf):
    from attestra.plans import fixtures

    def sigmoid(model, features):
        z = model[0] + sum(model[1].get(k, 0.0) * v for k, v in features.items())
        return 1 / (1 + math.exp(-z))

    scored = replay.score_pages(fixtures.evidence(spark, sf, in_order=True))
    pages = rerank.with_page_features(scored.filter("page IS NOT NULL")).join(replay.holdout(scored), ["case_id", "attribute"])
    rows = sorted(pages.select(*rerank.ORDER, "held_out", "features", "matches", "score").collect())
    bias, w = 0.0, {}
    for _ in range(2):
        for r in rows:
            if not r["held_out"]:
                off = int(r["matches"]) - sigmoid((bias, w), r["features"])
                bias += 0.1 * off
                w |= {k: w.get(k, 0.0) + 0.1 * (off * v - 0.001 * w.get(k, 0.0)) for k, v in r["features"].items()}
    want = {tuple(r[c] for c in rerank.ORDER): (r["matches"], r["score"], min(1.0, 0.4 * r["score"] + 0.6 * sigmoid((bias, w), r["features"]))) for r in rows if r["held_out"]}
    for given in (scored, replay.score_pages(fixtures.evidence(spark, sf))):
        got = {tuple(r[c] for c in rerank.ORDER): (r["matches"], r["score"], r["reranked"]) for r in rerank.compare(given, epochs=2, episodes=fixtures.evidence(spark, sf)).collect()}
        assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-12) for k in want)
    place = [F.col(c).alias(f"_{c}") for c in rerank.ORDER]
    blocks = rerank._blocks(rerank._packed(scored).select(*place, F.concat_ws("\n", *rerank._PATTERN).alias("pattern"), "values", F.lit(1.0).alias("label")))
    assert blocks._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # pages are sorted where the window left them


def test_reranking_needs_both_classes_and_two_episodes(spark, sf):
    from attestra.plans import fixtures

    scored = replay.score_pages(fixtures.evidence(spark, sf))
    assert rerank.compare(scored.withColumn("matches", F.lit(False)), epochs=1).count() == 0
    assert rerank.compare(scored.filter(F.col("case_id") == scored.first()["case_id"]), epochs=1).count() == 0


def test_strip_is_that_of_unicode(spark):
    texts = ["", " ", "a", " a", "a\u2003", "\ta b\n", "\u00a0x\u0085", "a \n", "\u2028"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", N.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("r")).collect()
    assert all(r["s"] == r["r"] == texts[r["i"]].strip() for r in got)


def test_matching_of_large_blocks_is_exact_and_tries_few_names(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    fields = [f.removesuffix(" string") for f in "place_id name address city region phone website".split()]

    def places(tag, n):
        pick = lambda *xs: rng.choice(xs)
        return [(f"{tag}{i}", f"{pick('Blue', 'Cafe', '')} {pick('Cafe', 'ab', 'abab')} {i % 7}", pick("1 Elm", "2 Elm", ""), pick("X", "Y", ""), pick("A", "A", "B", "", tag), pick("5551234567", ""), pick("s1.com", "")) for i in range(n)]

    lefts, rights = places("l", 30), places("r", 40)
    block = lambda p: p[4].lower() or "__unknown__"
    want = {}
    for a in lefts:
        met = [b for b in rights if block(b) == block(a)] or rights
        ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else 0.0
        tidy = lambda x: " ".join(x.lower().split())
        same = lambda b, k: a[k] != "" and a[k] == b[k]  # noqa: B023, E731
        rows = []
        for b in met:
            raw = ratio(tidy(a[1]), tidy(b[1]))
            score = 0.45 * raw + 0.15 * same(b, 3) + 0.10 * same(b, 4) + 0.20 * same(b, 5) + 0.20 * same(b, 6) + 0.10 * ratio(tidy(a[2]), tidy(b[2]))
            linked = same(b, 5) or same(b, 6)
            rows.append((-round(min(score, 1.0), 4), b[0], round(raw, 4) >= 0.55 if linked else score >= 0.4 and same(b, 4)))
        want |= {(a[0], b): -s for s, b, likely in sorted(rows)[:3] if likely}
    for chunk in (4_000, 7):
        monkeypatch.setattr(matching, "CHUNK", chunk)
        got = matching.match_places(spark.createDataFrame(lefts, fields), spark.createDataFrame(rights, fields), 0.4, 3).collect()
        assert {(r["l_place_id"], r["r_place_id"]): r["match_score"] for r in got} == pytest.approx(want)

    import pyarrow as pa

    tried = []
    monkeypatch.setattr(matching, "similarity", lambda a, b: tried.append(b) or 0.5)
    side = lambda t, n: pa.table({f"{t}_{c}": [f"{c}{i % 50}" for i in range(n)] for c in ("place_id", "m_name", "m_address", "m_city", "m_region", "m_phone", "m_site")} | {c: [0] * n for c in ("_b", "_i", "_j")})
    assert len(matching._best_of(3)(side("l", 2), side("r", 2_000))) == 6
    assert len(tried) < 400


def test_nearby_meets_each_place_once(spark):
    cases = spark.createDataFrame([(i, (i % 4) / 10.0, 0.0) for i in range(40)] + [(0, 0.1, 0.0)], "case_id int, lon double, lat double")
    points = spark.createDataFrame([(i, (i % 5) / 10.0, (i % 3) / 100.0) for i in range(3_000)], "key int, lon double, lat double")
    near = context.nearby(cases, points, [F.col("p_key")], margin=0.05, limit=3)
    rows = [(c["case_id"], p["key"]) for c in cases.collect() for p in points.collect() if abs(c["lon"] - p["lon"]) <= 0.05 and abs(c["lat"] - p["lat"]) <= 0.05]
    want = {(c, k, i + 1) for c in range(40) for i, k in enumerate(sorted(k for x, k in rows if x == c)[:3])}
    assert {(r["case_id"], r["p_key"], r["place"]) for r in near.collect()} == want
    import re

    near.write.format("noop").mode("overwrite").save()
    away = context.nearby(cases, points, [F.abs(F.col("p_lon") - F.col("lon")), F.col("p_key")], margin=0.05, limit=3)
    assert {(r["case_id"], r["p_key"], r["place"]) for r in away.collect()} == want
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(\w*_?lon#\d+, \w*_?lat#\d+", plan)


def test_decisions_of_a_corpus_need_one_exchange(spark, sf):
    from attestra.plans import fixtures

    pages = fixtures.evidence(spark, sf)
    k = F.pmod(F.hash("case_id"), F.lit(5))
    mine = F.create_map(F.lit("current_value"), F.when(k == 0, "VALUE  1").otherwise(""), F.lit("base_value"), F.when(k == 1, "value 2").otherwise("8315550001"), F.lit("website"), F.lit("https://v1.example.com"))
    odd = pages.withColumn("place", mine).withColumn("page", F.when(k != 3, F.col("page"))).withColumn("gold_value", F.when(k != 2, F.col("gold_value")))
    for gold in (True, False):
        want = resolver.resolve(odd.select("case_id", "attribute").distinct(), replay.candidates_of(odd, gold), replay.evidence_of(odd))
        got = replay.decisions_of(odd, gold)
        assert sorted(map(tuple, got.drop("gold_values").collect())) == sorted(map(tuple, want.collect()))
        assert {r["gold_value"] for r in got.select(F.explode("gold_values").alias("g")).select("g.*").collect()} == {r["gold_value"] for r in odd.select("gold_value").distinct().collect()}
    plan = replay.decisions_of(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_merging_needs_one_exchange(spark, sf):
    from attestra.plans import queries

    plan = queries.QUERIES["replay_merge"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
