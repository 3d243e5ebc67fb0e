from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestra.operators import metrics, prior, replay
from attestra.sources import readers, writers


def test_canonical_rows_drop_unknown_and_fill_missing(spark):
    truth = spark.createDataFrame([("a", "website", "current", "x"), ("a", "name", None, "n"), ("b", "phone", "base", "1")], "id string, attribute string, source string, value string")
    said = spark.createDataFrame([("b", "website", "p", 0), ("zz", "website", "q", 1), ("a", "website", "r", 2), ("a", "phone", "9", 0)], "id string, attribute string, prediction string, ordinal long")
    got = {r["id"]: r for r in prior.canonical_rows(truth, said).collect()}
    assert sorted(got) == ["a", "b"]
    assert (got["a"]["website_truth"], got["a"]["website_truth_value"], got["a"]["website_prediction"], got["a"]["website_confidence"]) == ("current", "x", "r", "1.0")
    assert (got["a"]["name_truth"], got["a"]["name_truth_value"], got["a"]["name_prediction"], got["a"]["name_confidence"]) == ("", "n", "", "0.0")
    assert [r["id"] for r in prior.canonical_rows(truth, said, limit=2).collect()] == ["b"]


def test_golden_values(spark):
    cells = {
        "name": [("{'primary': \"Joe's\"}", "Joe's"), ('{"primary": null}', ""), ("plain", "plain"), (None, ""), ("", "")],
        "phone": [("['', None, '1']", "1"), ("[]", ""), ("831", "831")],
        "address": [("[{'freeform': ''}, {'freeform': '1 Main'}]", "1 Main"), ("['2 Main']", "2 Main"), ("[{'x': 1}]", "")],
    }
    for attribute, pairs in cells.items():
        rows = spark.createDataFrame([(i, c, w) for i, (c, w) in enumerate(pairs)], "i int, cell string, want string")
        for r in rows.withColumn("got", prior.golden_value(attribute, F.col("cell"))).collect():
            assert r["got"] == r["want"], (attribute, r["cell"])
    with pytest.raises(ValueError):
        prior.golden_value("other", F.col("x"))


def test_small_rules_on_empty_tables(spark):
    empty = spark.createDataFrame([], "attribute string, predicted_value string, truth_value string, authority_coverage double")
    assert prior.website_accuracy(empty).collect()[0].asDict() == {"website_accuracy": 0.0, "website_rows": 0}
    assert {r["attribute"]: r["weight"] for r in prior.measured_weights(empty).collect()} == {"website": 1.0, "category": 0.75, "name": 0.0}


def test_merging_keeps_the_first_decision(spark):
    schema = "file string, case_id string, attribute string, gold_value string, place map<string,string>, final_decision struct<decision:string>, attempt int, layer string, query string, page int, url string, title string, page_text string, source_type string, extracted_value string, recency_days double, zombie_score double, identity_change_score double"
    page = (0, "official", "q", 0, "u", "", "t", "unknown", "", None, 0.0, 0.0)
    rows = [("a", "c", "name", "g", None, None, *page), ("b", "c", "name", "g", None, ("yes",), *page), ("c", "c", "name", "g", None, ("no",), *page), ("a", "d", "name", "g", None, None, *page)]
    got = {r["case_id"]: r["final_decision"] for r in replay.merge_corpora(spark.createDataFrame(rows, schema)).collect()}
    assert got["c"]["decision"] == "yes" and got["d"] is None


def test_objects_episodes_and_reports(spark, tmp_path):
    writers.write_object(f"{tmp_path}/o", spark, cases=[{"id": 1, "text": "a\nb"}], mode="x")
    assert readers_of(spark, f"{tmp_path}/o", ("cases",)) == {"cases": [{"id": 1, "text": "a\nb"}], "mode": "x"}
    with pytest.raises(ValueError):
        readers_of(spark, f"{tmp_path}/o", ("rows", "context_by_id"))
    rows = spark.createDataFrame([("7", "u1"), ("7", "u2"), ("8", "u3")], "episode_id string, url string")
    writers.write_episodes(rows, f"{tmp_path}/e")
    assert sorted(tuple(r[c] for c in ("episode_id", "url")) for r in writers.read_episodes(spark, f"{tmp_path}/e").collect()) == [("7", "u1"), ("7", "u2"), ("8", "u3")]
    with pytest.raises(ValueError):
        writers.markdown(rows, rows=2)
    with pytest.raises(ValueError):
        metrics.validate(rows.unionByName(rows), [], "url", most=2)


def readers_of(spark, path, required):
    return writers.read_object(spark, path, required)


def test_replay_object_round_trip(spark, tmp_path, sf):
    from attestra.plans import fixtures

    pages = fixtures.evidence(spark, sf).filter("case_id in ('case-1', 'case-2', 'case-3')")
    writers.write_replay_object(pages, f"{tmp_path}/r", "2024-01-01T00:00:00Z")
    back = readers.read_replay(spark, f"{tmp_path}/r")
    assert sorted((r["case_id"], r["url"]) for r in back.collect()) == sorted((r["case_id"], r["url"]) for r in pages.collect())


def test_evidence_files_and_first_existing(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pages": [{"place_id": "p", "attribute": "name", "source_url": "u", "candidate_value": "v"}]}')
    (tmp_path / "b.csv").write_text('case_id,attribute,url,extracted_value\nq,phone,w,"1, ""2"""\n')
    path = readers.first_existing(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/a.json")
    a, = readers.read_evidence(spark, path).collect()
    assert (a["case_id"], a["url"], a["extracted_value"], a["source_type"]) == ("p", "u", "v", "unknown")
    b, = readers.read_evidence(spark, f"file://{tmp_path}/b.csv").collect()
    assert (b["case_id"], b["attribute"], b["extracted_value"]) == ("q", "phone", '1, "2"')
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, f"file://{tmp_path}/none")
