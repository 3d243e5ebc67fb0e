"""Quality, toxicity, decontamination and search: held-out accuracy and brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import ann, decontamination, linear, quality, toxicity

from .helpers import awkward, docs, prose


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def quality_rows(n=300):
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in prose(i, 40).split()) if bad else prose(i, 60).capitalize() + "."
        rows.append((i, text, f"host{i % 5}/path{i % 3}/x"))
        marks.append((i, int(not bad), 0))
    return rows, marks


def test_quality_on_held_out_rows(spark):
    rows, marks = quality_rows()
    out = quality.score_documents(docs(spark, rows), labelled(spark, marks), keep=["doc_id"]).collect()
    assert len(out) == len(rows)
    truth = {i: q for i, q, _ in marks}
    mine = [r for r in out if held(r["doc_id"])]
    assert mine and all(r["predicted"] == truth[r["doc_id"]] for r in mine)


def test_posteriors_shrink_towards_the_level_above(spark):
    rows = [("big", "", 0.9)] * 200 + [("low", "", 0.1)] * 200 + [("tiny", "", 0.1)] + [("mid", "", 0.6)] * 50
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    s = {r["host"]: r for r in quality.site_posteriors(scored).collect()}
    rate = lambda h: (s[h]["hs"] + s[h]["hk"] * s[h]["m"]) / (s[h]["hn"] + s[h]["hk"])
    assert abs(rate("big") - 0.9) < 0.02 and abs(rate("low") - 0.1) < 0.02
    assert rate("tiny") > 0.3  # one document does not make a site
    assert s["big"]["pn"] == 0


def test_strength_weighs_sites_by_their_size(spark):
    sizes = np.array([6000.0, 1500.0, 300.0])
    rates = np.array([0.4, 0.7, 0.2])
    sums = spark.createDataFrame([(float(n), float(n * r), float(n * r * r), 0.45) for n, r in zip(sizes, rates, strict=True)], "n double, s double, q double, m double")
    between = (sizes * ((rates - 0.45) ** 2 - 1e-6 / sizes)).sum() / sizes.sum()
    assert sums.agg(quality._strength().alias("k")).first()["k"] == pytest.approx(0.45 * 0.55 / between - 1, rel=1e-6)


def test_sites(spark):
    rows = spark.createDataFrame([("https://A.com/x/y?q",), ("a.com",), (None,), ("a.com/top",)], "s string")
    host, path = quality.site_of(F.col("s"))
    assert [tuple(r) for r in rows.select(host, path).collect()] == [("a.com", "/x/"), ("a.com", ""), ("", ""), ("a.com", "/top")]


def test_quality_of_awkward_rows(spark):
    rows, marks = quality_rows(80)
    d = docs(spark, awkward()).withColumnRenamed("lang", "score")
    out = quality.score_documents(d, labelled(spark, marks + [(None, 1, 0), (3, None, None), (4, 7, 7)]))
    assert out.columns[-5:] == ["document_score", "host_rate", "path_rate", "_score", "predicted"] and out.count() == len(awkward())
    assert all(0 <= r["_score"] <= 1 for r in out.collect())
    assert quality.score_documents(docs(spark, []), labelled(spark, [])).collect() == []
    plain = quality.score_documents(docs(spark, awkward()), labelled(spark, []), keep=["doc_id"])
    assert plain.count() == len(awkward())


def test_statistics_by_hand():
    x = quality.text_statistics(pa.array(["aa aa bb!!", "", None, "A|b\nc"], pa.large_string()))
    f = dict(zip(quality.FEATURES, x[0], strict=True))
    assert f["log_words"] == pytest.approx(np.log(4)) and f["distinct_words"] == pytest.approx(2 / 3) and f["repeats"] == pytest.approx(1 / 3) and f["bang"] == pytest.approx(0.2)
    assert not x[1, 1:17].any() and not x[2, 1:17].any()


def toxic_rows(n=600):
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(n):
        words = prose(i, 50).split()
        bad = i % 5 == 1
        if bad:
            words[int(rng.integers(50))] = "idiot" if i % 2 else f"zorgg{int(rng.integers(99))}"
        rows.append((i, " ".join(words), "s"))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = toxic_rows()
    out = toxicity.score_documents(docs(spark, rows), labelled(spark, marks), ["doc_id"]).collect()
    truth = {i: t for i, _, t in marks}
    mine = [r for r in out if held(r["doc_id"])]
    assert len(out) == len(rows)
    assert linear.auc(np.array([truth[r["doc_id"]] for r in mine]), np.array([r["score"] for r in mine])) > 0.98
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in mine]) > 0.97


def test_toxicity_without_labels_and_awkward_rows(spark):
    d = docs(spark, [*awkward(), (60, "You IDIOT, shut up", "s")])
    out = {r["doc_id"]: r["score"] for r in toxicity.score_documents(d, labelled(spark, []), ["doc_id"]).collect()}
    assert out[60] >= 0.5 and all(v < 0.5 for k, v in out.items() if k != 60)
    assert toxicity.score_documents(docs(spark, []), labelled(spark, [(1, 1, 1)]), ["doc_id"]).collect() == []


def test_added_names_do_not_clash(spark):
    d = docs(spark, [(1, "you idiot", "s"), (2, None, "s")]).selectExpr("*", "doc_id AS score", "lang AS _text", "lang AS y", "doc_id AS _id")
    out = toxicity.score_documents(d, labelled(spark, [(1, 1, 1), (2, 1, 0)]), ["doc_id", "score", "_text"])
    assert out.columns == ["doc_id", "score", "_text", "_score"] and {(r["doc_id"], r["score"], r["_text"]) for r in out.collect()} == {(1, 1, "en"), (2, 2, "en")}
    item = " ".join(f"word{i}" for i in range(30))
    leaks = decontamination.find_leaks(docs(spark, [(7, item, "s")]).selectExpr("doc_id AS item_id", "text", "lang AS similarity"), spark.createDataFrame([(3, item)], "item_id long, text string"), key="item_id")
    assert leaks.columns[:2] == ["item_id", "_item_id"] and [tuple(r)[:3] for r in leaks.collect()] == [(7, 3, 1.0)]
    near = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0])], "score long, embedding array<double>"), 5, F.col("score") == 0, key="score")
    assert near.columns == ["query_id", "rank", "score", "_score"] and [tuple(r) for r in near.collect()] == [(0, 1, 1, 1.0)]


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.95, y, ~y)
    poor = np.where(rng.random(4000) < 0.6, y, ~y)
    votes = np.stack([np.where(good, 1, -1), np.where(poor, 1, -1), np.where(good, 1, -1), np.where(rng.random(4000) < 0.9, np.where(y, 1, -1), 0)], 1)
    post, found = toxicity.label_model(votes, 0.3)
    assert np.mean((post >= 0.5) == y) > 0.94
    assert found["weights"][0] < 1 and found["correlations"][0, 2] > 0.3


def leaks(spark, rows, items):
    d = docs(spark, rows)
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b, {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(d, b).collect()}


def test_leaks_wherever_they_start(spark):
    items = [(i, prose(800 + i, n)) for i, n in enumerate((6, 9, 14, 23, 37, 59, 120))]
    rows, want = [], set()
    for i, t in items:
        for k in range(25):
            rows.append((100 * i + k, f"{prose(5000 + 100 * i + k, k)} {t.upper() if k % 2 else t} {prose(9000 + 100 * i + k, 30)}", "s"))
            want.add((100 * i + k, i))
    d, b, found = leaks(spark, rows + [(99999, prose(77, 400), "s")], items)
    assert set(found) == want
    assert all(r["similarity"] == pytest.approx(1.0) and r["first_word"] == i % 100 for (i, _), r in found.items())
    assert [r["doc_id"] for r in decontamination.drop_leaks(d, b).collect()] == [99999]


def test_edited_leaks_as_brute_force_has_them(spark):
    rng = np.random.default_rng(5)
    items = [(i, prose(600 + i, 50)) for i in range(6)]
    rows = []
    for k in range(60):
        w = items[k % 6][1].split()
        for _ in range(k // 12):
            w[int(rng.integers(len(w)))] = "edit"
        rows.append((k, f"{prose(40 + k, 20)} {' '.join(w)} {prose(90 + k, 20)}", "s"))
    _, _, found = leaks(spark, rows, items)
    index = decontamination.ItemIndex(items)
    for k, t, _ in rows:
        words = [w for _, data, off in decontamination.text_blocks(pa.array([t], pa.large_string())) for w in [decontamination.word_hashes(data, off)[0]]][0]
        best = index.similarity(k % 6, decontamination.shingle_set(words[20:70]))
        if best >= 0.75:
            assert (k, k % 6) in found and found[k, k % 6]["similarity"] >= best - 1e-9
        elif best < 0.70:
            assert (k, k % 6) not in found


@pytest.mark.parametrize("sizes", [(15, 23, 30, 59), (60, 64, 75, 90), (120, 125, 130, 160)])
def test_runs_of_edits_against_every_window(sizes):
    rng = random.Random(sum(sizes))
    items = [(i, prose(700 + i, n)) for i, n in enumerate(sizes)]
    index = decontamination.ItemIndex(items)
    texts = []
    for i, t in items:
        for run in range(2, 9):
            for replaced in (True, False):
                for k in range(6):
                    w = t.split()
                    at = rng.randrange(len(w))
                    w[at : at + run if replaced else at] = [f"new{rng.random()}" for _ in range(run)]
                    texts.append((i, f"{prose(rng.randrange(10**6), k)} {' '.join(w)} {prose(rng.randrange(10**6), 70)}"))
    column = pa.array([t for _, t in texts], pa.large_string())
    found = {(row, i): sim for row, i, sim, *_ in index.search(column)}
    (_, data, offsets), = decontamination.text_blocks(column)
    words, first = decontamination.word_hashes(data, offsets)
    some = 0
    for row, (i, _) in enumerate(texts):
        mine = words[first[row] : first[row + 1]]
        best = max(index.similarity(i, decontamination.shingle_set(mine[a : a + sizes[i]])) for a in range(len(mine) - sizes[i] + 1))
        if best >= 0.75:
            some += 1
            assert found.get((row, i), 0) >= best - 1e-9
    assert some > 20


def test_insertions_of_any_length_and_scattered_edits():
    rng = random.Random(4)
    items = [(i, prose(4000 + i, n)) for i, n in enumerate((40, 59, 100))]
    index = decontamination.ItemIndex(items)
    texts, want = [], []
    for i, t in items:
        for run in (1, 3, 5, 8, 12, 16, 24, 30):
            w = t.split()
            at = rng.randrange(1, len(w))
            texts.append((i, rng.randrange(30), w[:at] + [f"new{rng.random()}" for _ in range(run)] + w[at:]))
        for edits in (1, 2, 3, 4, 6) * 4:
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            texts.append((i, rng.randrange(30), w))
    column = pa.array([f"{prose(rng.randrange(10**6), k)} {' '.join(w)} {prose(rng.randrange(10**6), 60)}" for _, k, w in texts], pa.large_string())
    found = {(row, i): sim for row, i, sim, *_ in index.search(column)}
    (_, data, offsets), = decontamination.text_blocks(column)
    words, first = decontamination.word_hashes(data, offsets)
    for row, (i, k, w) in enumerate(texts):
        sim = index.similarity(i, decontamination.shingle_set(words[first[row] + k : first[row] + k + len(w)]))
        if sim >= 0.75:
            want.append((i, len(w)))
            assert found.get((row, i), 0) >= sim - 1e-9
    assert {(2, 108), (2, 112), (2, 116)} <= set(want) and len(want) > 25  # 30 words inserted leave 0.71


def test_equal_copies_start_at_the_first(spark):
    item = prose(3, 12)
    _, _, found = leaks(spark, [(1, f"a b {item} c {item}", "s"), (2, f"{prose(4, 5)} one two x one two", "s")], [(1, item), (2, "one two")])
    assert {k: (r["similarity"], r["first_word"], r["n_words"]) for k, r in found.items()} == {(1, 1): (1.0, 2, 12), (2, 2): (1.0, 5, 2)}


def test_blocks_of_items_do_not_change_results(spark, monkeypatch):
    rng = random.Random(9)
    shared = prose(50, 12)
    items = [(i, f"{prose(300 + i, 24)} {shared if i % 2 else ''} {prose(400 + i, 6)}") for i in range(12)] + [(12, prose(51, 9))]
    rows = []
    for k in range(240):
        w = items[k % 13][1].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((k, f"{prose(k, 12)} {' '.join(w)} {prose(k + 1, 9)}", "s"))
    d, b, whole = leaks(spark, rows, items)
    kept = {r["doc_id"] for r in decontamination.drop_leaks(d, b).collect()}
    monkeypatch.setattr(decontamination, "ITEM_BLOCK", 3)
    d, b, dealt = leaks(spark, rows, items)
    assert dealt == whole and 60 < len(whole) < 240
    assert {r["doc_id"] for r in decontamination.drop_leaks(d, b).collect()} == kept == set(range(240)) - {i for i, _ in whole}


def test_leaks_of_awkward_rows(spark):
    items = [(1, prose(2, 90)), (2, None), (None, "x y z"), (3, " "), (4, "one two"), (5, "lonelyword")]
    _, _, found = leaks(spark, [*awkward(), (70, "a lonelyword b", "s")], items)
    assert set(found) == {(30, 1), (31, 1), (43, 4), (44, 4), (70, 5)}
    assert leaks(spark, [], items)[2] == {} and leaks(spark, awkward(), [])[2] == {}


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            scored = sorted(((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 12), j) for j, v in good if j != i and len(v) == len(q)))
            out[i] = [j for _, j in scored[:k]]
    return out


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, 5, F.col("vec_id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_over_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(3000)]
    want, got = brute_nearest(rows, 5), search(spark, rows, shard_points=900)
    assert np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9


def test_graphs_and_queries_do_not_pass_the_driver(spark, monkeypatch):
    plans = {}

    def kept(df, name, *args, materialize=ann.materialize):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name, *args)

    monkeypatch.setattr(ann, "materialize", kept)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)] + [(i, rng.normal(size=5).tolist()) for i in range(3000, 3100)]
    want, got = brute_nearest(rows, 5), search(spark, rows, shard_points=900)
    assert set(got) == set(want) and np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want]) >= 0.9
    assert "Join" not in plans["ann-hits"] and "Broadcast" not in plans["ann-hits"]


def test_few_copies_and_unusable_vectors(spark):
    hot = [0.5, 0.25, -1.0]
    rows = [(i, hot) for i in range(0, 200, 2)] + [(1, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])]
    rows += [(5, None), (7, [0.0, 0.0, 0.0]), (9, [float("nan"), 1.0, 0.0]), (11, [float("inf"), 1.0, 0.0]), (13, [None, 1.0, 0.0]), (15, []), (None, hot), (17, [1.0, 2.0])]
    got = search(spark, rows)
    assert got[0] == [2, 4, 6, 8, 10] and got[50] == [0, 2, 4, 6, 8] and set(got) == {0, 50, 100, 150}
    assert search(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]) == {0: [2, 1]}
    assert search(spark, []) == {} and search(spark, [(0, [1.0])]) == {}


def test_copies_with_repeated_rows(spark):
    hot = [0.5, 0.25, -1.0]
    rows = [(i, hot) for i in (0, 0, 0, 0, 2, 4, 4, 6, 8, 10, 12)] + [(1, [0.5, 0.25, -0.9]), (3, [0.5, 0.2, -1.0])]
    assert search(spark, rows) == {0: [2, 4, 6, 8, 10]}


def test_every_point_can_be_reached():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 8)) * 0.01 + c for c in rng.normal(size=(5, 8)) * 10])
    graph = ann.build_graph(ann._unit(x))
    seen, front = {graph.entry}, [graph.entry]
    while front:
        front = [j for i in front for j in graph.edges[i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == len(x)


def test_nearest_of_extreme_lengths(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 6))
    scale = [1e200, 1e-200, 1.0]
    rows = [(i, [float(x) for x in v * scale[i % 3]]) for i, v in enumerate(base)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, F.col("vec_id") % 10 == 0).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        want = sorted((-float(unit[q] @ unit[i]), i) for i in range(60) if i != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in mine] == [i for _, i in want] and all(abs(s + w) < 1e-12 for (_, _, s), (w, _) in zip(mine, want, strict=True))
