from __future__ import annotations

import re

import pytest

from attestra.llm import mixing

from .helpers import awkward, docs


def targets(sizes, share=1.5, weights=(5.0, 2.0, 1.0), most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return out


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_sizes(spark):
    rows = awkward() + [(1000 + i, f"word {i} and more", f"s{i % 7}") for i in range(300)]
    out = mixing.mix(docs(spark, rows), keep=["doc_id", "source"]).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["copies"] in (0, 1, 2)


def test_taken_is_near_the_target(spark):
    rows = [(i, "a " * (5 + i % 9), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    out = mixing.mix(docs(spark, rows), keep=["doc_id", "source"]).collect()
    for s in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 13


def test_budgets_are_nested(spark):
    d = docs(spark, [(i, "a b c", "s" if i % 2 else "t") for i in range(400)])
    less = {r["doc_id"]: r["copies"] for r in mixing.mix(d, keep=["doc_id"], share=0.5, weights=(1.0,)).collect()}
    more = {r["doc_id"]: r["copies"] for r in mixing.mix(d, keep=["doc_id"], share=0.9, weights=(1.0,)).collect()}
    assert all(more[i] >= n for i, n in less.items()) and sum(less.values()) < sum(more.values())


def test_whole_rows_and_the_keyed_join_agree(spark, monkeypatch):
    d = docs(spark, awkward())
    key = lambda r: repr((r["doc_id"], r["source"], r["copies"]))
    a = sorted(map(key, mixing.mix(d).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert sorted(map(key, mixing.mix(d).collect())) == a
    assert sorted(map(key, mixing.mix(d, keep=["doc_id", "source"]).collect())) == a


def test_repeat_rows_and_empty(spark):
    mixed = mixing.mix(docs(spark, [(i, "a b", "s") for i in range(10)]))
    assert mixing.repeat_rows(mixed).count() == sum(r["copies"] for r in mixed.collect())
    assert mixing.mix(docs(spark, [])).collect() == []
    none = mixing.mix(docs(spark, [(1, None, "s"), (2, "", None)])).collect()
    assert {(r["size"], r["copies"]) for r in none} == {(0, 0)}


def test_native_plan(spark):
    plan = mixing.mix(docs(spark, awkward()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
