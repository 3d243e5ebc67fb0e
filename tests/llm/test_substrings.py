from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import suffixdedup, substrings
from attestra.llm.suffixes import suffix_array

from .helpers import awkward, docs, prose


def brute_words(rows, window=13):
    last = 1 << 63
    split = [(last if i is None else i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, last), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((None if i == last else i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = {}
    for _, b in texts:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shared_rows(n=24):
    """Many documents around one passage, some passages cut short, repeats inside a document."""
    line, passage = prose(71, 20), prose(72, 110)
    rows = [(i, f"{prose(200 + i, 30)} {line} {prose(300 + i, 10)} {' '.join(passage.split()[i % 7 : 110 - i % 5])} {prose(400 + i, 25)}", "s") for i in range(n)]
    rows.append((900, f"{passage} {prose(73, 12)} {passage}", "s"))
    return rows


@pytest.mark.parametrize("batches", [1, 3])
def test_windows_against_brute_force(spark, batches):
    rows = awkward() + shared_rows()
    got = substrings.remove_repeats(docs(spark, rows), batches=batches, keep=["doc_id"])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()), key=repr) == brute_words(rows)


def test_windows_with_repeated_keys(spark):
    rows = awkward() + [(20, prose(1, 120), "s"), (20, prose(9, 40), "s"), (22, prose(9, 40), "s")]
    got = substrings.remove_repeats(docs(spark, rows), keep=["doc_id"])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()), key=repr) == brute_words(rows)


def test_index_compacts_and_opens_again(spark, tmp_path):
    rows = shared_rows(16)
    d = docs(spark, rows).select(F.col("doc_id").alias("o"), F.lit(0).cast("long").alias("t"), "text")
    path, spans = f"file://{tmp_path}/index", {}
    for at, (low, high) in enumerate([(0, 4), (4, 8), (8, 13), (13, 1000)]):
        index = substrings.FingerprintIndex(spark, path, buckets=3 if at == 0 else None)
        for r in index.add(d.filter(F.col("o").between(low, high - 1))).collect():
            spans[r["o"]] = r["spans"]
        assert index.buckets == 3 and index.levels() == [[(0, 1)], [(1, 2)], [(0, 3), (1, 2)], [(2, 4)]][at]
        if at == 2:
            keys = d.select(F.col("o").alias("fp")).repartition(3, "fp").hint("merge")
            plan = spark.table(index.runs).select("fp").join(keys, "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # the batch's keys; runs stay in their buckets
        index.close()
    want = {i: n for i, _, n, _ in brute_words(rows)}
    for i, t, _ in rows:
        gone = {w for s in spans.get(i, []) for w in range(s["start"], s["start"] + s["n"] + 12)}
        assert len(gone) == want[i], i


def test_windows_empty_and_names(spark):
    assert substrings.remove_repeats(docs(spark, [])).collect() == []
    d = docs(spark, [(1, "a b", "s")]).withColumnRenamed("lang", "n_words")
    assert substrings.remove_repeats(d).columns == ["doc_id", "n_words", "source", "n_chars", "kept_text", "_n_words", "n_removed"]


def byte_result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_bytes_against_brute_force(spark):
    rows = awkward() + shared_rows()
    d = docs(spark, rows)
    assert byte_result(suffixdedup.remove_repeats(d)) == brute_bytes(rows, 400)
    assert byte_result(suffixdedup.remove_repeats(d, keep_bytes=False)) == brute_bytes(rows, 400)


@pytest.mark.parametrize("group", [0, 6])
def test_hot_groups_are_split_exactly(spark, monkeypatch, group):
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    rows = shared_rows(12)
    assert byte_result(suffixdedup.remove_repeats(docs(spark, rows))) == brute_bytes(rows, 400)


def test_bytes_of_equal_rows_and_runs(spark):
    same = prose(5, 100)
    rows = [(1, same, "s"), (1, same, "s"), (2, "a" * 401, "s"), (3, "b" * 400, "s"), (4, "ab" * 900, "s"), (None, "b" * 399, "s")]
    assert byte_result(suffixdedup.remove_repeats(docs(spark, rows))) == brute_bytes(rows, 400)
    assert suffixdedup.remove_repeats(docs(spark, [])).collect() == []


def test_kept_bytes(spark):
    rows = awkward()
    for r in suffixdedup.remove_repeats(docs(spark, rows)).filter(F.col("n_removed") == 0).collect():
        assert bytes(r["kept"]) == next((t or "").encode() for i, t, _ in rows if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in range(40):
        for k in (1, 2, 3, 7):
            for _ in range(4):
                a = rng.integers(0, k, n).tolist()
                assert suffix_array(np.array(a, np.int64)).tolist() == sorted(range(n), key=lambda i: a[i:])  # noqa: B023
