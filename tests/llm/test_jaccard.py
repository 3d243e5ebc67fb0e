from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from attestra.llm import jaccard
from attestra.llm.common import text_blocks
from attestra.llm.components import components

from .helpers import WORDS, awkward, docs, prose

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(t):
    w = (t or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    last = 1 << 63
    sets = [(last if i is None else i, shingles(t)) for i, t, _ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(sets):
        best[find(k)] = min(best.get(find(k), last), i)
    none = lambda i: None if i == last else i
    return sorted(((none(i), len(s), none(best[find(k)]) if s else none(i)) for k, (i, s) in enumerate(sets)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.integers(len(w))] = WORDS[rng.integers(len(WORDS))]
    return " ".join(w)


def crowd(n=90, size=80):
    """Near copies of a few texts, texts around a common line, and texts near the threshold."""
    rng = np.random.default_rng(3)
    line = prose(9, 14)
    rows = []
    for i in range(n):
        base = prose(500 + i % 4, size)
        rows.append((i, edited(base, rng, int(rng.integers(0, 4))), "s"))
        rows.append((1000 + i, f"{line} {prose(700 + i, int(rng.integers(2, 20)))}", "s"))
        rows.append((2000 + i, " ".join(prose(900, 200).split()[: 100 + i]), "s"))
    return rows


@pytest.mark.parametrize("common", [24, 2, 0])
def test_components_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = awkward() + crowd()
    assert got(jaccard.group_near_duplicates(docs(spark, rows), keep=["doc_id"])) == brute(rows)


def test_whole_rows_and_one_of_each(spark):
    rows = awkward() + [(20, prose(1, 120), "again")]
    d = docs(spark, rows)
    expected = brute(rows)
    whole = jaccard.group_near_duplicates(d)
    assert whole.columns == [*d.columns, "n_shingles", "component_id"]
    assert got(whole) == expected
    kept = jaccard.keep_one_of_each(d)
    assert kept.columns == d.columns
    groups = {c for i, n, c in expected if n}
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(groups) + sum(1 for _, n, _ in expected if not n)
    assert {i for i in ids if i is not None} >= {c for c in groups if c is not None}


def test_held_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD_ROWS", 500)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    rows = crowd(40)
    assert got(jaccard.group_near_duplicates(docs(spark, rows), keep=["doc_id"])) == brute(rows)


def test_empty(spark):
    assert jaccard.group_near_duplicates(docs(spark, [])).collect() == []
    assert got(jaccard.group_near_duplicates(docs(spark, [(1, None, "s"), (2, " ", "s")]), keep=["doc_id"])) == [(1, 0, 1), (2, 0, 2)]


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(0)
    texts = [prose(1, 300), edited(prose(1, 300), rng, 20), prose(2, 80)]
    for _, data, offsets in text_blocks(pa.array(texts, pa.large_string())):
        items, at = jaccard.shingle_sets(data, offsets)
        sets = [set(items[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
        bits = [np.frombuffer(b, np.uint8) for b in jaccard.bitmaps(items, at)]
        fixed = jaccard.sketches(items, at)
        for a in range(3):
            for b in range(3):
                n = min(len(bits[a]), len(bits[b]))
                assert np.bitwise_count(jaccard._fold(bits[a], n) ^ jaccard._fold(bits[b], n)).sum() <= len(sets[a] ^ sets[b])
                assert sum(int(np.bitwise_count(c[a] ^ c[b])) for c in fixed) <= len(sets[a] ^ sets[b])


def test_partners_share_a_universe():
    for size in range(1, 400):
        own = np.searchsorted(jaccard.EDGES, size, side="right") - 1
        largest = size * 4 // 3
        assert np.searchsorted(jaccard.EDGES, largest, side="right") - 1 <= own + 1


def test_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {labels[i] for i in range(61)} == {0} and {labels[100 + i] for i in range(50)} == {100} and labels.get(200, 200) == 200


def test_parcels_are_short_and_whole():
    """Signatures travel in less than eight bytes each, also where a text sends few to a partition or very many."""
    texts = [prose(s, 400) for s in range(30)] + [prose(99, 9000), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    expected = []
    for _, data, offsets in text_blocks(batch.column(0)):
        items, at = jaccard.shingle_sets(data, offsets)
        c, _ = jaccard.class_hashes(items, np.diff(at))
        real = np.flatnonzero(np.diff(at))
        for u, (which, band) in enumerate(jaccard.universes(np.diff(at)[real])):
            owner, sig, _ = jaccard.signatures(items, at, 0, real[which], band)
            expected += [(s % (1 << 8 * jaccard.SIG_BYTES), k, u) for s, k in zip(sig.tolist(), c[owner].view(np.int64).tolist(), strict=True)]
    for parts in (3, 50):
        packed = list(jaccard._parcels(parts)([batch]))
        assert sum(len(v.as_buffer()) for p in packed for column in p.columns[1:] for v in column) < 8 * len(expected)
        found = [row for p in packed for parcel in zip(*p.columns[1:], strict=True) for row in zip(*map(np.ndarray.tolist, jaccard.unpack_parcel(*(v.as_buffer() for v in parcel))), strict=True)]
        assert sorted(found) == sorted(expected)


def test_groups_of_all_sizes(spark):
    """Groups are one row each: their first class is compared with the others, then those among themselves."""
    rng = np.random.default_rng(5)
    rows = []
    for g in (2, 3, 4, 7, 24, 25, 30):
        shared = prose(60 + g, 60)
        rows += [(100 * g + i, edited(f"{shared} {prose(800 + 10 * g + i // 2, 15)}", rng, i % 3), "s") for i in range(g)]
    assert got(jaccard.group_near_duplicates(docs(spark, rows + rows[:5]), keep=["doc_id"])) == brute(rows + rows[:5])
