"""op10 -- benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact verification.

Documents are cut into tiles of a few words, and windows are two adjacent tiles; longer windows
add up shorter tiles.  An item belongs to the widest windows of which any stretch of its length
holds a whole one.  The index holds the SimHash of *every* window of that width in the item, so a
copied passage meets one of them at distance 0 wherever it starts, and an edited one stays near.

Fingerprints within ``RADIUS`` of an indexed one are all found: of four 16-bit blocks at least one
differs by at most ``RADIUS // 4`` bits, and the index lists each block's neighbours at that
distance.

Windows at tile starts miss edited passages, so the search does not rest on them: an item's rarest
shingles, of more than ``1 - SIMILARITY`` of its weight together, are its anchors, and every shingle
of a document is looked up.  A passage without an anchor holds too little of the item, so no similar
passage is lost.  Around each candidate passages of every length that can be similar are compared by
the weighted similarity of word shingles, so insertions of any number of words are found.

Documents stream past the index in one pass and are not shuffled.  Items are loaded in blocks of
``ITEM_BLOCK``, one pass each.  Weights and the tile are those of the whole benchmark, so blocks do
not change results; besides its block a task holds the shingles that two or more items share.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, lower_ascii, shingle_hashes, signed, table, text_blocks, word_hashes

RADIUS = 7
SHINGLE = 5
SIMILARITY = 0.75
#: Items a pass over the documents looks for (an index of about 20 MB for 40-word items).
ITEM_BLOCK = 2_000

_BLOCKS, _BITS = 4, 16
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(a ^ b).view(np.uint16).reshape(-1, 4)
    return _POP[x].sum(1)


def _tiles(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Per tile of ``size`` words from ``starts``, how many words have each of 64 hash bits set."""
    picked = words[starts[:, None] + np.arange(size)]
    bits = np.unpackbits(picked.view(np.uint8).reshape(len(starts), size, 8), axis=2)
    return bits.sum(axis=1, dtype=np.uint8 if size < 128 else np.uint16).reshape(len(starts), 64).astype(np.uint16)


def _majority(ones: np.ndarray, width: int) -> np.ndarray:
    return np.packbits(ones > width // 2, axis=1).view(np.uint64).ravel()


def simhashes(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the windows of ``width`` words from ``starts``: the majority of each hash bit."""
    return _majority(_tiles(words, starts, width), width)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Shingles of five words; fewer words are one shingle, no words none."""
    return shingle_hashes(words, min(SHINGLE, len(words))) if len(words) else np.empty(0, np.uint64)


def _words_of(column: pa.Array) -> list[np.ndarray]:
    """Word hashes of each text."""
    words: list[np.ndarray] = []
    for _, data, offsets in text_blocks(column):
        hashes, first = word_hashes(lower_ascii(data), offsets)
        words += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return words


class Statistics(NamedTuple):
    """What weights and tiles come from, over the whole benchmark."""

    items: int
    least: int  # words of the shortest item
    shared: np.ndarray  # sorted shingles of two or more items
    counts: np.ndarray  # and how many hold each


class ItemIndex:
    """The benchmark's fingerprints and shingle weights, as shipped to tasks.

    ``items`` may be a block of the benchmark; ``statistics`` are those of all of it (default: ``items``).
    """

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        kept = [(i, t) for i, t in items if t]
        words = _words_of(pa.array([t for _, t in kept], pa.large_string()))
        self.items = [(i, w) for (i, _), w in zip(kept, words, strict=True) if len(w)]
        self.sets = [np.unique(shingle_set(w), return_counts=True) for _, w in self.items]
        if statistics is None:
            held, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *[s for s, _ in self.sets]]), return_counts=True)
            statistics = Statistics(len(self.items), min((len(w) for _, w in self.items), default=2), held[counts > 1], counts[counts > 1])
        # Shingles of fewer items weigh more; what one item or none holds weighs most.
        self.shingles, self.weights = statistics.shared, np.log1p(statistics.items / np.maximum(statistics.counts, 1))
        self.rare = float(np.log1p(statistics.items)) if statistics.items else 1.0
        self.totals = [float((self.weigh(s) * n).sum()) for s, n in self.sets]
        self.tile = max(1, (statistics.least + 1) // 3)
        self.classes = []
        level = 0
        while any(len(w) >= 3 * (self.tile << level) - 1 for _, w in self.items):
            stride = self.tile << level
            group = [k for k, (_, w) in enumerate(self.items) if 3 * stride - 1 <= len(w) < 6 * stride - 1]
            self._add(level, 2 * stride, group)
            level += 1
        self._add(-1, 1, [k for k, (_, w) in enumerate(self.items) if len(w) == 1])  # one word, one tile
        self.tables = [[self._table(c[2], b) for b in range(_BLOCKS)] for c in self.classes]
        self.anchors = self._anchors()

    def _anchors(self) -> list[tuple]:
        """Per shingle width: sorted anchors, offsets into their items, the items, and a filter by the upper bits."""
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, ((_, w), (s, n)) in enumerate(zip(self.items, self.sets, strict=True)):
            weights = self.weigh(s) * n
            order = np.argsort(-self.weigh(s), kind="stable")
            some = int(np.searchsorted(np.cumsum(weights[order]), (1 - SIMILARITY) * self.totals[k] + 1e-6, side="right")) + 1
            found.setdefault(min(SHINGLE, len(w)), []).append((s[order[:some]], k))
        out = []
        for width, lists in sorted(found.items()):
            every, owner = np.concatenate([s for s, _ in lists]), np.repeat([k for _, k in lists], [len(s) for s, _ in lists])
            order = np.argsort(every, kind="stable")
            keys, at = np.unique(every[order], return_index=True)
            sieve = np.zeros(1 << 20, bool)
            sieve[keys >> np.uint64(44)] = True
            out.append((width, keys, np.append(at, len(every)), owner[order], sieve))
        return out

    def _add(self, level: int, width: int, group: list[int]) -> None:
        prints, owner, shift = [], [], []
        for k in group:
            starts = np.arange(len(self.items[k][1]) - width + 1)
            prints.append(simhashes(self.items[k][1], starts, width))
            owner += [k] * len(starts)
            shift += starts.tolist()
        if group:
            self.classes.append((level, width, np.concatenate(prints), np.array(owner), np.array(shift)))

    @staticmethod
    def _table(prints: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Posting lists by block value, neighbours within ``RADIUS // _BLOCKS`` bits included."""
        keys = prints.view(np.uint16).reshape(-1, _BLOCKS)[:, block].astype(np.int64)
        near = [0]
        for r in range(1, RADIUS // _BLOCKS + 1):
            near += [sum(1 << b for b in c) for c in combinations(range(_BITS), r)]
        every = (keys[:, None] ^ np.array(near)).ravel()
        owner = np.repeat(np.arange(len(prints)), len(near))
        order = np.argsort(every, kind="stable")
        return np.searchsorted(every[order], np.arange((1 << _BITS) + 1)).astype(np.int32), owner[order].astype(np.int32)

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.rare)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.weights[at], self.rare)

    def similarity(self, k: int, shingles: np.ndarray) -> float:
        """Weighted Jaccard similarity (of multisets) of item ``k`` and a passage's shingles."""
        mine, n = self.sets[k]
        theirs, m = np.unique(shingles, return_counts=True)
        _, a, b = np.intersect1d(mine, theirs, assume_unique=True, return_indices=True)
        both = float((self.weigh(mine[a]) * np.minimum(n[a], m[b])).sum())
        total = self.totals[k] + float((self.weigh(theirs) * m).sum()) - both
        return both / total if total else 0.0

    def candidates(self, words: np.ndarray, first: np.ndarray):
        """Yield ``(item, start)`` arrays: where items would start in a block of documents' words."""
        counts = np.diff(first) // self.tile
        where = np.cumsum(counts) - counts
        starts = np.repeat(first[:-1] - where * self.tile, counts) + np.arange(counts.sum()) * self.tile
        tiles, at = _tiles(words, starts, self.tile), 0
        for (level, width, prints, owner, shift), tables in zip(self.classes, self.tables, strict=True):
            while at < level:  # two tiles are one of the next level, from each document's start
                pairs = counts // 2
                begin = np.cumsum(pairs) - pairs
                left = np.repeat(where - 2 * begin, pairs) + 2 * np.arange(pairs.sum())
                tiles, starts, counts, where, at = tiles[left] + tiles[left + 1], starts[left], pairs, begin, at + 1
            if level < 0:
                starts = np.arange(len(words))
                found = simhashes(words, starts, 1)
            else:
                n = np.maximum(counts - 1, 0)
                left = np.repeat(where - np.cumsum(n) + n, n) + np.arange(n.sum())
                found = _majority(tiles[left] + tiles[left + 1], width)
            begins = starts if level < 0 else starts[left]
            if not len(found):
                continue
            parts = found.view(np.uint16).reshape(-1, _BLOCKS)
            seen = []
            for b, (offsets, posting) in enumerate(tables):
                key = parts[:, b].astype(np.int64)
                size = offsets[key + 1] - offsets[key]
                some = np.flatnonzero(size)
                size = size[some]
                which = np.repeat(some, size)
                into = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[key[some]], size)
                entry = posting[into]
                near = _hamming(found[which], prints[entry]) <= RADIUS
                seen.append(which[near] * np.int64(len(prints)) + entry[near])
            pairs = np.unique(np.concatenate(seen))
            entry = pairs % len(prints)
            yield owner[entry], begins[pairs // len(prints)] - shift[entry]

    def anchored(self, words: np.ndarray, first: np.ndarray, full: np.ndarray):
        """Yield ``(row, item, place)`` arrays of all anchors in a block of documents' words."""
        for width, keys, offsets, owner, sieve in self.anchors:
            every = full if width == SHINGLE else shingle_hashes(words, width)
            place = np.flatnonzero(sieve[every >> np.uint64(44)])
            at = np.minimum(np.searchsorted(keys, every[place]), len(keys) - 1)
            same = keys[at] == every[place]
            place, at = place[same], at[same]
            row = np.searchsorted(first, place, side="right") - 1
            whole = place + width <= first[row + 1]
            place, at, row = place[whole], at[whole], row[whole]
            size = offsets[at + 1] - offsets[at]
            into = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[at], size)
            yield np.repeat(row, size), owner[into], np.repeat(place, size)

    def _passages(self, k: int, full: np.ndarray, lo: int, hi: int, places: list[int], every: np.ndarray):
        """The best ``(similarity, -start, -words)`` of the passages of words ``lo`` to ``hi`` around ``places``, or None.

        ``every`` is the running weight of the row's shingles.  A similar passage weighs
        ``total / SIMILARITY`` at most, and the best one starts and ends with a shingle of the item,
        since others at its ends only add to the union.  So all lengths are covered.
        """
        mine, total = self.sets[k][0], self.totals[k]
        room, count = total / SIMILARITY + 1e-9, len(every) - 1
        spans: list[list[int]] = []
        for p in places if count > 0 else []:
            q = min(max(p - lo, 0), count - 1)
            a = int(np.searchsorted(every, every[q + 1] - room))
            z = int(np.searchsorted(every, every[q] + room, side="right")) - 1
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(z, spans[-1][1])
            else:
                spans.append([a, z])
        found: list[tuple[np.ndarray, ...]] = []
        for a, z in spans:
            part = full[lo + a : lo + z]
            held = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, part), len(mine) - 1)] == part)
            before, after = every[a + held], every[a + held + 1]
            both = np.append(0.0, np.cumsum(after - before))
            if both[-1] < SIMILARITY * total - 1e-9:
                continue
            first = np.arange(len(held))
            size = np.searchsorted(after, before + room, side="right") - first
            for block in np.split(first, np.flatnonzero(np.diff(np.cumsum(size) >> 20)) + 1):  # about a million pairs at a time
                i = np.repeat(block, size[block])
                j = i + np.arange(len(i)) - np.repeat(np.cumsum(size[block]) - size[block], size[block])
                # Exact unless the passage repeats a shingle more often than the item; then too high.
                shared = np.minimum(both[j + 1] - both[i], total)
                bound = shared / (total + after[j] - before[i] - shared)
                likely = bound >= SIMILARITY - 1e-9
                found.append((bound[likely], held[i[likely]] + a + lo, held[j[likely]] - held[i[likely]] + SHINGLE))
        if not found:
            return None
        bounds, starts, words = (np.concatenate(x) for x in zip(*found, strict=True))
        best = None
        for at in np.lexsort((words, starts, -np.round(bounds, 9))).tolist():
            if best and (best[0] >= 1 or bounds[at] < best[0] - 2e-9):
                break
            sim = self.similarity(k, full[starts[at] : starts[at] + words[at] - SHINGLE + 1])
            if sim >= SIMILARITY:
                best = max(best or (0.0,), (sim, -int(starts[at]), -int(words[at])))
        return best

    def search(self, column: pa.Array):
        """Yield ``(row, item, similarity, first word, words)``, the best of each row and item."""
        for first_row, data, offsets in text_blocks(column, 1 << 18):
            words, first = word_hashes(lower_ascii(data), offsets)
            full = shingle_hashes(words, SHINGLE)
            lengths = np.array([len(w) for _, w in self.items])
            met = list(self.anchored(words, first, full))
            for owners, starts in self.candidates(words, first):
                long = lengths[owners] >= SHINGLE  # shorter items are found by their anchors only
                owners, starts = owners[long], starts[long]
                middle = np.clip(starts + lengths[owners] // 2, 0, len(words) - 1)
                met.append((np.searchsorted(first, middle, side="right") - 1, owners, middle))
            around: dict[tuple[int, int], list[int]] = {}
            if met:
                rows, owners, places = (np.concatenate(x) for x in zip(*met, strict=True))
                order = np.lexsort((places, owners, rows))
                for row, k, place in zip(rows[order].tolist(), owners[order].tolist(), places[order].tolist(), strict=True):
                    around.setdefault((row, k), []).append(place)
            running: tuple[int, np.ndarray] = (-1, np.empty(0))
            for (row, k), places in around.items():  # in order of rows
                lo, hi = int(first[row]), int(first[row + 1])
                if running[0] != row:
                    running = (row, np.append(0.0, np.cumsum(self.weigh(full[lo : max(hi - SHINGLE + 1, lo)]))))
                if lengths[k] < SHINGLE:
                    yield first_row + row, self.items[k][0], 1.0, places[0] - lo, int(lengths[k])
                elif best := self._passages(k, full, lo, hi, places, running[1]):
                    yield first_row + row, self.items[k][0], best[0], -best[1] - lo, -best[2]


def _statistics(rows: DataFrame, text: str) -> Statistics:
    """Items, the shortest one's words and the shared shingles, counted over all ``rows``."""

    def shingles(batches):
        for batch in batches:
            words = _words_of(batch.column(0))
            sets = [np.unique(shingle_set(w)) for w in words]
            sizes = [len(s) for s in sets]
            every = np.concatenate([np.empty(0, np.uint64), *sets])
            yield pa.RecordBatch.from_arrays([pa.array(signed(every)), pa.array(np.repeat([len(w) for w in words], sizes).astype(np.int64))], names=["shingle", "words"])

    counted = rows.select(F.col(text)).mapInArrow(shingles, "shingle long, words long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("words").alias("words"))
    total = rows.count()
    least, shared = counted.agg(F.min("words"), F.collect_list(F.when(F.col("n") > 1, F.struct("shingle", "n")))).first()
    keys = np.array([r["shingle"] for r in shared], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Statistics(total, 2 if least is None else least, keys[order], np.array([r["n"] for r in shared], np.int64)[order])


def _indexes(items: DataFrame, item: str, text: str) -> list[ItemIndex]:
    """One index per block of the benchmark, all with the statistics of the whole."""
    rows = items.filter(F.col(item).isNotNull() & F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(F.col(item).cast("long"), F.col(text))
    statistics = _statistics(rows, text)
    parts = max(1, -(-statistics.items // ITEM_BLOCK))
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    return [ItemIndex([tuple(r) for r in rows.filter(part == b).orderBy(*rows.columns).collect()], statistics) for b in range(parts)]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, item_id, similarity, first_word, n_words)`` per document row and item it holds.

    Null or empty texts and items match nothing; repeated rows are reported each.  Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Added names that clash with the key's get a leading underscore.
    """
    names = free_name(docs.select(key), "item_id", "similarity", "first_word", "n_words")
    types = (T.LongType(), T.DoubleType(), T.LongType(), T.LongType())
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *map(T.StructField, names, types)])
    out = None
    for index in _indexes(items, item, item_text):

        def run(batches, index=index):
            for batch in batches:
                rows, *rest = zip(*found, strict=True) if (found := list(index.search(batch.column(1)))) else [()] * 5
                keys = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)]], names=schema.names)

        found = docs.select(key, text).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _without(index: ItemIndex):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        out[[row for row, *_ in index.search(texts)]] = False
        return pa.array(out)

    return clean


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns as they were, nothing shuffled."""
    for index in _indexes(items, item, item_text):
        docs = docs.filter(_without(index)(F.col(text)))
    return docs


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
