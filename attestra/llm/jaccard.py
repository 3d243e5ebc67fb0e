"""op5 -- exact n-gram Jaccard self-join by universe partitioning.

A document's set is its distinct word shingles.  Sets of similar size share a band, and a band
hashes the universe of shingles into segments.  Two sets with Jaccard similarity 0.75 or more
differ in at most ``(|x| + |y|) / 7`` shingles, so with enough segments some segment must agree
(pigeonhole).  Per set and segment the subset's hash is a signature; sets that share one are
candidates.

Cost-based allocation: a signature of more than ``COMMON`` classes is dear, so it is skipped.  A
set that still has more unskipped segments than it may have differences is safe: its partners are
found.  Only pairs of two unsafe sets can be missed; unsafe sets take a second, coarser partition
in which each segment also indexes its one-deletion neighbourhood (segments that differ by one
shingle agree).  For sets that are unsafe there as well every shingle is a segment, and the
pigeonhole is allocated to the cheapest: a quarter of the set, the rarest shingles first.

Equal sets are one class from the start.  Within a group of classes with one signature, pairs are
verified leader by leader and only between classes that are not connected yet, so groups of near
copies cost about their size, not its square.  Every link between different components is verified
or refuted; none is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, free_name, give_back, lower_ascii, materialize, mix, release, shingle_hashes, signed, table, text_blocks, word_hashes
from .components import merge_labels

SHINGLE = 5
#: Links: ``DEN * |x & y| >= NUM * |x | y|``.
NUM, DEN = 75, 100
#: A signature of more classes than this is skipped where sets can afford it.
COMMON = 24
#: Rows of a round's tables that go to one file.
ROUND_ROWS = 100_000
#: Leaders per group and round, and whether they come from the group's largest component or from outside it.
LEADERS = ((1, None), (8, True), (24, True), (32, False), (256, False), (2048, False))
#: Rows a reducer holds before it lets go of signatures already known to be common.
HELD_ROWS = 2_000_000
#: Signatures of a partition, on average.
PART_ROWS = 1_000_000
#: Bytes of a signature within its partition.  Different ones that agree in them only make candidates more.
SIG_BYTES = 5
_LAST = (1 << 63) - 1


def _edges() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 16 // 9)))
    return np.array(out, np.int64)


#: Band ``u`` holds sizes from ``EDGES[u]`` to below ``EDGES[u + 1]``; a partner is in the same or the next band.
EDGES = _edges()


def _shingles_a_segment(size: np.ndarray) -> np.ndarray:
    """Small sets need smaller segments, lest too many are empty."""
    return np.select([size >= 200, size >= 100, size >= 40, size >= 16], [2.7, 2.4, 1.9, 1.2], 0.5)


def segments(band: np.ndarray, level: int) -> np.ndarray:
    """Segments of a band's universe: level 0 exact subsets, 1 with one-deletion neighbourhoods."""
    top = EDGES[band + 1] - 1
    return np.maximum(np.round(top / (_shingles_a_segment(top) if level == 0 else 4.0)), 1).astype(np.int64)


def differences(size: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Most shingles in which a set and any partner in the universe of ``band`` can differ."""
    return (size + np.minimum(EDGES[band + 1] - 1, size * 4 // 3)) // 7


def universes(size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(which sets, band)``: every set in its own band, and in the next if a partner can be there."""
    own = np.searchsorted(EDGES, size, side="right") - 1
    cross = size * 4 // 3 >= EDGES[own + 1]
    return [(np.arange(len(size)), own), (np.flatnonzero(cross), own[cross] + 1)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row of a block, and row offsets into them."""
    words, at = word_hashes(lower_ascii(data), offsets)
    counts = np.diff(at)
    n = len(counts)
    full = shingle_hashes(words, SHINGLE)
    per = np.maximum(counts - SHINGLE + 1, 0)
    rows = np.repeat(np.arange(n), per)
    begin = np.repeat(at[:-1] - np.cumsum(per) + per, per)
    items = full[begin + np.arange(per.sum())] if per.sum() else np.empty(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = np.array([mix(shingle_hashes(words[at[r] : at[r + 1]], int(counts[r])) + np.uint64(counts[r]))[0] for r in short], np.uint64)
        rows, items = np.r_[rows, short], np.r_[items, whole]
    order = np.lexsort((items, rows))
    rows, items = rows[order], items[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])
    rows, items = rows[new], items[new]
    return items, np.searchsorted(rows, np.arange(n + 1))


def _sums(items: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, key, items)
    return out


def _placed(items: np.ndarray, offsets: np.ndarray, level: int, which: np.ndarray, band: np.ndarray):
    """Per set its segments; per shingle of those sets its set, its segment (counted through) and a hash."""
    size = (offsets[1:] - offsets[:-1])[which]
    of = np.repeat(np.arange(len(which)), size)
    pick = np.repeat(offsets[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
    x = mix(items[pick] + np.uint64(0x5851F42D4C957F2D * (level + 1) & (1 << 64) - 1))
    m = segments(band, level)
    return m, of, (np.cumsum(m) - m)[of] + ((x >> np.uint64(32)).astype(np.int64) * m[of] >> 32), x


def filled_segments(items: np.ndarray, offsets: np.ndarray, which: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Non-empty level-0 segments of the sets ``which`` in universes ``band``."""
    m, of, key, _ = _placed(items, offsets, 0, which, band)
    held = np.bincount(key, minlength=int(m.sum())) > 0
    return np.bincount(np.repeat(np.arange(len(which)), m)[held], minlength=len(which))


def signatures(items: np.ndarray, offsets: np.ndarray, level: int, which: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, ...]:
    """``set, signature`` pairs of the sets ``which`` in universes ``band``, and each one's filled segments.

    Level 1 also returns each signature's segment; it counts segments of two shingles or more.
    """
    m, of, key, x = _placed(items, offsets, level, which, band)
    tag = mix((band + ((level + 1) << 32)).astype(np.uint64))
    base = np.cumsum(m) - m
    total = int(m.sum())
    held = np.bincount(key, minlength=total)
    part = _sums(mix(x), key, total)
    owner = np.repeat(np.arange(len(which)), m)
    place = mix((np.arange(total) - base[owner]).astype(np.uint64) ^ tag[owner])
    some = np.flatnonzero(held)
    out_set, out = owner[some], mix(part[some] ^ place[some])
    if level == 0:
        return which[out_set], out, np.bincount(out_set, minlength=len(which))
    # Level 1 adds the subset without each one of its shingles.  Subsets of one shingle have no such
    # neighbour, as empty ones are not indexed, and so do not count.
    many = held[key] > 1
    out_set = np.r_[out_set, of[many]]
    out = np.r_[out, mix((part[key] - mix(x))[many] ^ place[key][many])]
    seg = np.r_[some, key[many]] - base[out_set]
    return which[out_set], out, np.bincount(owner[held > 1], minlength=len(which)), seg


# --------------------------------------------------------------------------- first passes


def class_hashes(items: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes of every set."""
    rows = np.repeat(np.arange(len(size)), size)
    c = mix(_sums(mix(items), rows, len(size)) + size.astype(np.uint64))
    return c, mix(_sums(mix(items ^ np.uint64(0xA0761D6478BD642F)), rows, len(size)))


def bitmaps(items: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Per set the parity of its shingles in each of ``2 ** k >= size`` slots (64 at least), packed.

    Two sets differ in at least as many shingles as their bitmaps, folded to one size, have bits.
    """
    size = np.diff(offsets)
    width = np.maximum(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 64)
    base = np.cumsum(width) - width
    rows = np.repeat(np.arange(len(size)), size)
    slot = base[rows] + (mix(items ^ np.uint64(0x8EBC6AF09C88C6E3)) & (width[rows] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(slot, minlength=int(width.sum())) & 1).astype(np.uint8)).tobytes()
    at = (base // 8).tolist()
    return [packed[a : a + w] for a, w in zip(at, (width // 8).tolist(), strict=True)]


#: Longs of a class's fixed sketch: the parity of its shingles in 64 slots each.
SKETCH = 8
_SKETCH = [f"b{i}" for i in range(SKETCH)]
_MEMBERS = "o long, t long, n long, c long, check long, bits binary, f0 long, d0 long, f1 long, d1 long, " + ", ".join(f"{b} long" for b in _SKETCH)


def sketches(items: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Columns of a fixed bitmap, for joins that drop pairs which differ in too many bits."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    slot = (mix(items ^ np.uint64(0x589965CC75374CC3)) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = (np.bincount(rows * (64 * SKETCH) + slot, minlength=n * 64 * SKETCH) & 1).astype(np.uint8)
    packed = np.packbits(odd.reshape(n * SKETCH, 64), axis=1).view(np.int64).reshape(n, SKETCH)
    return [np.ascontiguousarray(packed[:, i]) for i in range(SKETCH)]


def _member_rows(batches):
    """A row per text: its set's size, class and bitmap; and per universe the non-empty segments and most differences."""
    names = ["o", "t", "n", "c", "check", "bits", "f0", "d0", "f1", "d1", *_SKETCH]
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column(2), 1 << 19):
            items, at = shingle_sets(data, offsets)
            size = np.diff(at)
            c, check = class_hashes(items, size)
            left = [np.zeros(len(size), np.int64) for _ in range(4)]
            real = np.flatnonzero(size)
            for u, (which, band) in enumerate(universes(size[real])):
                left[2 * u][real[which]] = filled_segments(items, at, real[which], band)
                left[2 * u + 1][real[which]] = differences(size[real[which]], band)
            take = pa.array(np.arange(first, first + len(size)))
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(size), pa.array(signed(c)), pa.array(signed(check)), pa.array(bitmaps(items, at), pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, [*left, *sketches(items, at)])], names=names)


#: A parcel is what one block of texts sends to one partition: signatures of universe 0, then 1, each
#: in the order of ``classes``, and how many each class has in either (a byte; longer runs are split).
_PARCEL = "part int, sigs binary, classes binary, zeros binary, ones binary"


def _cut(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Bytes of ``rows`` from each cut to the next."""
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    buffers = [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers)


def pack_parcels(sig: np.ndarray, owner: np.ndarray, u: np.ndarray, c: np.ndarray, parts: int) -> pa.RecordBatch:
    """Parcels of one block: signatures ``sig`` of texts ``owner`` (of classes ``c``) in universes ``u``."""
    part = (mix(sig) % np.uint64(parts)).astype(np.int64)
    order = np.argsort((part * 2 + u) * len(c) + owner, kind="stable")
    runs, at = np.unique(part * len(c) + owner, return_inverse=True)
    counts = [np.bincount(at[u == v], minlength=len(runs)) for v in (0, 1)]
    pieces = np.maximum(-(-np.maximum(*counts) // 255), 1)
    of = np.repeat(np.arange(len(runs)), pieces)
    gone = 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    counts = [np.clip(n[of] - gone, 0, 255).astype(np.uint8) for n in counts]
    runs = runs[of]
    full = np.unique(part)
    cuts = np.r_[np.searchsorted(runs, full * len(c)), len(runs)]
    short = sig[order].view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
    columns = [_cut(short, np.r_[np.searchsorted(part[order], full), len(sig)]), _cut(c[runs % max(len(c), 1)], cuts), *[_cut(n, cuts) for n in counts]]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *columns], names=["part", "sigs", "classes", "zeros", "ones"])


def unpack_parcel(sigs: pa.Buffer, classes: pa.Buffer, zeros: pa.Buffer, ones: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``signature, class, universe`` rows of a parcel."""
    short = np.frombuffer(sigs, np.uint8).reshape(-1, SIG_BYTES)
    sig = np.zeros((len(short), 8), np.uint8)
    sig[:, :SIG_BYTES] = short
    c = np.frombuffer(classes, np.int64)
    counts = [np.frombuffer(n, np.uint8) for n in (zeros, ones)]
    u = np.repeat(np.array([0, 1], np.int8), [int(n.sum(dtype=np.int64)) for n in counts])
    return sig.view(np.int64)[:, 0], np.concatenate([np.repeat(c, n) for n in counts]), u


def _parcels(parts: int):
    """Level-0 signatures of texts, packed by the partition they go to."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in text_blocks(batch.column(0), 1 << 19):
                items, at = shingle_sets(data, offsets)
                size = np.diff(at)
                c, _ = class_hashes(items, size)
                real = np.flatnonzero(size)
                found = []
                for v, (which, band) in enumerate(universes(size[real])):
                    owner, sig, _ = signatures(items, at, 0, real[which], band)
                    found.append((sig, owner, np.full(len(sig), v, np.int64)))
                yield pack_parcels(*(np.concatenate(x) for x in zip(*found, strict=True)), c, parts)

    return run


_GROUPS = "members array<long>, c long, s0 long, s1 long"


def _settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order of signature and class, and the size of each row's signature."""
    rows = rows[np.lexsort((rows["c"], rows["s"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["s"][1:] != rows["s"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    rows = rows[new]
    heads = np.flatnonzero(np.r_[True, rows["s"][1:] != rows["s"][:-1]]) if len(rows) else np.empty(0, np.int64)
    size = np.diff(np.r_[heads, len(rows)])
    return rows, np.repeat(size, size)


def _groups(batches):
    """Parcels of one partition to groups: ``members`` (classes that share a signature), or skip counts.

    Signatures of more than ``COMMON`` classes only count, per class, as skipped (``c, s0, s1`` by
    universe).  Holds the partition's rows in one array; past ``HELD_ROWS``, signatures already
    common are counted and let go, so a hot signature never gathers here.
    """
    names = ["members", "c", "s0", "s1"]
    kind = np.dtype([("s", np.int64), ("c", np.int64), ("u", np.int8)])
    held: list[np.ndarray] = []
    count = 0
    limit = HELD_ROWS
    hot = np.empty(0, np.int64)
    skipped: list[np.ndarray] = []

    def skips(parts: list[np.ndarray]):
        rows = np.concatenate(parts) if parts else np.empty(0, kind)
        c, at = np.unique(rows["c"], return_inverse=True)
        counts = [pa.array(np.bincount(at, weights=rows["u"] == u, minlength=len(c)).astype(np.int64)) for u in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.list_(pa.int64())), pa.array(c), *counts], names=names)

    for batch in batches:
        for parcel in zip(*batch.columns[1:], strict=True):
            s, c, u = unpack_parcel(*(x.as_buffer() for x in parcel))
            rows = np.empty(len(s), kind)
            rows["s"], rows["c"], rows["u"] = s, c, u
            if len(hot):
                known = np.isin(rows["s"], hot)
                if known.any():
                    skipped.append(rows[known])
                    rows = rows[~known]
            held.append(rows)
            count += len(rows)
            if count > limit:
                rows, size = _settle(np.concatenate(held))
                big = size > COMMON
                hot = np.union1d(hot, rows["s"][big])
                skipped.append(rows[big])
                held, count = [rows[~big]], int((~big).sum())
                limit = max(HELD_ROWS, 2 * count)
        if sum(map(len, skipped)) > 1 << 20:
            yield skips(skipped)
            skipped = []
    if held:
        rows, size = _settle(np.concatenate(held))
        yield skips([*skipped, rows[size > COMMON]])
        keep = (size > 1) & (size <= COMMON)
        rows, size = rows[keep], size[keep]
        heads = np.flatnonzero(np.r_[True, rows["s"][1:] != rows["s"][:-1]]) if len(rows) else np.empty(0, np.int64)
        ends = np.r_[heads, len(rows)]
        # Near copies share many signatures with the same members: one group of each kind is enough.
        mark = np.add.reduceat(mix(rows["c"].view(np.uint64)), heads) if len(heads) else np.empty(0, np.uint64)
        _, one = np.unique(mark, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rows["c"])).take(pa.array(one)) if len(heads) else pa.array([], pa.list_(pa.int64()))
        for i in range(0, len(lists), 50_000):
            some = lists[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([some, *[pa.nulls(len(some), pa.int64())] * 3], names=names)
        del held, rows, size, lists
        give_back()


# --------------------------------------------------------------------------- verification


def _set_rows(batches):
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column(1), 1 << 19):
            items, at = shingle_sets(data, offsets)
            raw = items.tobytes()
            take = pa.array(np.arange(first, first + len(at) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["c", "items"])


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _plausible(batches):
    """Pairs ``a, b, x, y, n, m`` whose bitmaps allow as few differences as similar sets have."""
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        most = ((batch.column(4).to_numpy(zero_copy_only=False) + batch.column(5).to_numpy(zero_copy_only=False)) // 7).tolist()
        keep = []
        for i in range(len(batch)):
            p, q = np.frombuffer(x[i].as_buffer(), np.uint8), np.frombuffer(y[i].as_buffer(), np.uint8)
            size = min(len(p), len(q))
            if int(np.bitwise_count(_fold(p, size) ^ _fold(q, size)).sum()) <= most[i]:
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def _similar(batches):
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        keep = []
        for i in range(len(batch)):
            a, b = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[at] == a).sum())
            if DEN * both >= NUM * (len(a) + len(b) - both):
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


#: Wanted documents are broadcast up to this many (32 bytes each) to fetch their texts without a shuffle.
BROADCAST_DOCS = 200_000


def _few(df: DataFrame) -> DataFrame:
    """``df`` (written, a few longs a row), to be broadcast if it is counted small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_DOCS else df


def _parts(rows: int) -> int:
    """Files for a table of so many rows: rounds are many and their tables mostly small."""
    return max(12, rows // ROUND_ROWS)


class Sets:
    """Shingle sets of classes, computed from one document's text of each when first wanted."""

    def __init__(self, plain: DataFrame, classes: DataFrame, members: DataFrame):
        self.plain, self.classes, self.members, self.known = plain, classes, members, None

    def fetch(self, wanted: DataFrame) -> DataFrame:
        """``c, items`` of the classes ``wanted (c)`` and of all wanted before."""
        new = wanted.distinct()
        if self.known is not None:
            new = new.join(self.known.select("c"), "c", "left_anti")
        at = self.classes.join(new, "c").select("c", F.col("d.o").alias("_o"), F.col("d.t").alias("_t"))
        at = materialize(at, "wanted")
        if n := at.count():
            same = (F.col("o") == F.col("_o")) & (F.col("t") == F.col("_t"))
            rows = self.plain.join(_few(at), same).select("c", "text").mapInArrow(_set_rows, "c long, items binary")
            if self.members.select("o", "t").join(_few(at.select("_o", "_t")), same).count() > n:  # repeated rows
                rows = rows.dropDuplicates(["c"])
            rows = materialize(rows, "sets")
            discard(rows.sparkSession, at)
            self.known = rows if self.known is None else self.known.unionByName(rows)
        return self.known

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs (a, b)`` whose sets are similar enough: by bitmaps first, then exactly.

        Only the bitmaps and sets of classes that some pair names are moved.
        """
        spark = pairs.sparkSession

        def ends(pairs: DataFrame, of: DataFrame) -> DataFrame:
            nodes = materialize(pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct(), "nodes", parts)
            return of.join(_few(nodes), "c", "left_semi")

        parts = _parts(pairs.count())
        some = ends(pairs, self.classes.select("c", "bits", "n"))
        x = some.select(F.col("c").alias("_a"), F.col("bits").alias("x"), F.col("n"))
        y = some.select(F.col("c").alias("_b"), F.col("bits").alias("y"), F.col("n").alias("m"))
        near = _few(pairs).join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b")).select("a", "b", "x", "y", "n", "m")
        near = materialize(near.mapInArrow(_plausible, "a long, b long"), "plausible", parts)
        if near.isEmpty():
            return near
        sets = self.fetch(near.select(F.col("a").alias("c")).unionByName(near.select(F.col("b").alias("c"))))
        some = ends(near, sets)
        x = some.select(F.col("c").alias("_a"), F.col("items").alias("x"))
        y = some.select(F.col("c").alias("_b"), F.col("items").alias("y"))
        full = _few(near).join(x, F.col("a") == F.col("_a")).join(y, F.col("b") == F.col("_b"))
        links = materialize(full.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"), "links", parts)
        discard(spark, near)
        return links


def _apart(facts: list[str]):
    """Bits in which the sketches of two rows differ."""
    bits = [F.bit_count(F.col(b).bitwiseXOR(F.col(f"_{b}"))) for b in facts]
    return sum(bits[1:], bits[0])


def _near(sets: Sets):
    """Facts of classes, and when two rows of them (the second's with underscores) may be similar."""
    facts = sets.classes.select(F.col("c").alias("_c"), "n", *_SKETCH)
    return facts, (4 * F.least("n", "_n") >= 3 * F.greatest("n", "_n")) & (7 * _apart(_SKETCH) <= F.col("n") + F.col("_n"))


def _new_links(pairs: DataFrame, done: DataFrame | None, sets: Sets, labels: DataFrame | None, links: DataFrame | None):
    """``labels``, ``links`` and the pairs compared, after ``pairs (a, b)`` that sizes and sketches allow.

    Pairs are dealt by ``a``, told apart there and meet the facts of ``a`` in place.
    """
    facts, near = _near(sets)
    pairs = pairs.repartition("a").distinct()
    if done is not None:
        pairs = pairs.join(_few(done), ["a", "b"], "left_anti")
    met = pairs.join(facts, F.col("a") == F.col("_c")).drop("_c")
    other = facts.select(*[F.col(c).alias(f"_{c.lstrip('_')}") for c in facts.columns])
    pairs = materialize(met.join(other, (F.col("b") == F.col("_c")) & near).select("a", "b"), "pairs")
    found = sets.verify(pairs)
    if not found.isEmpty():
        links = found if links is None else links.unionByName(found)
        labels = merge_labels(labels, found, links)
    release(pairs.sparkSession)
    return labels, links, pairs


def _others():
    """``members`` but the first."""
    return F.slice("members", F.lit(2), F.size("members"))


def _connect_stars(once: DataFrame, sets: Sets) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Compare the first class of each group (``members``, at most ``COMMON``) with its others."""
    pairs = once.select(F.col("members")[0].alias("a"), F.explode(_others()).alias("b"))
    return _new_links(pairs, None, sets, None, None)


def _connect_small(groups: DataFrame, sets: Sets, labels: DataFrame | None, links: DataFrame | None, done: DataFrame | None):
    """Compare all classes of each group ``(g, c)`` of at most ``COMMON`` that are not connected yet: ``labels, links``."""
    k = F.col("c").alias("k")
    if labels is not None:
        at = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        groups, k = groups.join(_few(at), F.col("c") == F.col("_n"), "left"), F.coalesce("_l", "c").alias("k")
    whole = groups.select("g", "c", k).groupBy("g").agg(F.collect_list(F.struct("c", "k")).alias("all"), F.min("k").alias("low"), F.max("k").alias("high"))
    whole = materialize(whole.filter("low < high").select(F.array_sort("all").alias("all")).distinct(), "active")
    first = whole.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    pairs = first.filter("x.c < y.c AND x.k != y.k").select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    labels, links, _ = _new_links(pairs, done, sets, labels, links)
    discard(sets.classes.sparkSession, whole)
    return labels, links


def _connect(groups: DataFrame, sets: Sets, labels: DataFrame | None, links: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Verify all links within ``groups (g, c)`` between classes not connected yet.

    Each round some classes of every group that spans two components lead: they are compared with
    all others of other components, then leave the group.  The first round has one leader, a star;
    then a few of the group's largest component meet those outside it, which connects most of them
    at little cost; later leaders come from outside it only.  Pairs whose sizes or
    sketches differ too much never leave the join.  Ends when no group spans two components.
    """
    spark = groups.sparkSession
    facts, near = _near(sets)
    done = None  # pairs compared so far
    turn = 0
    while True:
        parts = _parts(groups.count())
        lead, inside = LEADERS[min(turn, len(LEADERS) - 1)]
        turn += 1
        if labels is None:
            tagged = groups.select("g", "c", F.col("c").alias("k"))
        else:
            tagged = groups.join(labels.select(F.col("node").alias("_n"), F.col("label").alias("_l")), F.col("c") == F.col("_n"), "left").select("g", "c", F.coalesce("_l", "c").alias("k"))
            tagged = materialize(tagged, "tagged", parts)
        spans = tagged.groupBy("g", "k").agg(F.count("*").alias("m")).groupBy(F.col("g").alias("_g")).agg(F.max(F.struct("m", "k"))["k"].alias("base"), F.count("*").alias("spans"))
        active = materialize(tagged.join(spans.filter("spans > 1"), F.col("g") == F.col("_g")).select("g", "c", "k", "base"), "active", parts)
        discard(spark, groups)
        if labels is not None:
            discard(spark, tagged)
        release(spark)
        if active.isEmpty():
            return labels, links
        may = active if inside is None else active.filter("k = base" if inside else "k != base")
        leaders = may.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy("c"))).filter(F.col("_r") <= lead)
        leaders = materialize(leaders.select("g", "c", "k"), "leaders", parts)
        left = _few(leaders).join(facts, F.col("c") == F.col("_c")).select(F.col("g").alias("_g"), F.col("c").alias("_c"), F.col("k").alias("_k"), F.col("n").alias("_n"), *[F.col(b).alias(f"_{b}") for b in _SKETCH])
        right = _few(active.select("g", "c", "k")).join(facts, F.col("c") == F.col("_c")).drop("_c")
        met = right.join(left, (F.col("g") == F.col("_g")) & (F.col("k") != F.col("_k")) & near)
        pairs = met.select(F.least("c", "_c").alias("a"), F.greatest("c", "_c").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs", _parts(active.count() * min(lead, 32)))
        found = sets.verify(pairs)
        done = pairs if done is None else done.unionByName(pairs)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = merge_labels(labels, found, links)
        used = leaders.select(F.col("g").alias("_g"), F.col("c").alias("_c"))
        groups = materialize(active.join(used, (F.col("g") == F.col("_g")) & (F.col("c") == F.col("_c")), "left_anti").select("g", "c"), "groups", parts)
        discard(spark, active)
        release(spark)


# --------------------------------------------------------------------------- the join


def _deletion_rows(batches):
    """Level-1 signatures ``sig, c, u, seg`` of sets ``c, items, u``, with how many segments they can spare."""
    for batch in batches:
        c = batch.column(0).to_numpy(zero_copy_only=False)
        u = batch.column(2).to_numpy(zero_copy_only=False)
        size = np.array([len(v.as_buffer()) // 8 for v in batch.column(1)], np.int64)
        items = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(1)]) if len(batch) else np.empty(0, np.uint64)
        at = np.r_[0, np.cumsum(size)]
        band = np.searchsorted(EDGES, size, side="right") - 1 + u
        owner, sig, filled, seg = signatures(items, at, 1, np.arange(len(size)), band)
        spare = filled - differences(size, band) // 2
        yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(c[owner]), pa.array(u[owner].astype(np.int8)), pa.array(seg.astype(np.int32)), pa.array(spare[owner])], names=["sig", "c", "u", "seg", "spare"])


def _shingle_rows(batches):
    for batch in batches:
        size = np.array([len(v.as_buffer()) // 8 for v in batch.column(1)], np.int64)
        items = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]) if len(batch) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        for i in range(0, len(items), 1 << 16):
            take = pa.array(owner[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(items[i : i + (1 << 16)]), batch.column(0).take(take), pa.array(size[owner[i : i + (1 << 16)]])], names=["g", "c", "n"])


def _by_deletion(unsafe: DataFrame, sets: Sets) -> tuple[DataFrame, DataFrame]:
    """Groups ``g, c`` of the second partition, and the sets it does not make safe either.

    A segment of which any signature is common counts as skipped.
    """
    items = sets.fetch(unsafe.select("c")).join(unsafe.withColumnRenamed("c", "_c"), F.col("c") == F.col("_c")).select("c", "items", "u")
    rows = materialize(items.mapInArrow(_deletion_rows, "sig long, c long, u byte, seg int, spare long"), "deletions")
    per = rows.select("sig", "c").distinct().groupBy(F.col("sig").alias("_s")).agg(F.count("*").alias("m")).filter("m > 1")
    per = materialize(per.select("_s", (F.col("m") > COMMON).alias("common")), "common")
    met = rows.join(per, F.col("sig") == F.col("_s"))
    groups = met.filter("NOT common").select(F.col("sig").alias("g"), "c").distinct()
    gone = met.filter("common").groupBy(F.col("c").alias("_c"), F.col("u").alias("_u")).agg(F.countDistinct("seg").alias("gone"))
    spare = rows.groupBy("c", "u").agg(F.first("spare").alias("spare"))
    left = spare.join(gone, (F.col("c") == F.col("_c")) & (F.col("u") == F.col("_u")), "left")
    return groups, left.filter(F.col("spare") <= F.coalesce("gone", F.lit(0))).select("c").distinct()


def _by_rarest(unsafe: DataFrame, sets: Sets) -> DataFrame:
    """Groups ``g, c`` of sets that share a shingle among the rarest quarter of each.

    Partners share ``ceil(0.75 n)`` shingles at least, so in one order of all shingles the first
    ``n - ceil(0.75 n) + 1`` of both have one in common; rare shingles stand first.
    """
    items = sets.fetch(unsafe).join(unsafe, "c", "left_semi").select("c", "items")
    rows = materialize(items.mapInArrow(_shingle_rows, "g long, c long, n long"), "shingles")
    counts = rows.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("df"))
    order = Window.partitionBy("c").orderBy("df", "g")
    ranked = rows.join(counts, F.col("g") == F.col("_g")).withColumn("_r", F.row_number().over(order))
    return ranked.filter((F.col("_r") <= F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1) & (F.col("df") > 1)).select("g", "c")


def similar_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``(members, labels, links)``.

    ``members``: per document row ``o, t`` (its key, null last, and a hash of its text), ``n``
    shingles and class ``c``; ``labels``: ``node, label`` of linked classes; ``links``: verified
    ``a, b`` between classes, enough of them to connect all that are linked.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("t"), F.col(text).cast("string").alias("text"))
    members = materialize(plain.mapInArrow(_member_rows, _MEMBERS), "members")
    first = [F.first(x).alias(x) for x in ("n", "bits", "f0", "d0", "f1", "d1", *_SKETCH)]
    classes = members.filter("n > 0").groupBy("c").agg(F.min(F.struct("o", "t")).alias("d"), F.min("check").alias("low"), F.max("check").alias("high"), *first)
    classes = materialize(classes, "classes")
    if not classes.filter("low < high").isEmpty():
        raise ValueError("two different sets have one 64-bit class hash; change the hash constants")
    total = classes.agg(F.sum(F.col("f0") + F.col("f1")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_ROWS + 1)
    parcels = plain.filter(F.length("text") > 0).select("text").mapInArrow(_parcels(parts), _PARCEL)
    grouped = materialize(parcels.repartitionById(parts, F.col("part")).mapInArrow(_groups, _GROUPS), "grouped")
    release(spark)

    sets = Sets(plain, classes, members)
    once = materialize(grouped.filter("members IS NOT NULL").select("members").distinct(), "groups")
    labels, links, done = _connect_stars(once, sets)
    rest = once.filter(F.size("members") > 2).select(F.xxhash64("members").alias("g"), F.explode(_others()).alias("c"))
    labels, links = _connect_small(rest, sets, labels, links, done)
    discard(spark, once)

    # Allocation: which sets have too few unskipped segments left?  The others are safe.
    skipped = grouped.filter("c IS NOT NULL").groupBy(F.col("c").alias("_c")).agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    left = classes.join(skipped, F.col("c") == F.col("_c"), "left")
    few = [left.filter(f"d{u} > 0 AND f{u} - coalesce(s{u}, 0) <= d{u}").select("c", F.lit(u).cast("byte").alias("u")) for u in (0, 1)]
    unsafe = materialize(few[0].unionByName(few[1]), "unsafe")
    if not unsafe.isEmpty():
        groups, unsafe = _by_deletion(unsafe, sets)
        unsafe = materialize(unsafe, "unsafe")
        labels, links = _connect_small(groups, sets, labels, links, None)
        if not unsafe.isEmpty():
            labels, links = _connect(materialize(_by_rarest(unsafe, sets), "groups"), sets, labels, links)
    return members, labels, links


def group_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``n_shingles, component_id``.

    ``component_id`` is the smallest key reachable by links, the document itself included.  Null
    and empty texts, and those of white space only, have no shingles and no links.  Repeated rows
    are linked if they have words.  Null keys never name a component unless it has no other.
    Added names that clash with kept columns get a leading underscore.
    """
    keep = docs.columns if keep is None else keep
    members, labels, _ = similar_classes(docs, text, key)
    classes = members.filter("n > 0").groupBy("c").agg(F.min("o").alias("first"))
    if labels is not None:
        named = classes.join(labels.select(F.col("node").alias("_n"), "label"), F.col("c") == F.col("_n"), "left").select("c", "first", F.coalesce("label", "c").alias("label"))
    else:
        named = classes.withColumn("label", F.col("c"))
    roots = named.groupBy(F.col("label").alias("_label")).agg(F.min("first").alias("component"))
    named = materialize(named.join(roots, F.col("label") == F.col("_label")).select(F.col("c").alias("_c"), "component"), "components")
    found = members.join(named, F.col("c") == F.col("_c"), "left").select("o", "t", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("o")).alias("component"))
    component = F.when(F.col("component") != _LAST, F.col("component"))
    out = free_name(docs.select(*keep), "n_shingles", "component_id")
    if keep == [key]:
        return found.select(F.when(F.col("o") != _LAST, F.col("o")).alias(key), F.col("n").alias(out[0]), component.alias(out[1]))
    found = found.groupBy(F.col("o").alias("_o"), F.col("t").alias("_t")).agg(F.first("n").alias("n"), F.first("component").alias("component"))
    rows = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("t"))
    rows = rows.join(found, (F.col("o") == F.col("_o")) & (F.col("t") == F.col("_t")))
    return rows.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)], F.col("n").alias(out[0]), component.alias(out[1]))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of linked rows, that of the smallest key; columns as they were.

    Rows without words are linked with nothing and all stay.  Columns may have any names.
    """
    members, labels, _ = similar_classes(docs, text, key)
    first = F.min(F.struct("o", "t")).alias("d")
    classes = members.filter("n > 0").groupBy("c").agg(first, F.count("*").alias("rows"))
    if labels is not None:
        classes = classes.join(labels.select(F.col("node").alias("_n"), "label"), F.col("c") == F.col("_n"), "left").select("d", F.coalesce("label", "c").alias("label"))
    else:
        classes = classes.select("d", F.col("c").alias("label"))
    kept = classes.groupBy("label").agg(F.min("d").alias("d")).select(F.col("d.o").alias("_o"), F.col("d.t").alias("_t"), F.lit(1).alias("_n"))
    none = members.filter("n = 0").select(F.col("o").alias("_o"), F.col("t").alias("_t"), F.lit(0).alias("_n")).distinct()
    kept = materialize(kept.unionByName(none), "kept")
    ins = [F.col(c).alias(f"in_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*ins, F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("t"))
    rows = rows.join(kept, (F.col("o") == F.col("_o")) & (F.col("t") == F.col("_t")))
    same = members.join(kept.filter("_n = 1"), (F.col("o") == F.col("_o")) & (F.col("t") == F.col("_t"))).groupBy("o", "t").count().filter("count > 1")
    if not same.isEmpty():  # equal rows of one key: the join kept each of them
        rows = rows.filter("_n = 0").unionByName(rows.filter("_n = 1").dropDuplicates(["o", "t"]))
    return rows.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
