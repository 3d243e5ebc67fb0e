"""op4 -- exact removal of repeated byte strings, by suffix sorting with linear grouping.

No single suffix array over the corpus is built.  Every window of ``LENGTH`` bytes holds one anchor
(see ``winnow``), so equal windows meet under their anchor's fingerprint, at equal places around
it.  Only anchors that occur twice are read on:

1. A run of windows under one anchor is a context.  Contexts with equal bytes repeat as a whole.
2. Where a fingerprint has several different contexts, these are cut, aligned at the anchor, into
   blocks; the blocks' ranks form an integer text whose suffixes are sorted by linear grouping
   (``suffixes``).  Neighbours in that order that share the blocks every window must hold are
   compared byte by byte at both ends, which decides each window exactly.
3. A fingerprint with more than ``GROUP`` different contexts is split: windows are dealt to the two
   halves of their possible places, each half's common core joins the key, equal contexts fall
   together again.  Nine halvings reach single windows, so no hot passage gathers in a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, materialize, mix, powers, prefix_hash, release, signed, table, text_blocks
from .suffixes import suffix_array
from .winnow import contexts

LENGTH = 400
GRAM = 100
#: Different contexts of one fingerprint that are sorted together, at most.
GROUP = 2_000
#: Bytes of contexts whose suffixes are sorted at a time.
CHUNK_BYTES = 4 << 20
BLOCK = 16
#: Blocks that every window covers in full.
WHOLE = (LENGTH - BLOCK) // BLOCK
_LAST = (1 << 63) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    prefix = prefix_hash(data)
    _, back = powers(n)
    return mix((prefix[GRAM:] - prefix[:-GRAM]) * back)


def _anchors(batches):
    """``fp, o, t`` for each context of a text."""
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column(2), 1 << 19):
            grams = gram_hashes(data)
            row, _, _, anchor = contexts(grams, offsets, LENGTH, GRAM)
            rows = pa.array(first + row)
            yield pa.RecordBatch.from_arrays([pa.array(signed(grams[anchor])), batch.column(0).take(rows), batch.column(1).take(rows)], names=["fp", "o", "t"])


_CONTEXT = "key long, o long, t long, start long, lo int, hi int, bytes binary"


def _contexts(batches):
    """Contexts of rows ``o, t, text, shared`` under shared fingerprints.

    ``lo`` and ``hi`` are the first and last window's place against the anchor (0 or less),
    ``start`` is the first window's offset in the text.
    """
    names = ["key", "o", "t", "start", "lo", "hi", "bytes"]
    for batch in batches:
        lists = batch.column(3)
        for first, data, offsets in text_blocks(batch.column(2), 1 << 19):
            grams = gram_hashes(data)
            row, lo, hi, anchor = contexts(grams, offsets, LENGTH, GRAM)
            hit = np.zeros(len(row), bool)
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            fp = signed(grams[anchor]) if len(anchor) else np.empty(0, np.int64)
            for r in range(len(offsets) - 1):
                a, b = cuts[r], cuts[r + 1]
                if a < b:
                    hit[a:b] = np.isin(fp[a:b], lists[first + r].values.to_numpy())
            row, lo, hi, anchor, fp = row[hit], lo[hit], hi[hit], anchor[hit], fp[hit]
            raw = data.tobytes()
            pieces = pa.array([raw[a : b + LENGTH] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
            take = pa.array(first + row)
            columns = [pa.array(fp), batch.column(0).take(take), batch.column(1).take(take), pa.array(lo - offsets[row]), pa.array((lo - anchor).astype(np.int32)), pa.array((hi - anchor).astype(np.int32)), pieces]
            for i in range(0, max(len(row), 1), 8192):
                yield pa.RecordBatch.from_arrays([c[i : i + 8192] for c in columns], names=names)


def repeated_windows(keys: list, los: list[int], his: list[int], pieces: list[bytes]) -> list[np.ndarray]:
    """Per context, which of its windows also stands in another context of the same key.

    Contexts of a key are different byte strings, aligned at their anchor (place 0).
    """
    count = len(pieces)
    lo, hi = np.array(los, np.int64), np.array(his, np.int64)
    size = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    base = np.cumsum(size) - size
    _, key = np.unique(np.array(keys, np.int64), return_inverse=True)
    # Full blocks, aligned at the anchor: block j covers places 16 j to 16 j + 15.
    j0 = -(-lo // BLOCK)
    blocks = np.maximum((lo + size) // BLOCK - j0, 0)
    owner = np.repeat(np.arange(count), blocks)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    j = j0[owner] + nth
    at = base[owner] + j * BLOCK - lo[owner]
    halves = np.ascontiguousarray(data[at[:, None] + np.arange(BLOCK)]).view(np.uint64)
    place = key[owner] * np.int64(1 << 12) + (j + (1 << 11))
    order = np.lexsort((halves[:, 1], halves[:, 0], place))
    new = np.ones(len(order), bool)
    p, h = place[order], halves[order]
    new[1:] = (p[1:] != p[:-1]) | (h[1:] != h[:-1]).any(1)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    # The integer text: each context's block ranks, ended by a 0.
    where = np.arange(len(owner)) + owner
    text = np.zeros(len(owner) + count, np.int64)
    text[where] = rank
    left = np.zeros(len(text), np.int64)
    left[where] = blocks[owner] - nth
    of = np.full(len(text), -1, np.int64)
    of[where] = np.arange(len(owner))

    sorted_suffixes = suffix_array(text)
    able = sorted_suffixes[left[sorted_suffixes] >= WHOLE]
    same = np.ones(max(len(able) - 1, 0), bool)
    for d in range(WHOLE):
        same &= text[able[1:] + d] == text[able[:-1] + d]
    group = np.cumsum(np.r_[True, ~same]) if len(able) else np.empty(0, np.int64)
    crowd = np.bincount(group)[group] > 1 if len(able) else np.empty(0, bool)
    member, group = of[able[crowd]], group[crowd]
    out = [np.zeros(n, bool) for n in (hi - lo + 1).tolist()]
    step = 1 << 15  # members at a time share their whole groups below
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    cuts = [0]
    for s in [*starts.tolist(), len(group)]:
        if s - cuts[-1] >= step:
            cuts.append(s)
    if cuts[-1] != len(group):
        cuts.append(len(group))
    flat = np.zeros(int((hi - lo + 1).sum()), bool)
    first_window = np.cumsum(hi - lo + 1) - (hi - lo + 1)
    r = np.arange(BLOCK)
    ends = np.where(np.arange(BLOCK)[None, :] < r[:, None], np.arange(BLOCK)[None, :] - r[:, None], WHOLE * BLOCK + np.arange(BLOCK)[None, :] - r[:, None])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m, g = member[a:b], group[a:b]
        window = j[m][:, None] * BLOCK - r[None, :]
        inside = (window >= lo[owner[m]][:, None]) & (window <= hi[owner[m]][:, None])
        mi, ri = np.nonzero(inside)
        edge = np.ascontiguousarray(data[(at[m][mi])[:, None] + ends[ri]]).view(np.uint64)
        label = g[mi] * BLOCK + ri
        o = np.lexsort((edge[:, 1], edge[:, 0], label))
        eq = (label[o][1:] == label[o][:-1]) & (edge[o][1:] == edge[o][:-1]).all(1)
        twin = np.zeros(len(o), bool)
        twin[1:] |= eq
        twin[:-1] |= eq
        hit = o[twin]
        context = owner[m][mi[hit]]
        flat[first_window[context] + window[mi[hit], ri[hit]] - lo[context]] = True
    return [flat[s : s + len(x)] for s, x in zip(first_window.tolist(), out, strict=True)]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of true values."""
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _sorted_chunks(batches):
    """Contexts sorted by key to spans ``o, t, a, b`` (byte range) of their repeated windows."""
    names = ["o", "t", "a", "b"]
    rows: list[tuple] = []
    weight = 0

    def solve(part):
        masks = repeated_windows([x[0] for x in part], [x[4] for x in part], [x[5] for x in part], [x[6] for x in part])
        out = []
        for x, mask in zip(part, masks, strict=True):
            if x[7]:
                out += [(x[1], x[2], x[3] + s, x[3] + e + LENGTH) for s, e in zip(*map(np.ndarray.tolist, runs(mask)), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if weight >= CHUNK_BYTES and row[0] != rows[-1][0]:
                yield solve(rows)
                rows, weight = [], 0
            rows.append(row)
            weight += len(row[6])
    if rows:
        yield solve(rows)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of hot keys, dealt to the two halves of their places ``ga`` to ``gb``, with longer keys.

    All windows of a half hold the bytes from its last window's start to its first window's end,
    so these bytes join the key.  Rows leave a half that none of their windows is in.
    """
    mid = F.expr("floor((ga + gb) / 2)").cast("int")
    part = F.explode(F.array(F.struct(F.col("ga").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("gb").alias("b"))))
    out = rows.withColumn("_h", part).withColumns({"ga": F.col("_h.a"), "gb": F.col("_h.b")}).filter("lo <= gb AND hi >= ga AND ga <= gb")
    out = out.withColumns({"_f": F.greatest("lo", "ga"), "_e": F.least("hi", "gb")})
    out = out.withColumn("piece", F.expr(f"substring(bytes, _f - lo + 1, _e - _f + {LENGTH})")).withColumn("start", F.col("start") + F.col("_f") - F.col("lo"))
    core = F.expr(f"substring(piece, gb - _f + 1, ga + {LENGTH} - gb)")
    return out.select(F.xxhash64("key", "ga", core).alias("key"), "o", "t", "start", F.col("_f").alias("lo"), F.col("_e").alias("hi"), F.col("piece").alias("bytes"), "wants", "ga", "gb")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``o, t, a, b``: byte ranges covered by repeated windows, from context rows."""
    spark = rows.sparkSession
    rows = rows.withColumns({"wants": F.lit(True), "ga": F.lit(GRAM - LENGTH), "gb": F.lit(0)})
    found = None
    while True:  # once, and once more per halving of what is hot
        # Bytes are read only for contexts that go on; groups are counted on digests.
        digests = [F.xxhash64(F.lit(1), "bytes").alias("d1"), F.xxhash64(F.lit(2), "bytes", F.length("bytes")).alias("d2")]
        rows = materialize(rows.select("*", *digests), "contexts")
        release(spark)
        rep = F.min(F.struct(F.col("o"), F.col("t"), F.col("start"))).alias("rep")
        kinds = rows.groupBy("key", "d1", "d2", "lo").agg(F.count("*").alias("times"), rep)
        kinds = materialize(kinds, "kinds")
        keys = kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select(F.col("key").alias("_key"), "kinds")
        k = kinds.join(keys, F.col("key") == F.col("_key"), "left").select(
            F.col("key").alias("_k"), F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.col("lo").alias("_lo"), "times", "rep", F.coalesce("kinds", F.lit(1)).alias("kinds")
        )
        k = k.filter("times > 1 OR kinds > 1")
        on = (F.col("key") == F.col("_k")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & (F.col("lo") == F.col("_lo"))
        met = rows.join(k, on)
        whole = met.filter("times > 1 AND wants").select("o", "t", F.col("start").alias("a"), (F.col("start") + F.col("hi") - F.col("lo") + LENGTH).alias("b"))
        # One copy of each context is evidence for the others; only single ones still ask.
        first = F.col("rep") == F.struct("o", "t", "start")
        on_ = met.filter(F.col("kinds") > 1).filter(first | (F.col("times") == 1)).withColumn("wants", F.col("wants") & (F.col("times") == 1))
        columns = ["key", "o", "t", "start", "lo", "hi", "bytes", "wants"]
        small = on_.filter(F.col("kinds") <= GROUP).select(columns).repartition("key").sortWithinPartitions("key", "o", "t", "start")
        sorted_ = small.mapInArrow(_sorted_chunks, "o long, t long, a long, b long")
        spans = materialize(whole.unionByName(sorted_), "spans")
        found = spans if found is None else found.unionByName(spans)
        hot = None
        if not keys.filter(F.col("kinds") > GROUP).isEmpty():
            hot = materialize(on_.filter(F.col("kinds") > GROUP).select(*columns, "ga", "gb"), "hot")
        discard(spark, rows)
        discard(spark, kinds)
        release(spark)
        if hot is None:
            return found
        rows = _halves(hot)


def find_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``o, t, spans``: per document its repeated byte ranges, as a list of ``struct<a, b>``."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("t"), F.col(text).cast("string").alias("text"))
    anchors = materialize(plain.filter(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, "fp long, o long, t long"), "anchors")
    shared = anchors.groupBy("fp").count().filter("count > 1").select(F.col("fp").alias("_fp"))
    lists = anchors.distinct().join(shared, F.col("fp") == F.col("_fp")).groupBy(F.col("o").alias("_o"), F.col("t").alias("_t")).agg(F.collect_set("fp").alias("shared"))
    lists = materialize(lists, "lists")
    release(spark)
    rows = plain.join(lists, (F.col("o") == F.col("_o")) & (F.col("t") == F.col("_t"))).select("o", "t", "text", "shared").mapInArrow(_contexts, _CONTEXT)
    spans = repeated_spans(rows)
    return materialize(spans.distinct().groupBy("o", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "repeats")


def _cut(batches, names, keep_bytes: bool):
    for batch in batches:
        texts, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        kept, total, removed, pieces, digests = [], [], [], [], []
        for text, cut in zip(texts, spans, strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            total.append(len(raw))
            if cut.is_valid and len(cut):
                gone = np.zeros(len(raw) + 1, np.int32)
                both = cut.values
                np.add.at(gone, both.field(0).to_numpy(), 1)
                np.add.at(gone, both.field(1).to_numpy(), -1)
                mask = np.cumsum(gone[:-1]) > 0
                pieces.append(len(runs(mask)[0]))
                raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            else:
                pieces.append(0)
            removed.append(total[-1] - len(raw))
            digests.append(hashlib.sha256(raw).hexdigest())
            kept.append(raw if keep_bytes else None)
        made = [pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=names)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, keep_bytes: bool = True) -> DataFrame:
    """``keep`` columns (default: all but the text) with ``kept, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else as well, in the
    same document or another; all strings are judged on the input.  Null texts are empty.  Equal
    rows repeat each other.  ``kept`` is binary, since a cut may fall inside a character, and null
    without ``keep_bytes``.  Added names that clash with kept columns get a leading underscore.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    found = find_repeats(docs, text, key).withColumnsRenamed({"o": "_o", "t": "_t"})
    ins = [F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)]
    rows = docs.select(*ins, F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("t"), F.col(text).cast("string").alias("text"))
    rows = rows.join(found, (F.col("o") == F.col("_o")) & (F.col("t") == F.col("_t")), "left").select(*[f"in_{i}" for i in range(len(keep))], "text", "spans")
    out = free_name(docs.select(*keep), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    kinds = [T.BinaryType(), T.LongType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(n, k) for n, k in zip(out, kinds, strict=True)]])
    return rows.mapInArrow(lambda it: _cut(it, schema.names, keep_bytes), schema)


def op4_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], keep_bytes=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
