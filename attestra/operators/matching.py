"""Entity matching: blocked pairs, scored and cut to the best per left row, and the conflicts they show."""

from __future__ import annotations

import functools
import heapq
import math
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N

SEED_FIELDS = ("place_id", "name", "canonical_name", "address", "city", "region", "phone", "website", "category", "source_dataset")
MATCH_ATTRIBUTES = ("name", "phone", "website", "address", "category")
THRESHOLD = 0.72
CANDIDATES = 25
#: Rows of either side in a cell.
CHUNK = 4_000


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two normal texts; blank texts are similar to nothing.  No native form exists."""
    if not a or not b:
        return 0.0
    if len(b) >= 200:  # the library leaves out frequent letters of long texts
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matched(a, b) / (len(a) + len(b))


@functools.lru_cache(1 << 16)
def _matched(a: str, b: str) -> int:
    """Letters in the longest common run (the first in ``a``, then in ``b``) and, on, in what is left and right of it."""
    size = at = i = 0
    while i + size < len(a):
        if a[i : i + size + 1] in b:
            size, at = size + 1, i
        else:
            i += 1
    if not size:
        return 0
    j = b.find(a[at : at + size])
    left = _matched(a[:at], b[:j]) if at and j else 0
    i, j = at + size, j + size
    return size + left + (_matched(a[i:], b[j:]) if i < len(a) and j < len(b) else 0)


def _round4(x: float) -> float:
    """``round(x, 4)`` as Spark has it: half up, on the decimal form."""
    y = x * 1e4
    down = math.floor(y)
    if abs(y - down - 0.5) > 1e-6:
        return (down + (y - down > 0.5)) / 1e4
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def _best_of(candidates: int):
    """Of two chunks, the pairs that are among the best ``candidates`` of their left row within them.

    Everything but the name is compared at once for all right rows.  Letters that two names share bound
    their similarity, so right rows are tried in order of the score they can reach, until none can enter.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = len(right)
        text = lambda t, c: t[c].to_pylist()
        equal = {}
        for c, x in (("m_city", 0.15), ("m_region", 0.10), ("m_phone", 0.20), ("m_site", 0.20)):
            codes = {"": -1}
            r = np.array([codes.setdefault(v, len(codes)) for v in text(right, f"r_{c}")], np.int64)
            equal[c] = r, np.array([codes.get(v, -2) if v else -2 for v in text(left, f"l_{c}")], np.int64), x
        streets = {v: i for i, v in enumerate(dict.fromkeys(text(right, "r_m_address")))}
        street = np.array([streets[v] for v in text(right, "r_m_address")], np.int64)
        names, mine = text(right, "r_m_name"), text(left, "l_m_name")
        letters = {c: i for i, c in enumerate(sorted(set("".join(names))))}
        counts = np.zeros((len(letters), n), np.uint16)
        for j, name in enumerate(names):
            for c in name:
                counts[letters[c], j] += 1
        sizes = np.array([len(x) for x in names], np.int64)
        place = np.empty(n, np.int64)
        ids = text(right, "r_place_id")
        place[sorted(range(n), key=lambda j: ids[j] or "")] = np.arange(n)
        known: dict[str, np.ndarray] = {}
        out: list[tuple[int, int, float, float]] = []
        for i, (name, where) in enumerate(zip(mine, text(left, "l_m_address"), strict=True)):
            if where not in known:
                known[where] = np.array([similarity(where, v) for v in streets])
            near = known[where][street]
            marks = [np.where(r == l[i], x, 0.0) for r, l, x in equal.values()]
            shared = np.zeros(n, np.int64)
            for c in set(name) & letters.keys():
                shared += np.minimum(counts[letters[c]], name.count(c))
            reach = np.where(sizes > 0, 2.0 * shared / (sizes + len(name)), 0.0) if name else np.zeros(n)
            most = np.minimum(0.45 * reach + sum(marks) + 0.10 * near, 1.0)
            kept: list[tuple[float, int, int, float]] = []
            for j in np.argsort(-most, kind="stable").tolist():
                full = len(kept) >= candidates
                if full and most[j] + 1e-4 < kept[0][0]:
                    break
                raw = similarity(name, names[j])
                score = 0.45 * raw
                for m in marks:
                    score += float(m[j])
                entry = (_round4(min(score + 0.10 * float(near[j]), 1.0)), -int(place[j]), j, raw)
                if not full:
                    heapq.heappush(kept, entry)
                elif entry > kept[0]:
                    heapq.heapreplace(kept, entry)
            out += [(i, j, raw, float(near[j])) for _, _, j, raw in kept]
        i, j, raw, near = zip(*out, strict=True) if out else ((),) * 4
        a, b = left.drop(_CELL).take(pa.array(i, pa.int64())), right.drop(_CELL).take(pa.array(j, pa.int64()))
        return pa.table([*a.columns, *b.columns, pa.array(raw, pa.float64()), pa.array(near, pa.float64())], names=[*a.column_names, *b.column_names, "name_raw", "address_raw"])

    return run


_CELL = ["_b", "_i", "_j"]


def _cells(l: DataFrame, r: DataFrame, candidates: int) -> DataFrame:  # noqa: E741
    """Pairs of rows with one ``_b``, the best of each left row in each cell of ``CHUNK`` rows a side."""
    count = lambda df, name: df.groupBy("_b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    sizes = count(l, "_nl").join(count(r, "_nr"), "_b")
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = l.join(sizes, "_b").select(*l.columns, part(l, "_nl").alias("_i"), every("_nr").alias("_j"))
    right = r.join(sizes, "_b").select(*r.columns, every("_nl").alias("_i"), part(r, "_nr").alias("_j"))
    schema = T.StructType([f for f in [*l.schema, *r.schema] if f.name != "_b"] + [T.StructField(c, T.DoubleType()) for c in ("name_raw", "address_raw")])
    return left.groupBy(*_CELL).cogroup(right.groupBy(*_CELL)).applyInArrow(_best_of(candidates), schema)


def match_places(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, candidates: int = CANDIDATES) -> DataFrame:
    """Likely pairs of seeds, at most ``candidates`` considered per left row.

    Rows meet within their region; left rows whose region no right row has are compared with all.
    Large blocks are cut into cells of bounded size; a cell keeps each left row's best, and a window
    takes the best of all cells.
    """
    def prepared(df: DataFrame, tag: str) -> DataFrame:
        have = set(df.columns)
        c = {f: N.text(F.col(f)) if f in have else F.lit("") for f in SEED_FIELDS}
        best = F.when(c["canonical_name"] != "", c["canonical_name"]).otherwise(c["name"])
        region = N.match_text(c["region"])
        made = {f: c[f] for f in SEED_FIELDS} | {
            "m_name": N.match_text(best), "m_address": N.match_text(c["address"]), "m_city": N.match_text(c["city"]), "m_region": region, "m_phone": N.match_phone(c["phone"]),
            "m_site": N.url_host(c["website"]), "block": F.when(region == "", "__unknown__").otherwise(region),
        }
        return df.select(*[v.alias(f"{tag}{k}") for k, v in made.items()])

    l, r = prepared(left, "l_"), prepared(right, "r_")  # noqa: E741
    blocks = r.select(F.col("r_block").alias("_b")).distinct()
    met = _cells(l.withColumn("_b", F.col("l_block")), r.withColumn("_b", F.col("r_block")), candidates)
    lonely = l.join(blocks, F.col("l_block") == F.col("_b"), "left_anti").withColumn("_b", F.lit(""))
    if not lonely.isEmpty():
        met = met.unionByName(_cells(lonely, r.withColumn("_b", F.lit("")), candidates))
    equal = lambda a: (F.col(f"l_{a}") != "") & (F.col(f"l_{a}") == F.col(f"r_{a}"))
    met = met.withColumns({"same_city": equal("m_city"), "same_region": equal("m_region"), "phone_match": equal("m_phone"), "website_domain_match": equal("m_site")})
    add = lambda c, x: F.when(F.col(c), x).otherwise(0.0)
    score = 0.45 * F.col("name_raw") + add("same_city", 0.15) + add("same_region", 0.10) + add("phone_match", 0.20) + add("website_domain_match", 0.20) + 0.10 * F.col("address_raw")
    met = met.withColumn("match_score", F.round(F.least(score, F.lit(1.0)), 4)).withColumn("name_similarity", F.round("name_raw", 4))
    best = Window.partitionBy("l_place_id").orderBy(F.desc("match_score"), "r_place_id")
    top = met.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= candidates)
    linked = F.col("phone_match") | F.col("website_domain_match")
    likely = F.when(linked, F.col("name_similarity") >= 0.55).otherwise((F.col("match_score") >= threshold) & F.col("same_region"))
    return top.filter(likely).withColumn("pair_id", F.concat_ws("__", "l_place_id", "r_place_id")).drop("_r", "name_raw", "address_raw")


def pair_rows(matched: DataFrame) -> DataFrame:
    return matched.select(
        "pair_id", F.col("l_place_id").alias("left_place_id"), F.col("r_place_id").alias("right_place_id"), F.col("l_source_dataset").alias("left_source"), F.col("r_source_dataset").alias("right_source"),
        "match_score", "name_similarity", "same_city", "same_region", "phone_match", "website_domain_match",
    )


def conflict_rows(matched: DataFrame) -> DataFrame:
    """Attributes on which a pair's two sides disagree; blank values never do."""
    forms = {"phone": N.match_phone, "website": lambda c: N.url_host(N.strip(c))}
    each = []
    for a in MATCH_ATTRIBUTES:
        l, r = N.strip(F.col(f"l_{a}")), N.strip(F.col(f"r_{a}"))  # noqa: E741
        form = forms.get(a, N.match_text)
        differ = (l != "") & (r != "") & (form(l) != form(r))
        each.append(F.when(differ, F.struct(F.lit(a).alias("attribute"), l.alias("left_value"), r.alias("right_value"))))
    rows = matched.select("*", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    return rows.select("pair_id", F.col("l_place_id").alias("place_id"), "x.attribute", F.col("l_source_dataset").alias("left_source"), F.col("r_source_dataset").alias("right_source"), "x.left_value", "x.right_value", "match_score")


def candidate_rows(seeds: DataFrame) -> DataFrame:
    """Seeds to one row per non-blank attribute value."""
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), N.strip(N.text(F.col(a))).alias("candidate_value")) for a in MATCH_ATTRIBUTES])
    return seeds.select("place_id", F.explode(each).alias("x")).select("place_id", "x.*").filter("candidate_value != ''")
