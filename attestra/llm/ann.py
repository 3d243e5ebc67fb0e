"""op8 -- approximate nearest neighbours by cosine: a robust-pruned directed graph per shard.

Equal vectors are one point of the graph that lists its smallest ids, so thousands of copies cost
one point.  Points are dealt to shards by hash.  A shard's graph is grown in batches: a greedy beam
search proposes neighbours for each new point, relaxed distance pruning (keep a candidate unless a
kept one is ``ALPHA`` times nearer to it than the point is) leaves a few diverse edges, and
back-edges are pruned the same way.  A last pass prunes all points again over the whole graph.
Every query then beam-searches every shard, in blocks; hits are scored again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, release, table

#: Points of a shard, at most about; a task holds one shard's vectors and edges (10 MB at 64 dimensions).
SHARD_POINTS = 20_000
#: Queries that a task searches for at a time.
QUERY_BLOCK = 2_048
DEGREE = 28
CAPACITY = 44
BEAM = 64
SEARCH_BEAM = 128
ALPHA = 1.2
BATCH = 1_024


class Graph:
    """A directed graph over unit vectors ``x``; ``edges`` has -1 where a point has fewer."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int):
        self.x, self.edges, self.entry = x, edges, entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the ``beam`` best points found for each query, best first; -1 for none."""
        n = len(queries)
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -np.inf, np.float32)
        done = np.ones((n, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.entry, queries @ self.x[self.entry], False
        live = np.arange(n)
        while len(live):
            open_sims = np.where(done[live], -np.inf, sims[live])
            at = open_sims.argmax(1)
            some = open_sims[np.arange(len(live)), at] > -np.inf
            live, at = live[some], at[some]
            if not len(live):
                break
            done[live, at] = True
            near = self.edges[ids[live, at]]
            held = ids[live]
            fresh = (near >= 0) & ~(near[:, :, None] == held[:, None, :]).any(2)
            s = np.einsum("bkd,bd->bk", self.x[near], queries[live])
            s = np.where(fresh, s, -np.inf).astype(np.float32)
            every = np.concatenate([sims[live], s], 1)
            order = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            row = np.arange(len(live))[:, None]
            new_ids = np.concatenate([held, near], 1)[row, order]
            new_sims = every[row, order]
            ids[live] = np.where(new_sims > -np.inf, new_ids, -1)
            sims[live] = new_sims
            done[live] = np.concatenate([done[live], ~fresh], 1)[row, order] | (new_sims == -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        row = np.arange(n)[:, None]
        return ids[row, order], sims[row, order]


def prune(x: np.ndarray, points: np.ndarray, cands: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """Diverse neighbours of ``points`` from candidate ids (rows, -1 for none)."""
    sims = np.einsum("bcd,bd->bc", x[cands], x[points])
    sims = np.where((cands >= 0) & (cands != points[:, None]), sims, -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    row = np.arange(len(points))[:, None]
    cands, sims = cands[row, order], sims[row, order]
    alive = sims > -np.inf
    alive[:, 1:] &= cands[:, 1:] != cands[:, :-1]
    v = x[cands]
    between = 1 - np.matmul(v, v.transpose(0, 2, 1))
    apart = 1 - np.where(np.isfinite(sims), sims, -1)
    out = np.full((len(points), degree), -1, np.int32)
    r = np.arange(len(points))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        out[some, k] = cands[r, pick][some]
        alive &= (alpha * alpha) * between[r, pick] > apart
        alive[r, pick] = False
    return out


def build_graph(x: np.ndarray, seed: int = 1) -> Graph:
    """Grow the graph over unit vectors ``x``; every point can be reached from the entry."""
    n = len(x)
    edges = np.full((n, CAPACITY), -1, np.int32)
    count = np.zeros(n, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    first = order[: min(n, 256)]
    mean = x.mean(0)
    graph = Graph(x, edges, int(first[(x[first] @ mean).argmax()]))

    def put(points: np.ndarray, near: np.ndarray) -> None:
        edges[points] = -1
        edges[points, : near.shape[1]] = near
        count[points] = (near >= 0).sum(1)

    def connect(points: np.ndarray, cands: np.ndarray) -> None:
        near = prune(x, points, cands, DEGREE)
        put(points, near)
        to, new = near.ravel(), np.repeat(points, near.shape[1]).astype(np.int32)
        new, to = new[to >= 0], to[to >= 0]
        known = (edges[to] == new[:, None]).any(1)
        new, to = new[~known], to[~known]
        by = np.argsort(to, kind="stable")
        new, to = new[by], to[by]
        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, int)
        size = np.diff(np.r_[heads, len(to)])
        fits = count[to[heads]] + size <= CAPACITY
        rank = np.arange(len(to)) - np.repeat(heads, size)
        easy = np.repeat(fits, size)
        edges[to[easy], count[to[easy]] + rank[easy]] = new[easy]
        count[to[heads[fits]]] += size[fits]
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), 256):
            part = full[i : i + 256]
            owners = to[heads[part]]
            pool = np.full((len(part), CAPACITY + min(int(size[part].max()), 96)), -1, np.int32)
            pool[:, :CAPACITY] = edges[owners]
            for j, h in enumerate(part):
                newest = new[heads[h] : heads[h] + size[h]]
                if len(newest) > 96:  # the nearest of very many; the others keep their own edge to it
                    newest = newest[np.argpartition(-(x[newest] @ x[owners[j]]), 95)[:96]]
                pool[j, CAPACITY : CAPACITY + len(newest)] = newest
            put(owners, prune(x, owners, pool, DEGREE))

    exact = x[first] @ x[first].T
    best = np.argsort(-exact, axis=1, kind="stable")[:, : BEAM + 1]
    connect(first, first[best].astype(np.int32))
    at = len(first)
    while at < n:
        batch = order[at : at + min(BATCH, max(at // 2, 64))]
        connect(batch, graph.search(x[batch], BEAM)[0])
        at += len(batch)
    if n > 256:
        for i in range(0, n, BATCH):
            batch = order[i : i + BATCH]
            connect(batch, np.concatenate([graph.search(x[batch], BEAM)[0], edges[batch]], 1))
    _join_up(graph)
    return graph


def _join_up(graph: Graph) -> None:
    """Give every point that cannot be reached an edge from the nearest point that can."""
    n = len(graph.x)
    while True:
        seen = np.zeros(n, bool)
        front = np.array([graph.entry])
        seen[front] = True
        while len(front):
            nxt = np.unique(graph.edges[front])
            front = nxt[(nxt >= 0)][~seen[nxt[nxt >= 0]]]
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return
        spare = graph.edges.shape[1] - 1
        for p in lost[:256]:
            for host in graph.search(graph.x[p : p + 1], BEAM)[0][0]:
                free = np.flatnonzero(graph.edges[host] < 0) if host >= 0 else []
                if len(free):
                    graph.edges[host, free[0]] = p
                    break
            else:
                graph.edges = np.concatenate([graph.edges, np.full((n, 1), -1, np.int32)], 1)
                graph.edges[graph.entry, spare + 1] = p


# --------------------------------------------------------------------------- Spark side


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(-1, dim)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither vanish nor overflow; cosines stay as they are, to the last bit."""
    _, exponent = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    return np.ldexp(v, -exponent[:, None])


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _build(table: pa.Table) -> pa.Table:
    """One shard's rows ``shard, id, vector`` to one row of blobs."""
    table = table.combine_chunks().sort_by("id")
    column = table["vector"].combine_chunks()
    dim = len(column[0])
    v = _scaled(_matrix(column, dim, np.float64))
    graph = build_graph(_unit(v))
    ids = table["id"].to_numpy()
    row = [table["shard"][0].as_py(), len(ids), dim, graph.entry, graph.edges.shape[1], ids.astype(np.int64).tobytes(), v.tobytes(), graph.edges.tobytes()]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=_GRAPH.replace(" long", "").replace(" binary", "").split(", "))


_GRAPH = "shard long, n long, dim long, entry long, width long, ids binary, vectors binary, edges binary"


def _pack(table: pa.Table) -> pa.Table:
    """One block of queries ``block, dim, id, vector`` to one row of blobs."""
    table = table.combine_chunks().sort_by("id")
    dim = table["dim"][0].as_py()
    v = _scaled(_matrix(table["vector"].combine_chunks(), dim, np.float64))
    return pa.table({"block": table["block"].slice(0, 1), "dim": table["dim"].slice(0, 1), "query_ids": pa.array([table["id"].to_numpy().astype(np.int64).tobytes()]), "queries": pa.array([v.tobytes()])})


def _search(k: int, beam: int):
    """Searches shards one after the other: a shard's graph comes first, then its blocks of queries."""

    def run(batches):
        shard = None
        for batch in batches:
            for r in range(len(batch)):
                get = lambda name: batch.column(name)[r]  # noqa: E731, B023
                if get("ids").is_valid:
                    shard, dim, n = get("shard").as_py(), get("dim").as_py(), get("n").as_py()
                    ids = np.frombuffer(get("ids").as_buffer(), np.int64)
                    v = np.frombuffer(get("vectors").as_buffer(), np.float64).reshape(n, dim)
                    edges = np.frombuffer(get("edges").as_buffer(), np.int32).reshape(n, get("width").as_py())
                    graph = Graph(_unit(v), edges, get("entry").as_py())
                    norms = np.linalg.norm(v, axis=1)
                    continue
                if get("shard").as_py() != shard:  # no points of this length and shard
                    continue
                query_ids = np.frombuffer(get("query_ids").as_buffer(), np.int64)
                q = np.frombuffer(get("queries").as_buffer(), np.float64).reshape(-1, dim)
                for i in range(0, len(q), 512):
                    part = q[i : i + 512]
                    found, _ = graph.search(_unit(part), beam)
                    found = found[:, : max(4 * k, 32)]
                    dots = np.einsum("bkd,bd->bk", v[found], part)
                    score = dots / (norms[found] * np.linalg.norm(part, axis=1)[:, None])
                    score = np.where(found >= 0, score, -np.inf)
                    order = np.lexsort((ids[found], -score), axis=1)[:, :k]
                    row = np.arange(len(part))[:, None]
                    found, score = found[row, order], score[row, order]
                    ok = found.ravel() >= 0
                    owner = np.repeat(query_ids[i : i + 512], found.shape[1])[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids[found.ravel()[ok]]), pa.array(score.ravel()[ok])], names=["query", "id", "score"])

    return run


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, not zero."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda c: c != 0)


def nearest(vectors: DataFrame, k: int, is_query: Column, key: str = "vec_id", vector: str = "embedding", shard_points: int = SHARD_POINTS, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, <key>, score``: the ``k`` nearest rows found for each query row, itself excluded.

    Rows with a null key or an unusable vector take no part.  Only vectors of equal length are
    compared.  Rows that share the query's key never are its neighbours.  Ties go to the smaller
    key.  An empty table gives an empty result.  Added names that clash with the key's get a leading underscore.
    """
    spark = vectors.sparkSession
    out = free_name(vectors.select(key), "query_id", "rank", "score")
    good = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("q")
    )
    # A copy group keeps its k + 1 smallest ids; the limit is applied before the shuffle as well.
    some = Window.partitionBy("vector").orderBy("id")
    copies = good.select("id", "vector").distinct().withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= k + 1)
    points = copies.groupBy("vector").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("id")).alias("members"))
    points = materialize(points, "ann-points")
    total = points.count()
    shards = max(1, -(-total // shard_points))
    dealt = points.select((F.size("vector") * F.lit(1 << 32) + F.pmod(F.xxhash64("vector"), F.lit(shards))).cast("long").alias("shard"), "id", "vector")
    graphs = materialize(dealt.groupBy("shard").applyInArrow(_build, _GRAPH), "ann-graphs")

    # Each distinct query vector is searched once.
    queries = good.filter("q").select(F.col("id").alias("query_id"), "vector").distinct()
    owners = points.select(F.col("id").alias("point"), F.col("vector").alias("_v"))
    queries = materialize(queries.join(owners, F.col("vector") == F.col("_v")).select("query_id", "point"), "ann-queries")
    distinct = points.join(queries.select(F.col("point").alias("_p")).distinct(), F.col("id") == F.col("_p"), "left_semi")
    blocks = max(1, -(-queries.select("point").distinct().count() // QUERY_BLOCK))
    packed = distinct.select((F.size("vector") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.lit(blocks))).cast("long").alias("block"), F.size("vector").cast("long").alias("dim"), "id", "vector")
    packed = materialize(packed.groupBy("block").applyInArrow(_pack, "block long, dim long, query_ids binary, queries binary"), "ann-blocks")
    # A stated set of queries against all shards, block by block.  Graphs and blocks are dealt by shard, not joined: a join
    # could broadcast either through the driver, and would repeat a graph for each block.
    wanted = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("dim") * F.lit(1 << 32) + F.col("shard"))
    meet = graphs.withColumn("block", F.lit(-1).cast("long")).unionByName(wanted.drop("dim"), allowMissingColumns=True)
    meet = meet.repartition("shard").sortWithinPartitions("shard", "block")
    hits = materialize(meet.mapInArrow(_search(k + 1, beam), "query long, id long, score double"), "ann-hits")
    release(spark)

    # Merge the shards' best points, then name the points' members, best first.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    top = hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    members = points.select(F.col("id").alias("_i"), "members")
    named = top.join(members, F.col("id") == F.col("_i")).select("query", "score", F.explode("members").alias("member"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("member").alias("m")))), 1, k + 1)
    lists = named.groupBy("query").agg(ranked.alias("near"))
    mine = queries.join(lists, F.col("point") == F.col("query"))
    others = F.slice(F.filter("near", lambda e: e["m"] != F.col("query_id")), 1, k)
    flat = mine.select("query_id", F.posexplode(others).alias("at", "e"))
    return flat.select(F.col("query_id").alias(out[0]), (F.col("at") + 1).cast("int").alias(out[1]), F.col("e.m").alias(key), (-F.col("e.s")).alias(out[2]))


def op8_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, 5, F.col("vec_id") % 50 == 0)
