"""Approximate nearest neighbours: a navigable small-world hierarchy per shard, results merged.

* **Equal vectors** (cosine similarity, so after scaling to unit length) are one node, named by their
  smallest id; a node keeps its k+1 smallest ids, which are all that an answer can hold of it.
* **Shards.** Centroids, fitted by spherical k-means on the ``ROUTE_SAMPLE`` nodes of smallest hash, place
  every node in a cell of about half of ``SHARD``; there are at most ``CELLS`` cells, and a cell of more
  than ``SHARD`` nodes is dealt out to several shards. Each shard builds a hierarchical navigable
  small-world graph, held as one flat neighbour array a level, stored as one row of a table in the shared
  folder. Every node is in exactly one graph.
* **Queries** are the vectors whose id is divisible by ``every``, one in a hundred. Each visits all shards
  of its ``probes`` nearest cells, in blocks of queries, and the best of them are merged. By default it
  visits every cell: where vectors lie in all directions, near ones are in any cell, and recall falls with
  the share of cells left out. For clustered vectors a number of probes keeps the work of a query the same
  as the table grows. Work for building grows as the table, for visiting every cell as its square times
  1 / (100 * SHARD).

Search and construction move many queries in lockstep: a step expands the best unexpanded candidates
of each query, so the cost of Python is spread over a block. Insertion is in rounds that at most double
the graph; a node links to a diverse choice of its candidates (a candidate nearer to a chosen neighbour
than to the node is passed over while others remain), and full neighbour lists keep their nearest.

Defined cases: null ids, null or empty vectors and vectors with a null, NaN or infinite element take no
part, nor do vectors of another length than the most frequent one (of equally frequent lengths, the
smallest); a repeated id is one vector, the smallest; a zero vector has similarity 0 to all; of the
neighbours found, equal similarities go to the smaller id, and copies of a vector are ordered by id
exactly; very long vectors are held whole; fewer than k others give fewer rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millstone.llm import textcore as tc

NEIGHBOURS = 10
QUERY_EVERY = 100  # queries are the ids divisible by it
SHARD = 8192
CELLS = 1024
ROUTE_SAMPLE = 16_384
BLOCK = 4096
LINKS = 16
EF_BUILD = 64
EF_SEARCH = 96
EXPAND = 4
BEAM = 32  # nodes that upper levels hand down, so that groups of copies far from each other stay within reach
LOCKSTEP = 512


@dataclass
class Graph:
    ids: np.ndarray
    vectors: np.ndarray
    levels: list[np.ndarray]  # level -> (nodes of all levels, links), -1 where empty
    entry: int


def _search(g: Graph, level: int, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the ef best found for each query on one level, best first; -1 where none."""
    links, n, rows = g.levels[level], len(g.vectors), len(q)
    seen = np.zeros((rows, n), bool)
    at = np.arange(rows)
    ids = np.full((rows, ef), -1)
    sim = np.full((rows, ef), -np.inf, np.float32)
    m = min(start.shape[1], ef)
    ids[:, :m] = start[:, :m]
    valid = ids >= 0
    sim[:, :m] = np.where(valid[:, :m], np.einsum("qd,qkd->qk", q, g.vectors[np.maximum(ids[:, :m], 0)]), -np.inf)
    r, c = np.nonzero(valid)
    seen[r, ids[r, c]] = True
    done = ~valid
    live = at
    while len(live):
        open_ = np.where(done[live], -np.inf, sim[live])
        pick = np.argsort(-open_, axis=1, kind="stable")[:, :EXPAND]
        ok = np.take_along_axis(open_, pick, 1) > -np.inf
        keep = ok.any(1)
        live, pick, ok = live[keep], pick[keep], ok[keep]
        if not len(live):
            break
        done[live[:, None], pick] = True
        node = np.where(ok, ids[live[:, None], pick], -1)
        near = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(live), -1)
        safe = np.maximum(near, 0)
        fresh = (near >= 0) & ~seen[live[:, None], safe]
        # one node reached over two of the expanded ones counts once
        order = np.argsort(np.where(fresh, near, n), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        fresh = np.take_along_axis(fresh, order, 1)
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        safe = np.maximum(near, 0)
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("nd,nd->n", q[live[r]], g.vectors[near[r, c]])
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_sim = np.concatenate([sim[live], s], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        top = np.argsort(-all_sim, axis=1, kind="stable")[:, :ef]
        ids[live], sim[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sim, all_done))
    return ids, sim


def _diverse(g: Graph, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """(rows, m) choice among candidates given best first; passed-over ones fill what is left."""
    rows, n = ids.shape
    v = g.vectors[np.maximum(ids, 0)]
    chosen = np.zeros((rows, n), bool)
    best = np.full((rows, n), -np.inf, np.float32)  # similarity of each candidate to the nearest chosen one
    for j in range(n):
        take = (ids[:, j] >= 0) & (chosen.sum(1) < m) & (best[:, j] < sim[:, j])
        chosen[:, j] = take
        t = np.flatnonzero(take)
        if len(t) and j + 1 < n:
            best[t, j + 1 :] = np.maximum(best[t, j + 1 :], np.einsum("td,tkd->tk", v[t, j], v[t, j + 1 :]))
    rank = np.where(ids < 0, 3 * n, np.where(chosen, 0, n) + np.arange(n)[None, :])
    order = np.argsort(rank, axis=1, kind="stable")[:, :m]
    return np.take_along_axis(ids, order, 1)


def _link(g: Graph, level: int, new: np.ndarray, near: np.ndarray) -> None:
    """Connect new nodes with the given neighbours, both ways; full lists keep their nearest."""
    links = g.levels[level]
    width = links.shape[1]
    src = np.repeat(new, near.shape[1])
    dst = near.ravel()
    ok = (dst >= 0) & (dst != src)
    src, dst = src[ok], dst[ok]
    touched = np.unique(np.concatenate([src, dst]))
    old = links[touched]
    o_src, o_dst = np.repeat(touched, width), old.ravel()
    a = np.concatenate([o_src[o_dst >= 0], src, dst])
    b = np.concatenate([o_dst[o_dst >= 0], dst, src])
    pair = np.unique(a * len(g.vectors) + b)
    a, b = pair // len(g.vectors), pair % len(g.vectors)
    s = np.einsum("nd,nd->n", g.vectors[a], g.vectors[b])
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    wide = min(int(rank.max()) + 1, 4 * width) if len(a) else 1
    inside = rank < wide
    ids = np.full((len(touched), wide), -1)
    sim = np.full((len(touched), wide), -np.inf, np.float32)
    at = np.searchsorted(touched, a[inside])
    ids[at, rank[inside]], sim[at, rank[inside]] = b[inside], s[inside]
    if wide > width:
        full = (ids >= 0).sum(1) > width
        out = ids[:, :width].copy()
        f = np.flatnonzero(full)
        for lo in range(0, len(f), LOCKSTEP):
            out[f[lo : lo + LOCKSTEP]] = _diverse(g, ids[f[lo : lo + LOCKSTEP]], sim[f[lo : lo + LOCKSTEP]], width)
        ids = out
    links[touched] = -1
    links[touched, : ids.shape[1]] = ids


def build(ids: np.ndarray, vectors: np.ndarray, m: int = LINKS) -> Graph:
    """Graph over unit (or zero) vectors; deterministic, whatever the order of the rows."""
    order = np.argsort(tc.mix(ids.astype(np.int64).view(np.uint64)), kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order], dtype=np.float32)
    n = len(ids)
    draw = (tc.mix(ids.view(np.uint64) ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(float) / 2.0**53
    level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int), 8)
    if n:
        level[0] = level.max()  # the entry point is the first node and reaches all levels
    g = Graph(ids, vectors, [np.full((n, 2 * m if i == 0 else m), -1, np.int64) for i in range(int(level.max()) + 1 if n else 1)], 0)
    done = 1
    while done < n:
        new = np.arange(done, min(n, done + max(1, min(done, LOCKSTEP))))
        q = vectors[new]
        start = np.zeros((len(new), 1), np.int64)
        within = q @ q.T
        for lv in range(len(g.levels) - 1, -1, -1):
            here = level[new] >= lv
            ef = EF_BUILD if here.any() else BEAM
            found, sim = _search(g, lv, q, start, ef)
            at = np.flatnonzero(here)
            if len(at):
                # nodes of the same round are candidates of each other
                mates = np.where(np.eye(len(at), dtype=bool), -np.inf, within[np.ix_(at, at)]).astype(np.float32)
                extra = min(len(at), EF_BUILD)
                top = np.argsort(-mates, axis=1, kind="stable")[:, :extra]
                c_sim = np.concatenate([sim[at], np.take_along_axis(mates, top, 1)], 1)
                c_ids = np.concatenate([found[at], np.where(np.take_along_axis(mates, top, 1) > -np.inf, new[at][top], -1)], 1)
                best = np.argsort(-c_sim, axis=1, kind="stable")[:, :EF_BUILD]
                _link(g, lv, new[at], _diverse(g, np.take_along_axis(c_ids, best, 1), np.take_along_axis(c_sim, best, 1), m))
            start = found[:, :BEAM]
        done = int(new[-1]) + 1
    return g


def stray(g: Graph) -> np.ndarray:
    """The first node of each part of the lowest level that the entry point and the parts before don't reach."""
    links, seen, found, start = g.levels[0], np.zeros(len(g.ids), bool), [], 0
    while True:
        seen[start] = True
        edge = np.array([start])
        while len(edge):
            near = links[edge].ravel()
            edge = np.unique(near[(near >= 0) & ~seen[near]])
            seen[edge] = True
        rest = np.flatnonzero(~seen)
        if not len(rest):
            return np.array(found, np.int64)
        start = int(rest[0])
        found.append(start)


def query(g: Graph, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the k nearest found for each query; -1 and -inf where there are fewer."""
    ids, sims = np.full((len(q), k), -1), np.full((len(q), k), -np.inf, np.float32)
    if not len(g.ids):
        return ids, sims
    seeds = stray(g)
    for lo in range(0, len(q), LOCKSTEP):
        part = q[lo : lo + LOCKSTEP]
        start = np.zeros((len(part), 1), np.int64)
        for lv in range(len(g.levels) - 1, 0, -1):
            start = _search(g, lv, part, start, BEAM)[0]
        if len(seeds):
            best = seeds[np.argsort(-(part @ g.vectors[seeds].T), axis=1, kind="stable")[:, :BEAM]]
            known = (best[:, :, None] == start[:, None, :]).any(2)
            start = np.concatenate([np.where(known, -1, best), start], 1)
        found, sim = _search(g, 0, part, start, max(ef, k, start.shape[1]))
        ids[lo : lo + LOCKSTEP] = np.where(found[:, :k] >= 0, g.ids[found[:, :k]], -1)
        sims[lo : lo + LOCKSTEP] = sim[:, :k]
    return ids, sims


_GRAPH = "shard long, dim int, entry int, ids binary, vectors binary, levels array<binary>"


def _vectors(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float32).reshape(-1, dim)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    dim = len(pdf["unit"].iloc[0]) // 4
    g = build(pdf["node"].to_numpy(np.int64), _vectors(pdf["unit"], dim))
    row = {"shard": int(pdf["shard"].iloc[0]), "dim": dim, "entry": g.entry, "ids": g.ids.tobytes(), "vectors": g.vectors.tobytes(), "levels": [x.astype(np.int32).tobytes() for x in g.levels]}
    return pd.DataFrame([row])


def _query_block(k: int):
    def fn(key, graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(queries):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "near": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        r = graphs.iloc[0]
        ids = np.frombuffer(r["ids"], np.int64)
        levels = [np.frombuffer(x, np.int32).reshape(len(ids), -1) for x in r["levels"]]
        g = Graph(ids, np.frombuffer(r["vectors"], np.float32).reshape(-1, r["dim"]), levels, int(r["entry"]))
        near, sim = query(g, _vectors(queries["unit"], r["dim"]), k)
        own = np.repeat(queries["node"].to_numpy(np.int64), k)
        near, sim = near.ravel(), sim.ravel()
        ok = near >= 0
        return pd.DataFrame({"node": own[ok], "near": near[ok], "similarity": sim[ok].astype(float)})

    return fn


def _units(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 1))
    # by the largest element first, so that no square overflows or vanishes
    v = v / np.maximum(np.abs(v).max(1, keepdims=True), np.finfo(float).tiny) if len(v) else v
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = (v / np.where(norm > 0, norm, 1)).astype(np.float32) + np.float32(0)  # no negative zeros
    return pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(np.int64), "unit": [x.tobytes() for x in v]})


def centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first ``cells`` rows; empty cells keep their place."""
    c = sample[:cells].copy()
    for _ in range(rounds):
        of = np.concatenate([(sample[lo : lo + 4096] @ c.T).argmax(1) for lo in range(0, len(sample), 4096)]) if len(sample) else np.zeros(0, int)
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c)
    return c


def _nearest_cells(c: np.ndarray, count: int):
    """(node, unit, cell): a row for each of the ``count`` nearest cells of a node."""

    def fn(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            s = _vectors(pdf["unit"], c.shape[1]) @ c.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :count]
            pdf = pdf.loc[pdf.index.repeat(top.shape[1])]
            yield pd.DataFrame({"node": pdf["node"].to_numpy(), "unit": pdf["unit"].to_numpy(), "cell": top.ravel().astype(np.int32)})

    return fn


def _best(found: DataFrame, by: str, count: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("similarity"), by))
    return found.withColumn("rank", rank).where(F.col("rank") <= count).drop("rank")


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, shard: int = SHARD, every: int = 1, probes: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbor_id, similarity) of the k nearest others of every vector whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    good = (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where("vec_id is not null and embedding is not null and size(embedding) > 0")
        .where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    )
    common = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1
    work = tc.Scratch(spark, "hnsw")
    one = good.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    units = work.keep(one.mapInPandas(lambda it: (_units(p) for p in it), "vec_id long, unit binary"), "units")
    place = F.row_number().over(W.partitionBy("unit").orderBy("vec_id"))
    few = units.withColumn("place", place).where(F.col("place") <= k + 1).withColumn("node", F.min("vec_id").over(W.partitionBy("unit")))
    ids = work.keep(few.select("node", "vec_id", "unit"), "ids")
    nodes = ids.where("node = vec_id").select("node", "unit")
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(ROUTE_SAMPLE).toPandas()
    cells = max(1, min(-(-2 * n // shard), CELLS, len(sample)))
    c = centroids(_vectors(sample["unit"], dim), cells) if len(sample) else np.zeros((1, dim), np.float32)
    placed = work.keep(nodes.mapInPandas(_nearest_cells(c, 1), "node long, unit binary, cell int"), "placed")
    parts = placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / shard).alias("parts"))
    parts = F.broadcast(spark.createDataFrame(parts.collect(), "cell int, parts long"))  # at most CELLS rows
    number = (F.col("cell") * F.lit(1 << 32)).cast("long")
    own = placed.join(parts, "cell").select("node", "unit", (number + F.pmod(F.xxhash64("node"), F.col("parts"))).alias("shard"))
    graphs = work.keep(own.groupBy("shard").applyInPandas(_build_shard, _GRAPH), "graphs")

    asked = work.keep(units.where(F.pmod("vec_id", F.lit(every)) == 0).join(nodes, "unit").select("vec_id", "node"), "asked")
    seekers = nodes.join(asked.select("node").distinct(), "node")
    visits = seekers.mapInPandas(_nearest_cells(c, min(probes or cells, cells)), "node long, unit binary, cell int").join(parts, "cell")
    visits = work.keep(visits.select("node", "unit", F.explode(F.sequence(number, number + F.col("parts") - 1)).alias("shard")), "visits")
    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    left = graphs.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    right = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_query_block(k + 1), "node long, near long, similarity double")
    # a node's copies are in its answer whether the search met it or not
    self = seekers.select("node", F.col("node").alias("near"), F.when(F.col("unit") == F.lit(bytes(4 * dim)), 0.0).otherwise(1.0).alias("similarity"))
    found = found.where("node != near").union(self)
    members = ids.select(F.col("node").alias("near"), F.col("vec_id").alias("id"))
    answers = _best(_best(found, "near", k + 1).join(members, "near"), "id", k + 1)
    answers = answers.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "id"))).alias("best"))
    return (
        asked.join(answers, "node")
        .select("vec_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("at", "b"))
        .select("vec_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("neighbor_id"), (-F.col("b.far")).alias("similarity"))
    )


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every vector whose id is divisible by QUERY_EVERY, among all vectors."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=QUERY_EVERY)
