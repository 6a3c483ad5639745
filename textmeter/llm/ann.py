"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from textmeter.llm.common import store

#: Distinct vectors of one shard, on average: a task's graph stays small whatever the table's size.
SHARD_ROWS = 4096
#: Queries searched together in one shard.
QUERY_BLOCK = 2048
#: Partitions of one shuffle; beyond it a task takes several units, one after another.
MOST_PARTITIONS = 20_000
#: Out-neighbours of a node.
DEGREE = 32
#: Relaxation of the pruning: a neighbour goes if another one is 1/ALPHA times as near to it as the node.
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 96
#: Points inserted, or queries searched, together.
BATCH = 256
#: Nodes pruned together.
PRUNED_AT_ONCE = 1024


# --- the graph of one shard --------------------------------------------------

def _distances(vectors: np.ndarray, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from points[i] to vectors[ids[i, :]]; infinite where the id is -1."""
    gap = vectors[ids] - points[:, None, :]
    return np.where(ids < 0, np.inf, np.einsum("ijk,ijk->ij", gap, gap))


def _first_ones(ids: np.ndarray, distance: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest distinct ids of each row, nearest first; -1 fills up."""
    order = np.lexsort((ids, distance), axis=1)
    ids, distance = np.take_along_axis(ids, order, 1), np.take_along_axis(distance, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    distance = np.where(again | (ids < 0), np.inf, distance)
    order = np.argsort(distance, axis=1, kind="stable")[:, :width]
    ids, distance = np.take_along_axis(ids, order, 1), np.take_along_axis(distance, order, 1)
    return np.where(np.isinf(distance), -1, ids), distance


def beam_search(vectors, graph, entries, points, beam, visits: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search from the entries for all points at once: the ``beam`` nearest nodes met, and their distances.

    Each step opens, for every point, its nearest unopened node of the beam.
    ``visits`` collects the opened nodes of each step, -1 for points that are done.
    """
    beam = max(beam, len(entries))
    n = len(points)
    ids = np.full((n, beam), -1, "i8")
    ids[:, :len(entries)] = entries
    ids, distance = _first_ones(ids, _distances(vectors, points, ids), beam)
    opened = np.zeros((n, len(vectors)), bool)
    active = np.arange(n)
    while len(active):
        at = ids[active]
        closed = (at < 0) | opened[active[:, None], np.maximum(at, 0)]
        pick = np.argmin(closed, axis=1)
        going = ~closed[np.arange(len(active)), pick]
        active, at, pick = active[going], at[going], pick[going]
        if not len(active):
            break
        node = at[np.arange(len(active)), pick]
        opened[active, node] = True
        if visits is not None:
            step = np.full(n, -1, "i8")
            step[active] = node
            visits.append(step)
        near = graph[node]
        near = np.where((near >= 0) & opened[active[:, None], np.maximum(near, 0)], -1, near)
        far = _distances(vectors, points[active], near)
        ids[active], distance[active] = _first_ones(
            np.concatenate((at, near), 1), np.concatenate((distance[active], far), 1), beam
        )
    return ids, distance


def robust_prune(vectors, nodes, candidates, degree, alpha) -> np.ndarray:
    """Out-neighbours of each node from its candidates (-1: none), for all nodes at once.

    Repeatedly the nearest candidate is kept, and every candidate that lies
    ``alpha`` times nearer to it than to the node goes: near but diverse edges.
    """
    if len(nodes) > PRUNED_AT_ONCE:
        parts = range(0, len(nodes), PRUNED_AT_ONCE)
        return np.concatenate([robust_prune(vectors, nodes[i:i + PRUNED_AT_ONCE], candidates[i:i + PRUNED_AT_ONCE], degree, alpha) for i in parts])
    candidates = np.where(candidates == nodes[:, None], -1, candidates)
    ids, distance = _first_ones(candidates, _distances(vectors, vectors[nodes], candidates), candidates.shape[1])
    ids = ids[:, :max(1, int((ids >= 0).sum(1).max()))]
    distance = distance[:, :ids.shape[1]]
    # Squared distances between the candidates of each node.
    points = vectors[ids]
    norms = np.einsum("ijk,ijk->ij", points, points)
    between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    kept = np.full((len(nodes), degree), -1, "i8")
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = np.argmin(distance, axis=1)
        alive = np.isfinite(distance[rows, best])
        if not alive.any():
            break
        kept[alive, k] = ids[rows, best][alive]
        # Squared distances: so is alpha.
        distance = np.where((alpha * alpha * between[rows, best] <= distance) & alive[:, None], np.inf, distance)
        distance[rows[alive], best[alive]] = np.inf
    return kept


def _add_back_edges(vectors, graph, nodes, degree, alpha) -> None:
    """Let every new neighbour know the node; those whose room is used up are pruned to ``degree``."""
    room = graph.shape[1]
    source, target = np.repeat(nodes, room), graph[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (graph[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    if not len(target):
        return
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    changed, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    wide = np.full((len(changed), room + count.max()), -1, "i8")
    wide[:, :room] = graph[changed]
    wide[np.repeat(np.arange(len(changed)), count), room + place] = source
    full = (wide >= 0).sum(1) > room
    if full.any():
        graph[changed[full]] = -1
        graph[changed[full], :degree] = robust_prune(vectors, changed[full], wide[full], degree, alpha)
    graph[changed[~full]] = -np.sort(-wide[~full], axis=1)[:, :room]


def _unreached(graph, entries) -> np.ndarray:
    reached = np.zeros(len(graph), bool)
    front = np.asarray(entries)
    reached[front] = True
    while len(front):
        near = np.unique(graph[front])
        near = near[near >= 0]
        front = near[~reached[near]]
        reached[front] = True
    return np.flatnonzero(~reached)


def build_graph(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries): out-neighbours of each node (-1: none) and where searches start.

    Nodes are inserted in a seeded order, in batches that at first double: a
    greedy search proposes the nodes it opened, pruning keeps the diverse ones,
    and they are told of the newcomer. A second pass with the relaxed alpha
    follows one with alpha 1. Searches start at the node nearest to the centre;
    nodes it cannot reach become starts too, so every node can be found.
    """
    n = len(vectors)
    graph = np.full((n, degree + degree // 2), -1, "i8")
    centre = vectors.mean(axis=0, keepdims=True)
    start = np.array([int(np.argmin(((vectors - centre) ** 2).sum(1)))])
    order = np.random.default_rng(n).permutation(n)
    for relaxed in (1.0, alpha):
        done, size = 0, 1
        while done < n:
            nodes = order[done:done + size]
            visits: list[np.ndarray] = []
            ids, _ = beam_search(vectors, graph, start, vectors[nodes], beam, visits)
            proposed = np.concatenate((np.stack(visits, 1), ids, graph[nodes]), axis=1)
            graph[nodes] = -1
            graph[nodes, :degree] = robust_prune(vectors, nodes, proposed, degree, relaxed)
            _add_back_edges(vectors, graph, nodes, degree, relaxed)
            done, size = done + size, min(BATCH, 2 * size)
    entries = list(start)
    lost = _unreached(graph, start)
    while len(lost):
        entries.append(lost[0])
        lost = _unreached(graph, np.array(entries))
    return graph, np.array(entries)


# --- tables ------------------------------------------------------------------

def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles, dim): one row per key, vectors that can take part."""
    values = F.col("vector")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & values.isNotNull() & ~bad & F.exists(values, lambda x: x != 0))
    # Negative zero is zero: equal vectors are equal keys.
    rows = rows.withColumn("vector", F.transform(values, lambda x: x + F.lit(0.0)))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def _dealt(rows: DataFrame, units: int | None, *unit: str) -> DataFrame:
    """Units of work over twice as many partitions: their number, given by hand, is not merged by the few bytes they hold."""
    return rows.repartition(min(MOST_PARTITIONS, 2 * (units or 1)), *unit)


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shard, shards, node, vector, ids, near, entry): one graph per shard, one row per distinct vector.

    Copies of a vector are one node, which keeps their k + 1 smallest ids: all
    that an answer of k can show. A vector's hash names its shard, so no shard
    grows with the number of copies; the number of shards follows the number of
    distinct vectors.
    """
    by_vector = W.partitionBy("vector").orderBy("vec_id")
    # A rank limit: Spark keeps the first k + 1 of each vector before it shuffles.
    firsts = vectors.withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= k + 1)
    nodes = firsts.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vector"))
    nodes, _ = store(nodes, "vectors")
    # Proven bound: one row per length of vector that occurs.
    shards = F.broadcast(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")))
    placed = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    placed = _dealt(placed, shards.agg(F.sum("shards")).first()[0], "dim", "shard")

    def graph_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda s: s.str[0], ignore_index=True)
        graph, entries = build_graph(_scaled(np.stack(rows["vector"].to_numpy()))[0])
        rows["node"] = np.arange(len(rows), dtype="i4")
        rows["near"] = [g[g >= 0].astype("i4") for g in graph]
        rows["entry"] = np.isin(np.arange(len(rows)), entries)
        return rows[["dim", "shard", "shards", "node", "vector", "ids", "near", "entry"]]

    return placed.groupBy("dim", "shard").applyInPandas(
        graph_of, "dim int, shard int, shards int, node int, vector array<double>, ids array<long>, near array<int>, entry boolean"
    )


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Single precision in the unit cube, for finding the way; and the scale."""
    scale = float(np.abs(vectors).max())
    return (vectors / scale).astype("f4"), scale


def _answers(index: pd.DataFrame, queries: pd.DataFrame, k: int, beam: int) -> Iterator[tuple]:
    index = index.sort_values("node", ignore_index=True)
    exact = np.stack(index["vector"].to_numpy())
    vectors, scale = _scaled(exact)
    graph = np.full((len(index), max(1, index["near"].str.len().max())), -1, "i8")
    for i, near in enumerate(index["near"]):
        graph[i, :len(near)] = near
    entries = np.flatnonzero(index["entry"].to_numpy(bool))
    ids = index["ids"].to_numpy()
    for first in range(0, len(queries), BATCH):
        block = queries.iloc[first:first + BATCH]
        points = np.stack(block["vector"].to_numpy())
        met, _ = beam_search(vectors, graph, entries, (points / scale).astype("f4"), max(beam, 2 * k))
        for query, point, nodes in zip(block["vec_id"].to_numpy(), points, met):
            nodes = np.unique(nodes[nodes >= 0])
            score = np.sqrt(((exact[nodes] - point) ** 2).sum(axis=1))
            found = sorted((s, i) for s, n in zip(score.tolist(), nodes) for i in ids[n].tolist() if i != query)
            yield from ((query, i, s) for s, i in found[:k])


def search(index: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of all shards, without itself.

    Each (shard, block of queries) is one unit of work: queries are a stated set
    searched against every shard, and neither they nor the index are broadcast.
    Each unit returns k rows per query; the best k of all are ranked.
    """
    # Proven bound: one row per length of vector that occurs.
    blocks = F.broadcast(queries.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    shards = F.broadcast(index.groupBy("dim").agg(F.max("shards").alias("shards")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = queries.join(blocks, "dim").join(shards, "dim").select(
        "dim", each("shards").alias("shard"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "vector"
    )
    held = index.drop("shards").join(blocks, "dim").withColumn("block", each("blocks")).drop("blocks")

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = list(_answers(left, right, k, beam)) if len(left) and len(right) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    unit = ["dim", "shard", "block"]
    units = shards.join(blocks, "dim").agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0]
    held, asked = _dealt(held, units, *unit), _dealt(asked, units, *unit)
    found = held.groupBy(unit).cogroup(asked.groupBy(unit)).applyInPandas(both, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest(df: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each key divisible by ``every``.

    Nearness is the smallest Euclidean distance of the original vectors in
    doubles; ties go to the smaller id; the query's own id is no answer. All
    candidates come back if there are fewer than k.

    Rows with a null key, and vectors that are null, empty, zero, or hold null or
    non-finite components, take no part. Vectors are compared within their
    length. A repeated key counts once, with its smallest vector. Copies of one
    vector, however many, are one node. An empty table gives an empty table.
    Other columns are ignored.
    """
    vectors, _ = store(usable(df, key, vector), "usable")
    index, _ = store(build_index(vectors, k), "index")
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0)
    return search(index, queries, k)
