"""Approximate nearest neighbours by layered neighbour graphs, one a shard.

The index is a table, a row a vector: its shard, its place there, its vector and its neighbours on each layer. Shards
have a bounded number of rows, so their number grows with the table and each is built in a task of its own; a search
asks every shard and keeps the best of all answers. Layers and the order of insertion follow from hashes of the ids, so
the same vectors make the same index.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import ship

#: Links of a vector on each layer above the lowest (twice as many there), and breadths of the searches that build and ask.
LINKS, BUILD_BREADTH, SEARCH_BREADTH = 16, 200, 50
#: Vectors of a shard, at most about, and of a block that is compared at once.
SHARD_ROWS, BLOCK_ROWS = 20_000, 256


class LayeredGraph:
    """The graph of one shard: unit vectors, and a table a layer with the neighbours of each, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, links: list[list[list[int]]]):
        self.x = vectors
        layers = np.array([len(n) for n in links])
        self.top = int(layers.argmax())
        self.tables = []
        for layer in range(layers.max()):
            lists = [n[layer] if len(n) > layer else () for n in links]
            sizes = np.array([len(n) for n in lists])
            table = np.full((len(lists), max(1, sizes.max())), -1)
            table[np.arange(table.shape[1]) < sizes[:, None]] = np.concatenate(lists)
            self.tables.append(table)

    def near(self, q: np.ndarray, start: np.ndarray, breadth: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of q, from its start: distances and nodes of the nearest found on a layer, nearest first: best first, until what is left is farther than the worst kept. All of q take their steps together; what is missing is infinitely far, at -1."""
        table, every = self.tables[layer], np.arange(len(q))
        away, nodes = np.full((len(q), breadth), np.inf), np.full((len(q), breadth), -1)
        away[:, 0], nodes[:, 0] = 1 - np.einsum("ij,ij->i", self.x[start], q), start
        # Only kept nodes are opened: one that fell out is farther than the worst kept.
        left = nodes >= 0
        seen = np.zeros((len(q), len(self.x)), bool)
        seen[every, start] = True
        while len(on := np.flatnonzero(left.any(axis=1))):
            k = left[on].argmax(axis=1)
            left[on, k] = False
            there = table[nodes[on, k]]
            new = (there >= 0) & ~seen[on[:, None], there]
            row = np.repeat(on, new.sum(axis=1))
            seen[row, there[new]] = True
            far = np.full(there.shape, np.inf)
            far[new] = 1 - np.einsum("ij,ij->i", self.x[there[new]], q[row])
            some = (far < away[on, -1:]).any(axis=1)
            on, far, there, new = on[some], far[some], there[some], new[some]
            all_away, all_nodes, all_left = np.hstack([away[on], far]), np.hstack([nodes[on], there]), np.hstack([left[on], new])
            order = np.argsort(all_away, axis=1, kind="stable")[:, :breadth]
            away[on], nodes[on], left[on] = (np.take_along_axis(v, order, axis=1) for v in (all_away, all_nodes, all_left))
        return away, np.where(np.isfinite(away), nodes, -1)

    def search(self, q: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of q the distances and nodes of the k nearest that are found."""
        found = []
        for start in range(0, len(q), BLOCK_ROWS):
            some = q[start : start + BLOCK_ROWS]
            at = np.full(len(some), self.top)
            for layer in range(len(self.tables) - 1, 0, -1):
                at = self.near(some, at, 1, layer)[1][:, 0]
            found.append([v[:, :k] for v in self.near(some, at, max(k, breadth), 0)])
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _chosen(x: np.ndarray, away: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
    """Of each row of found (nodes, nearest first, away as far; infinitely far ones don't count) at most that many, each nearer to the row's vector than to those chosen before it; the nearest of the rest fill up. What is missing is -1."""
    rows, near = np.arange(len(found)), x[found]
    left = np.isfinite(away)
    rank = np.where(left, most + np.arange(found.shape[1]), most + found.shape[1])
    for turn in range(min(most, found.shape[1])):
        on = left.any(axis=1)
        if not on.any():
            break
        k = left.argmax(axis=1)
        rank[rows[on], k[on]] = turn
        left &= away <= 1 - (near @ near[rows, k][:, :, None])[:, :, 0]
        left[rows, k] = False
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, axis=1) < most + found.shape[1], np.take_along_axis(found, order, axis=1), -1)


def _layer(x: np.ndarray, least: int, most: int, breadth: int) -> list[np.ndarray]:
    """For each vector of a layer its neighbours there."""
    sources, targets = [], []
    for start in range(0, len(x), BLOCK_ROWS):
        own = np.arange(start, min(start + BLOCK_ROWS, len(x)))
        away = 1 - x[own] @ x[: own[-1] + 1].T
        away[:, start:][np.arange(len(own)) >= np.arange(len(own))[:, None]] = np.inf
        found = np.argpartition(away, min(breadth, away.shape[1]) - 1, axis=1)[:, :breadth]
        found.sort(axis=1)
        away = np.take_along_axis(away, found, axis=1)
        order = np.argsort(away, axis=1, kind="stable")
        picked = _chosen(x, np.take_along_axis(away, order, axis=1), np.take_along_axis(found, order, axis=1), least)
        sources.append(np.repeat(own, picked.shape[1])[picked.ravel() >= 0])
        targets.append(picked.ravel()[picked.ravel() >= 0])
    one, other = np.concatenate(sources), np.concatenate(targets)
    one, other = np.concatenate([one, other]), np.concatenate([other, one])
    away = np.empty(len(one))
    for start in range(0, len(one), 100 * BLOCK_ROWS):
        part = slice(start, start + 100 * BLOCK_ROWS)
        away[part] = 1 - np.einsum("ij,ij->i", x[one[part]], x[other[part]])
    order = np.lexsort((other, away, one))
    away, other = away[order], other[order]
    sizes = np.bincount(one, minlength=len(x))
    starts = np.cumsum(sizes) - sizes
    links = [other[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())]
    # Nodes with too many links choose among all of theirs, in blocks of about equal numbers of links.
    full = np.flatnonzero(sizes > most)
    full = full[np.argsort(sizes[full], kind="stable")]
    while len(full):
        block = full[: BLOCK_ROWS]
        block = block[: max(1, int(np.searchsorted(sizes[block] * np.arange(1, len(block) + 1), BLOCK_ROWS * breadth)))]
        full = full[len(block) :]
        at = np.arange(sizes[block[-1]])
        there = at < sizes[block][:, None]
        place = np.where(there, starts[block][:, None] + at, 0)
        for node, picked in zip(block.tolist(), _chosen(x, np.where(there, away[place], np.inf), other[place], most)):
            links[node] = picked[picked >= 0]
    return links


def layered_links(x: np.ndarray, layers: np.ndarray, most: int = LINKS, breadth: int = BUILD_BREADTH) -> list[list[list[int]]]:
    """For each unit vector, in the order of insertion, its neighbours on each of its layers.

    A vector is linked with some of the nearest before it, and these with it; who has too many links then chooses among
    all of them. The nearest before it are found by products of blocks of vectors and not by a search of the graph so
    far: none is missed, and a shard of bounded rows takes bounded work, without a step of Python for each node on the way.
    """
    links: list[list[list[int]]] = [[] for _ in range(len(x))]
    for layer in range(int(layers.max(initial=0))):
        nodes = np.flatnonzero(layers > layer)
        for node, theirs in zip(nodes.tolist(), _layer(x[nodes], most, most * (2 if layer == 0 else 1), breadth)):
            links[node].append(nodes[theirs].tolist())
    return links


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def build_index(vectors: DataFrame, path: str, links: int = LINKS, breadth: int = BUILD_BREADTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors (id, embedding, and columns to filter by) -> the index, written as a table to path and read from there: any later session may search it.

    Rows without id or embedding, and vectors of length 0, are not indexed. Of rows that share an id, that with the
    least embedding is. All vectors of a table have one length.
    """
    spark = vectors.sparkSession
    ship(spark)
    clean = vectors.where("id is not null and embedding is not null and exists(embedding, x -> x <> 0)").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    clean = clean.groupBy("id").agg(F.min("embedding").alias("embedding"))
    shards = max(1, -(-clean.count() // shard_rows))
    order = F.xxhash64("id")
    # The layer of a vector: as an exponential distribution with mean 1 / ln(links) has it, out of a hash.
    share = (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) + 1) / float(1 << 30)
    layers = (F.floor(-F.log(share) / log(links)) + 1).cast("int")
    dealt = clean.select("id", "embedding", F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("_order"), layers.alias("layers"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_order", "id"], ignore_index=True)
        near = layered_links(_units(part["embedding"]), part["layers"].to_numpy(), links, breadth)
        return pd.DataFrame({"shard": part["shard"], "node": np.arange(len(part)), "id": part["id"], "embedding": part["embedding"], "neighbours": near})

    kind = vectors.schema["id"].dataType.simpleString()
    dealt.repartitionById(shards, F.col("shard")).groupBy("shard").applyInPandas(build, f"shard int, node int, id {kind}, embedding array<double>, neighbours array<array<int>>").write.parquet(path)
    return spark.read.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, breadth: int = SEARCH_BREADTH) -> DataFrame:
    """(query, id, score, rank): for each query (id, embedding) the k nearest by cosine that the index finds, best first, equal ones by id.

    A query that is in the index finds itself. Queries without embedding, or of length 0, find nothing. Each shard gets
    all queries, in blocks of Arrow batches; queries are meant to be few against the index, and shards to be many.
    """
    ship(index.sparkSession)
    asked = queries.where("embedding is not null and exists(embedding, x -> x <> 0)").select(F.col("id").alias("query"), F.col("embedding").cast("array<double>").alias("embedding"))
    # A stated set of queries against all shards: as many rows as there are answers to come.
    numbers = index.agg(F.max("shard")).first()[0]
    sent = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(numbers or 0))).alias("shard"))

    def answer(shard: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "id", "score"]
        if not len(shard) or not len(questions):
            return pd.DataFrame({c: [] for c in columns})
        shard = shard.sort_values("node", ignore_index=True)
        questions = questions.sort_values("query", kind="stable", ignore_index=True)
        graph = LayeredGraph(_units(shard["embedding"]), shard["neighbours"].tolist())
        away, nodes = graph.search(_units(questions["embedding"]), k, breadth)
        row, at = np.nonzero(nodes >= 0)
        return pd.DataFrame({"query": questions["query"].to_numpy()[row], "id": shard["id"].to_numpy()[nodes[row, at]], "score": 1 - away[row, at]})

    kinds = index.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    # By the shard's own number each has a task for itself, whatever its hash and its compressed size.
    dealt = [side.repartitionById((numbers or 0) + 1, F.col("shard")).groupBy("shard") for side in (index, sent)]
    found = dealt[0].cogroup(dealt[1]).applyInPandas(answer, f"query {kinds[1]}, id {kinds[0]}, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), "id"))), 1, k)
    top = found.groupBy("query").agg(best.alias("best")).select("query", F.posexplode("best").alias("at", "b"))
    return top.select("query", F.col("b.id").alias("id"), (-F.col("b.away")).alias("score"), (F.col("at") + 1).alias("rank"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query, id) rows that were found."""
    both = exact.select("query", "id").join(found.select("query", "id").distinct(), ["query", "id"], "left_semi").count()
    return both / max(1, exact.count())

