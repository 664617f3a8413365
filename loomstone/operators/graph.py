"""Graph analytics on edge tables (src, dst, ...): frontier loops of joins, with cut lineage; exact kernels only on bounded groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.session import ship


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own, which only a local master can share."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="loomstone-"))
    return (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names."""
    _shared(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in that folder, for a table that is written once."""
    return f"{_shared(spark)}/loomstone-{uuid.uuid4().hex[:12]}-{name}"


#: Rows up to which a side of a join is broadcast.
FEW = 10_000


def joined_side(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is broadcast while it has few rows, and else merged: what grows with the input never goes to the driver."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, indegree, outdegree, role): role isolated, root, leaf or inner."""
    e = simple(edges)
    all_ = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0))).union(nodes(edges).select("id", F.lit(0), F.lit(0)))
    out = all_.groupBy("id").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    return out.withColumn("role", F.when((F.col("indegree") == 0) & (F.col("outdegree") == 0), "isolated").when(F.col("indegree") == 0, "root").when(F.col("outdegree") == 0, "leaf").otherwise("inner"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and greatest degrees."""
    d = degrees(edges)
    n, e = F.count(F.lit(1)), F.sum("outdegree")
    return d.agg(n.alias("nodes"), e.alias("edges"), F.when(n > 1, e / (n * (n - 1))).otherwise(0.0).alias("density"), F.avg("outdegree").alias("mean_degree"), F.max("indegree").alias("max_in"), F.max("outdegree").alias("max_out"))


def reach(edges: DataFrame, start: DataFrame, depth: int | None = None, keep_start: bool = True) -> DataFrame:
    """(root, id, depth): breadth first from every id of start along src -> dst, each node at its least depth, as far as edges go or up to a depth.

    One join and one anti-join a level, each level cut, so the plan stays small; the edges are made once.
    """
    e = cut(simple(edges))
    seen = frontier = cut(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    size = total = frontier.count()
    for d in count(1) if depth is None else range(1, depth + 1):
        step = joined_side(frontier, size).join(e, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(joined_side(seen, total), ["root", "id"], "left_anti").withColumn("depth", F.lit(d)))
        size = frontier.count()
        if not size:
            break
        seen, total = seen.union(frontier), total + size
        if d % 20 == 0:
            seen = cut(seen)  # else its plan grows with the levels
    return seen if keep_start else seen.where("depth > 0")


def shortest_path(edges: DataFrame, source, target, most: int = 20) -> DataFrame:
    """(path): one shortest path as an array, the least in order among equals; no row if there is none."""
    e = cut(simple(edges))
    frontier = cut(e.sparkSession.createDataFrame([(source, [source])], _path_schema(edges)))
    seen, size, total = frontier.select("id"), 1, 1
    for _ in range(most):
        hit = frontier.where(F.col("id") == F.lit(target))
        if not hit.isEmpty():
            return hit.select("path")
        step = joined_side(frontier, size).join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(joined_side(seen, total), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        frontier = cut(step)
        size = frontier.count()
        if not size:
            break
        seen, total = seen.union(frontier.select("id")), total + size
    return frontier.where(F.lit(False)).select("path")


def _path_schema(edges: DataFrame) -> str:
    kind = edges.schema["src"].dataType.simpleString()
    return f"id {kind}, path array<{kind}>"


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank): Jacobi sweeps from 1/n, without giving back what nodes without outgoing edges hold; stops at an L1 change under the tolerance."""
    e = cut(simple(edges))
    all_ = cut(nodes(edges))
    n = all_.count()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("_out"))
    links = cut(e.join(out, "src"))
    ranks = all_.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        given = links.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("_out")).alias("_in"))
        new = cut(ranks.join(given, "id", "left").select("id", "rank", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("_in", F.lit(0.0))).alias("_new")))
        change = new.agg(F.sum(F.abs(F.col("_new") - F.col("rank")))).first()[0] or 0.0
        ranks = new.select("id", F.col("_new").alias("rank"))
        if change < tolerance:
            break
    return ranks


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): power iteration on the undirected graph, L2 norm, stops at an L1 change under the tolerance."""
    e = cut(both_ways(simple(edges)))
    scores = cut(nodes(edges).withColumn("score", F.lit(1.0)))
    for _ in range(rounds):
        got = e.join(scores.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("_s"))
        raw = cut(scores.join(got, "id", "left").select("id", "score", F.coalesce("_s", F.lit(0.0)).alias("_s")))
        norm = raw.agg(F.sqrt(F.sum(F.col("_s") * F.col("_s")))).first()[0] or 1.0
        new = raw.select("id", "score", (F.col("_s") / norm).alias("_s"))
        change = new.agg(F.sum(F.abs(F.col("_s") - F.col("score")))).first()[0] or 0.0
        scores = new.select("id", F.col("_s").alias("score"))
        if change < tolerance:
            break
    return scores


def closeness(edges: DataFrame, depth: int, start: DataFrame | None = None) -> DataFrame:
    """(id, closeness): reached nodes over the sum of their distances along outgoing edges."""
    r = reach(edges, nodes(edges) if start is None else start, depth, keep_start=False)
    got = r.groupBy(F.col("root").alias("id")).agg((F.count(F.lit(1)) / F.sum("depth")).alias("closeness"))
    return (nodes(edges) if start is None else start.select("id")).join(got, "id", "left").select("id", F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def betweenness(edges: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """(id, betweenness): directed breadth-first dependencies of all sources, times 2 / ((n - 1)(n - 2)).

    Sources are dealt out to tasks; the adjacency is broadcast, so its size is checked and a larger graph is refused.
    """
    spark = edges.sparkSession
    e = cut(simple(edges))
    size = e.count()
    if size > most_edges:
        raise ValueError(f"{size} edges; betweenness holds the adjacency in memory up to {most_edges}")
    names = [r[0] for r in nodes(edges).orderBy("id").collect()]
    number = {x: i for i, x in enumerate(names)}
    n = len(names)
    pairs = np.array([(number[a], number[b]) for a, b in e.collect()], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    starts = np.searchsorted(pairs[:, 0], np.arange(n + 1))
    sent = spark.sparkContext.broadcast((starts, pairs[:, 1]))

    def kernel(frames):
        starts, to = sent.value
        total = np.zeros(n)
        for f in frames:
            for s in f["i"]:
                level, paths, order = np.full(n, -1), np.zeros(n), []
                level[s], paths[s], front = 0, 1, np.array([s])
                while len(front):
                    order.append(front)
                    counts = starts[front + 1] - starts[front]
                    frm = np.repeat(front, counts)
                    dst = np.concatenate([to[starts[v] : starts[v + 1]] for v in front]) if counts.sum() else np.zeros(0, np.int64)
                    new = np.unique(dst[level[dst] < 0])
                    level[new] = level[front[0]] + 1
                    ok = level[dst] == level[front[0]] + 1
                    np.add.at(paths, dst[ok], paths[frm[ok]])
                    front = new
                need = np.zeros(n)
                for front in reversed(order[:-1]):
                    counts = starts[front + 1] - starts[front]
                    frm = np.repeat(front, counts)
                    dst = np.concatenate([to[starts[v] : starts[v + 1]] for v in front]) if counts.sum() else np.zeros(0, np.int64)
                    ok = level[dst] == level[front[0]] + 1
                    np.add.at(need, frm[ok], paths[frm[ok]] / paths[dst[ok]] * (1 + need[dst[ok]]))
                need[s] = 0
                total += need
        some = np.flatnonzero(total)
        yield pd.DataFrame({"i": some, "b": total[some]})

    scale = 2 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    kind = edges.schema["src"].dataType.simpleString()
    known = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"i long, id {kind}")
    summed = spark.range(n).select(F.col("id").alias("i")).repartition(max(1, min(64, n // 50 + 1))).mapInPandas(kernel, "i long, b double").groupBy("i").agg(F.sum("b").alias("b"))
    return known.join(summed, "i", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


#: Sources of a block, as a power of two, and the greatest number of nodes or edges it may reach to be worked through in a task.
BLOCK_BITS, BLOCK_ROWS = 9, 500_000


def betweenness_joins(edges: DataFrame) -> DataFrame:
    """(id, betweenness): what betweenness gives, without a limit.

    Sources are dealt by ranges to blocks. What a block reaches is found by joins of (block, id), a row for each node
    however many of its sources reach it, and goes to a task with its edges, if these are BLOCK_ROWS at most. Sources of
    wider blocks go by breadth-first levels of (root, id, paths) as joins, with a row for each source and node it reaches:
    quadratic in a graph where most reach most.
    """
    e = cut(simple(edges))
    all_ = cut(nodes(edges))
    n = all_.count()
    total, wide = _dependencies_by_block(e, all_, n)
    if wide is not None:
        total = total.unionByName(_dependencies_by_level(e, wide))
    summed = total.groupBy("id").agg(F.sum("need").alias("_b"))
    scale = 2 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return all_.join(summed, "id", "left").select("id", (F.coalesce("_b", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies_by_block(e: DataFrame, all_: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, need) of the sources of blocks that reach BLOCK_ROWS at most, and (id) of the other sources, or None."""
    dealt = all_.repartitionByRange(n // 100_000 + 1, "id").sortWithinPartitions("id")
    sources = cut(dealt.select(F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"), "id"))
    over = lambda rows: rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_ROWS).select("block")
    links, seen, front, size = e.hint("merge"), sources, sources, n
    while True:
        step = front.join(links, F.col("id") == F.col("src")).select("block", F.col("dst").alias("id")).distinct()
        front, before = cut(step.join(seen.hint("merge"), ["block", "id"], "left_anti")), size
        size = front.count()
        if not size:
            break
        seen = seen.union(front)
        if size > before:  # blocks that are too wide need go no farther
            front = cut(front.join(cut(over(seen)).hint("merge"), "block", "left_anti"))
    inside = seen.join(links, F.col("id") == F.col("src")).select("block", "src", "dst")
    wide = cut(over(seen).union(over(inside)).distinct())
    rows = inside.union(sources.select("block", "id", F.lit(None).cast(e.schema["dst"].dataType)))
    some = not wide.isEmpty()
    if some:
        rows = rows.join(wide, "block", "left_anti")

    def work(group: pa.Table) -> pa.Table:
        frm, dst = (group[c].combine_chunks() for c in ("src", "dst"))
        names = pa.concat_arrays([frm, dst.drop_null()]).unique()
        frm, start = pc.index_in(frm, names).to_numpy(), pc.is_null(dst).to_numpy(zero_copy_only=False)
        m, roots, pairs = len(names), frm[start], frm[~start]
        order = np.argsort(pairs, kind="stable")
        to = pc.index_in(dst.drop_null(), names).to_numpy()[order].astype(np.int64)
        starts = np.searchsorted(pairs[order], np.arange(m + 1))
        total, at_once = np.zeros(m), max(1, 2_000_000 // m)
        for i in range(0, len(roots), at_once):
            part = roots[i : i + at_once]
            first = np.arange(len(part)) * m + part  # a cell is a root of this part and a node
            met, paths, need, slot = np.zeros(len(part) * m, bool), np.zeros(len(part) * m), np.zeros(len(part) * m), np.empty(len(part) * m, np.int64)
            met[first], paths[first], keys, levels = True, 1, first, []
            while len(keys):
                node = keys % m
                counts = starts[node + 1] - starts[node]
                via = np.repeat(np.arange(len(keys)), counts)
                edge = np.arange(len(via)) + np.repeat(starts[node] - (np.cumsum(counts) - counts), counts)
                cell = (keys - node)[via] + to[edge]
                new = ~met[cell]
                via, cell = via[new], cell[new]
                slot[cell] = np.arange(len(cell))
                got = cell[slot[cell] == np.arange(len(cell))]  # each new cell once
                slot[got] = np.arange(len(got))
                paths[got] = np.bincount(slot[cell], paths[keys[via]], len(got))
                met[got] = True
                levels.append((keys, via, cell))
                keys = got
            for keys, via, cell in reversed(levels):
                need[keys] = paths[keys] * np.bincount(via, (1 + need[cell]) / paths[cell], len(keys))
            need[first] = 0
            total += need.reshape(len(part), m).sum(axis=0)
        some = np.flatnonzero(total)
        return pa.table({"id": names.take(pa.array(some)), "need": total[some]})

    kind, tasks = e.schema["src"].dataType.simpleString(), max(e.sparkSession.sparkContext.defaultParallelism, (n >> BLOCK_BITS) // 16)
    total = rows.repartition(tasks, "block").groupBy("block").applyInArrow(work, f"id {kind}, need double")
    return total, sources.join(wide, "block", "left_semi").select("id") if some else None


def _dependencies_by_level(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, need) of these sources by levels of joins; ids may come several times."""
    levels = [cut(sources.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("root", "id")
    while True:
        step = levels[-1].join(e, F.col("id") == F.col("src")).groupBy("root", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        new = cut(step.join(seen, ["root", "id"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        seen = seen.union(new.select("root", "id"))
    need, total = None, levels[0].select("id", F.lit(0.0).alias("need"))
    for d in range(len(levels) - 1, 1, -1):
        there = levels[d].withColumn("need", F.lit(0.0)) if need is None else need
        given = there.select("root", F.col("id").alias("dst"), ((1 + F.col("need")) / F.col("paths")).alias("_g")).join(e, "dst").select("root", F.col("src").alias("id"), "_g")
        given = given.groupBy("root", "id").agg(F.sum("_g").alias("_g"))
        need = cut(levels[d - 1].join(given, ["root", "id"], "left").select("root", "id", "paths", (F.col("paths") * F.coalesce("_g", F.lit(0.0))).alias("need")))
        total = total.unionByName(need.groupBy("id").agg(F.sum("need").alias("need")))
    return total


def strong_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component, size): strongly connected components, named by their least node.

    Forward and backward colouring: the least label is pushed along edges to a fixpoint; nodes that reach their own label
    back form its component, leave, and the rest goes round again. All joins and grouped minima.
    """
    e = cut(simple(edges))
    left = cut(nodes(edges))
    done = None
    while not left.isEmpty():
        colour = left.withColumn("colour", F.col("id"))
        while True:
            pushed = e.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("_c"))
            new = cut(colour.join(pushed, "id", "left").select("id", F.least("colour", "_c").alias("colour"), (F.col("_c") < F.col("colour")).alias("_moved")))
            moved = not new.where("_moved").isEmpty()
            colour = new.select("id", "colour")
            if not moved:
                break
        inner = cut(e.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("_b")), "dst").where("_a = _b").select("src", "dst", F.col("_a").alias("colour")))
        back = cut(colour.where("id = colour"))
        front = back
        while True:
            step = inner.join(front.select(F.col("id").alias("dst"), F.col("colour")), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            front = cut(step.join(back, ["id", "colour"], "left_anti"))
            if front.isEmpty():
                break
            back = cut(back.union(front))
        done = back if done is None else cut(done.union(back))
        left = cut(left.join(back, "id", "left_anti"))
        e = cut(e.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti"))
    if done is None:
        return nodes(edges).select("id", F.col("id").alias("component"), F.lit(1).cast("long").alias("size"))
    size = done.groupBy("colour").agg(F.count(F.lit(1)).alias("size"))
    return done.join(size, "colour").select("id", F.col("colour").alias("component"), "size")


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(cycle): simple cycles up to `longest` nodes, each once, as arrays that begin with their least node."""
    e = simple(edges)
    kind = edges.schema["src"].dataType.simpleString()
    paths = e.where("src < dst").select(F.array("src", "dst").alias("p"))
    found = e.sparkSession.createDataFrame([], f"cycle array<{kind}>")
    for _ in range(longest - 1):
        last, first = F.element_at("p", -1), F.element_at("p", 1)
        ends = e.select(F.col("src").alias("_l"), F.col("dst").alias("_n"))
        grown = cut(paths.withColumns({"_l": last, "_f": first}).join(ends, "_l"))
        found = found.union(grown.where("_n = _f").select(F.col("p").alias("cycle")))
        paths = grown.where("_n > _f").where(~F.array_contains("p", F.col("_n"))).select(F.concat("p", F.array("_n")).alias("p"))
    return found


def spread(edges: DataFrame, start: DataFrame, decay: Callable[[Column, Column], Column], depth: int, least: float, incoming: bool = False) -> DataFrame:
    """(root, id, value, depth): best-path spreading activation. edges: src, dst, w (weight times confidence); value = decay(value before, w), paths under `least` end.

    One frontier join a level that keeps the greatest value of a node.
    """
    e = (reverse(edges) if incoming else edges).groupBy("src", "dst").agg(F.max("w").alias("w")).where("src <> dst")
    best = cut(start.select(F.col("id").alias("root"), "id", F.lit(1.0).alias("value"), F.lit(0).alias("depth")))
    front = best
    for d in range(1, depth + 1):
        step = front.join(e, front["id"] == e["src"]).select("root", F.col("dst").alias("id"), decay(F.col("value"), F.col("w")).alias("value")).where(F.col("value") >= least)
        step = step.groupBy("root", "id").agg(F.max("value").alias("value"))
        known = best.select("root", "id", F.col("value").alias("_v"))
        front = cut(step.join(known, ["root", "id"], "left").where("_v is null or value > _v").select("root", "id", "value", F.lit(d).alias("depth")))
        if front.isEmpty():
            break
        best = cut(best.join(front.select("root", "id"), ["root", "id"], "left_anti").union(front))
    return best.where("id <> root")


def one_hop_mean(edges: DataFrame, values: DataFrame, own: float = 0.7) -> DataFrame:
    """(id, value): own share of its value plus the rest of the mean of what it points to; without targets its own value."""
    e = simple(edges)
    theirs = e.join(values.select(F.col("id").alias("dst"), F.col("value").alias("_v")), "dst").groupBy(F.col("src").alias("id")).agg(F.avg("_v").alias("_m"))
    return values.join(theirs, "id", "left").select("id", F.when(F.col("_m").isNull(), F.col("value")).otherwise(own * F.col("value") + (1 - own) * F.col("_m")).alias("value"))


def one_hop_risk(edges: DataFrame, values: DataFrame, pass_on: float = 0.7, least: float = 0.3) -> DataFrame:
    """(id, risk): the greater of its own risk (0.5 if unknown) and 0.7 of any target's risk over 0.3."""
    e = simple(edges)
    own = nodes(edges).join(values, "id", "left").select("id", F.coalesce("value", F.lit(0.5)).alias("value"))
    theirs = e.join(own.select(F.col("id").alias("dst"), F.col("value").alias("_v")), "dst").where(F.col("_v") > least).groupBy(F.col("src").alias("id")).agg((pass_on * F.max("_v")).alias("_m"))
    return own.join(theirs, "id", "left").select("id", F.greatest("value", F.coalesce("_m", F.lit(0.0))).alias("risk"))


#: Damping of a cross-graph edge by its kind.
DAMPING = {"documents": 0.8, "depends_on": 0.7, "tests": 0.9, "part_of": 0.3, "similar_to": 0.2}


def cross_influence(edges: DataFrame, importance: DataFrame, use_confidence: bool = False) -> DataFrame:
    """(id, influence) over edges (src, dst, kind, weight, confidence): (.7 in + .3 out) / max(1, half the edges), 1 at most; outgoing edges count half."""
    table = F.create_map(*[F.lit(x) for pair in DAMPING.items() for x in pair])
    w = F.coalesce(table[F.col("kind")], F.lit(0.5)) * F.col("weight") * (F.col("confidence") if use_confidence else F.lit(1.0))
    inc = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), w.alias("w"), F.lit(1).alias("inward"))
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), (w * 0.5).alias("w"), F.lit(0).alias("inward"))
    both = inc.union(out).join(importance.select(F.col("id").alias("other"), F.col("value").alias("_i")), "other", "left").withColumn("_g", F.col("w") * F.coalesce("_i", F.lit(0.0)))
    total = 0.7 * F.sum(F.when(F.col("inward") == 1, F.col("_g")).otherwise(0.0)) + 0.3 * F.sum(F.when(F.col("inward") == 0, F.col("_g")).otherwise(0.0))
    return both.groupBy("id").agg(F.least(F.lit(1.0), total / F.greatest(F.lit(1.0), 0.5 * F.count(F.lit(1)))).alias("influence"))


def communities(edges: DataFrame, most_edges: int = 500_000, sweeps: int = 20, levels: int = 10) -> DataFrame:
    """(id, community): modularity by local moves in node order, a gain must pass 1e-9, then split into connected parts, then coarser levels.

    Local moves are sequential by definition, so the (undirected) graph goes to one task; a graph with more than most_edges
    rows goes by communities_by_merging.
    """
    e = cut(both_ways(simple(edges)))
    size = e.count()
    if size > most_edges:
        return communities_by_merging(e, most_edges, sweeps, levels)
    kind = edges.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True):
            near.setdefault(a, set()).add(b)
        of = {v: v for v in near}
        graph = near
        for _ in range(levels):
            order = sorted(graph)
            m = sum(len(x) for x in graph.values()) / 2
            if not m:
                break
            label, total = {v: v for v in order}, {v: len(graph[v]) for v in order}
            moved_any = False
            for _ in range(sweeps):
                moved = False
                for v in order:
                    k, mine = len(graph[v]), label[v]
                    links: dict = {}
                    for u in graph[v]:
                        if u != v:
                            links[label[u]] = links.get(label[u], 0) + 1
                    total[mine] -= k
                    best, gain = mine, 0.0
                    for c in sorted(links):
                        g = links[c] - k * total[c] / (2 * m)
                        if g > gain + 1e-9:
                            best, gain = c, g
                    total[best] = total.get(best, 0) + k
                    label[v] = best
                    moved |= best != mine
                moved_any |= moved
                if not moved:
                    break
            parts: dict = {}  # connected parts of each label
            for v in order:
                if v in parts:
                    continue
                parts[v], stack = v, [v]
                while stack:
                    x = stack.pop()
                    for u in graph[x]:
                        if u not in parts and label[u] == label[v]:
                            parts[u] = v
                            stack.append(u)
            of = {v: parts[c] for v, c in of.items()}
            if not moved_any:
                break
            coarse: dict = {c: set() for c in set(parts.values())}
            for v in order:
                for u in graph[v]:
                    if parts[u] != parts[v]:
                        coarse[parts[v]].add(parts[u])
            graph = coarse
        return pd.DataFrame({"id": list(of), "community": list(of.values())})

    found = e.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, f"id {kind}, community {kind}")
    return nodes(edges).join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _weighted_moves(pdf: pd.DataFrame, twice: float, sweeps: int, levels: int, least: float) -> pd.DataFrame:
    """(c, to): local moves in node order on links (a, b, w) of nodes with degrees da and db, then connected parts, then coarser levels; links keep their weights."""
    near: dict = {}
    size: dict = {}
    for a, b, w, da, db in zip(*(pdf[c].tolist() for c in ("a", "b", "w", "da", "db")), strict=True):
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
        size[a], size[b] = da, db
    of = {v: v for v in near}
    for _ in range(levels):
        order, label, total, moved_any = sorted(near), {v: v for v in near}, dict(size), False
        for _ in range(sweeps):
            moved = False
            for v in order:
                k, mine = size[v], label[v]
                links: dict = {}
                for u, w in near[v].items():
                    links[label[u]] = links.get(label[u], 0) + w
                total[mine] -= k
                best, gain = mine, 0.0
                for c in sorted(links):
                    g = links[c] - k * total[c] / twice
                    if g > gain + least:
                        best, gain = c, g
                total[best] += k
                label[v] = best
                moved |= best != mine
            moved_any |= moved
            if not moved:
                break
        if not moved_any:
            break
        parts: dict = {}
        for v in order:
            if v not in parts:
                parts[v], stack = v, [v]
                while stack:
                    x = stack.pop()
                    for u in near[x]:
                        if u not in parts and label[u] == label[v]:
                            parts[u] = v
                            stack.append(u)
        of = {v: parts[c] for v, c in of.items()}
        coarse: dict = {c: {} for c in parts.values()}
        grown: dict = {}
        for v in order:
            c = parts[v]
            grown[c] = grown.get(c, 0) + size[v]
            for u, w in near[v].items():
                if parts[u] != c:
                    coarse[c][parts[u]] = coarse[c].get(parts[u], 0) + w
        near, size = coarse, grown
    found = [(v, c) for v, c in of.items() if v != c]
    return pd.DataFrame({"c": [v for v, _ in found], "to": [c for _, c in found]}, dtype=object)


def communities_by_merging(edges: DataFrame, most_links: int = 500_000, sweeps: int = 20, levels: int = 10, least: float = 1e-9) -> DataFrame:
    """(id, community): connected communities of the undirected graph, by rounds of merges that raise modularity, named by their least node.

    In a round every community asks the neighbour with which it gains most. Of two that ask each other the lesser stays;
    of the others a hash says who stays. Those that stay take in who asks them, best first, as long as each still gains
    after all before it, so every round raises modularity. All are joins over the links between communities, which get
    fewer each round. When no more than most_links are left, local moves of whole communities, with the weights of their
    links, end it in one task; if they never get so few, merges go on until none gains.
    """
    ship(edges.sparkSession)
    a, b = F.col("src"), F.col("dst")
    pairs = cut(simple(edges).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(1).cast("long").alias("w")).distinct())
    twice = 2.0 * pairs.count()
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select("b"))
    sizes = cut(ends.groupBy("c").agg(F.count(F.lit(1)).alias("d")))
    left = sizes.select("c", "d").hint("merge")
    links = pairs.join(left.toDF("a", "da"), "a").join(left.toDF("b", "db"), "b").select("a", "b", "w", "da", "db")
    all_, merges, turn = sizes.select(F.col("c").alias("id")), [], 0
    while True:
        links = cut(links)
        if links.count() <= most_links:
            kind = links.schema["a"].dataType.simpleString()
            ended = links.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda pdf: _weighted_moves(pdf.drop(columns="_one"), twice, sweeps, levels, least), f"c {kind}, to {kind}")
            merges.append(cut(ended))
            break
        gain = F.col("w") - F.col("da") * F.col("db") / twice
        able = links.withColumns({"gain": gain, "tie": F.xxhash64("a", "b")}).where(F.col("gain") > least)
        one = able.select("gain", "tie", F.col("a").alias("c"), F.col("b").alias("o"), "w", F.col("da").alias("dc"), F.col("db").alias("do"))
        other = able.select("gain", "tie", F.col("b").alias("c"), F.col("a").alias("o"), "w", F.col("db").alias("dc"), F.col("da").alias("do"))
        best = one.unionByName(other).groupBy("c").agg(F.max(F.struct("gain", "tie", "o", "w", "dc", "do")).alias("m"))
        best = cut(best.select("c", "m.*"))
        if best.isEmpty():
            break
        theirs = best.select(F.col("c").alias("o"), F.col("o").alias("_asks")).hint("merge")
        mutual = F.col("_asks") == F.col("c")
        stays = F.when(mutual, F.col("c") < F.col("o")).otherwise(F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(2)) == 0)
        roles = cut(best.join(theirs, "o").withColumn("stays", stays))
        asked = roles.where("not stays").join(roles.where("stays").select(F.col("c").alias("o")).hint("merge"), "o", "left_semi")
        before = F.sum("dc").over(Window.partitionBy("o").orderBy(F.desc("gain"), "c").rowsBetween(Window.unboundedPreceding, -1))
        taken = asked.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("w") - F.col("dc") * (F.col("do") + F.col("_before")) / twice > least)
        merged = cut(taken.select("c", F.col("o").alias("to")))
        merges.append(merged)
        turn += 1
        placed = sizes.join(merged.hint("merge"), "c", "left").select("c", F.coalesce("to", "c").alias("to"), "d")
        sizes = cut(placed.groupBy("to").agg(F.sum("d").alias("d")).withColumnRenamed("to", "c"))
        now = cut(placed.select("c", "to").join(sizes.select(F.col("c").alias("to"), "d").hint("merge"), "to").select("c", "to", "d"))
        moved = links.select("a", "b", "w").join(now.toDF("a", "x", "dx").hint("merge"), "a").join(now.toDF("b", "y", "dy").hint("merge"), "b").where("x <> y")
        x_first = F.col("x") < F.col("y")
        turned = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w", F.when(x_first, F.col("dx")).otherwise(F.col("dy")).alias("da"), F.when(x_first, F.col("dy")).otherwise(F.col("dx")).alias("db"))
        links = turned.groupBy("a", "b").agg(F.sum("w").alias("w"), F.first("da").alias("da"), F.first("db").alias("db"))
    # From the last round back: where each that was merged went in the end.
    went = None
    for merged in reversed(merges):
        if went is None:
            went = merged
            continue
        later = went.select(F.col("c").alias("to"), F.col("to").alias("_last")).hint("merge")
        went = cut(merged.join(later, "to", "left").select("c", F.coalesce("_last", "to").alias("to")).unionByName(went))
    if went is None:
        return all_.select("id", F.col("id").alias("community"))
    roots = cut(all_.join(went.withColumnRenamed("c", "id").hint("merge"), "id", "left").select("id", F.coalesce("to", "id").alias("_root")))
    names = roots.groupBy("_root").agg(F.min("id").alias("community"))
    return roots.join(names.hint("merge"), "_root").select("id", "community")


def without_incoming(edges: DataFrame, node) -> DataFrame:
    """An intervention on a node: its incoming edges go."""
    return edges.where(F.col("dst") != F.lit(node))


def d_separated(edges: list[tuple], x, y, given: set) -> bool:
    """Of a small causal graph: does `given` block every path between x and y."""
    parents: dict = {}
    children: dict = {}
    for a, b in edges:
        children.setdefault(a, set()).add(b)
        parents.setdefault(b, set()).add(a)
    above, stack = set(given), list(given)
    while stack:
        for p in parents.get(stack.pop(), ()):
            if p not in above:
                above.add(p)
                stack.append(p)
    stack, seen = [(x, "up")], set()
    while stack:
        v, way = stack.pop()
        if (v, way) in seen:
            continue
        seen.add((v, way))
        if v == y and v not in given:
            return False
        if way == "up" and v not in given:
            stack += [(p, "up") for p in parents.get(v, ())] + [(c, "down") for c in children.get(v, ())]
        elif way == "down":
            if v not in given:
                stack += [(c, "down") for c in children.get(v, ())]
            if v in above:
                stack += [(p, "up") for p in parents.get(v, ())]
    return True


def knowledge_edges(builders: list[DataFrame], least: float = 0.1) -> DataFrame:
    """All builders' edges (src, dst, kind, weight, confidence) from a weight up; of equal edges the first builder's stays."""
    out = None
    for i, b in enumerate(builders):
        one = b.select("src", "dst", "kind", "weight", "confidence", F.lit(i).alias("_b"))
        out = one if out is None else out.unionByName(one)
    kept = out.where(F.col("weight") >= least)
    return kept.groupBy("src", "dst", "kind").agg(F.min_by(F.struct("weight", "confidence"), "_b").alias("_m")).select("src", "dst", "kind", "_m.weight", "_m.confidence")
