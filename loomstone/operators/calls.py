"""Call flows: what a function calls, in the order in which a reader would follow the calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.graph import cut
from loomstone.session import ship


def call_flow(calls: DataFrame, entries: DataFrame, depth: int = 5, breadth: int = 5) -> DataFrame:
    """(entry, place, id, depth, truncated): from each entry the functions that are called, depth first, each once.

    calls: src, dst, place, the order of calls within src; equal calls count once, at their first place, and of equal
    places the lesser dst comes first. entries: id. Only the first `breadth` calls of a function are followed, `depth`
    levels down. place counts from 0 in the order of the visit; depth is that of the visit, which need not be the least;
    truncated: a call of this entry was left out for its depth.

    The functions that an entry may come to are joined a level at a time for all entries at once, each once a level
    and not once a path; then each entry is worked through in one row with the calls of its functions. It has
    breadth ** depth functions at most, so a task holds no more than that of an entry.
    """
    ship(calls.sparkSession)
    first = calls.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("place").alias("place"))
    ranked = first.withColumn("_nth", F.row_number().over(Window.partitionBy("src").orderBy("place", "dst"))).where(F.col("_nth") <= breadth)
    followed = cut(ranked.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("_nth", "dst"))).alias("_to")).select("id", F.col("_to.dst").alias("_to")))
    level = cut(entries.select(F.col("id").alias("entry"), "id").distinct().join(followed, "id", "left"))
    met = level
    for _ in range(depth):
        after = level.select("entry", F.explode("_to").alias("id")).distinct()
        level = cut(after.join(followed, "id", "left"))
        if level.isEmpty():
            break
        met = met.unionByName(level)
    packed = met.groupBy("entry").agg(F.collect_set(F.struct("id", "_to")).alias("_met")).select(F.array("entry").alias("entry"), F.col("_met.id").alias("_id"), F.col("_met._to").alias("_to"))

    def visit(entry, to: dict) -> tuple[list[tuple], bool]:
        seen, out, truncated, stack = set(), [], False, [(entry, 0)]
        while stack:
            node, at = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((node, at))
            if at < depth:
                stack += [(n, at + 1) for n in reversed(to.get(node, ()))]
            elif to.get(node):
                truncated = True
        return out, truncated

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for own, ids, to in zip(f["entry"], f["_id"], f["_to"]):
                entry = None if pd.isna(own[0]) else own[0]
                out, truncated = visit(entry, {i: [] if t is None else list(t) for i, t in zip(ids, to)})
                rows += [(entry, i, node, d, truncated) for i, (node, d) in enumerate(out)]
            yield pd.DataFrame(rows, columns=["entry", "place", "id", "depth", "truncated"])

    kind = calls.schema["src"].dataType.simpleString()
    return packed.mapInPandas(work, f"entry {kind}, place int, id {kind}, depth int, truncated boolean")
