"""Causal graphs: edges (src, dst, kind, strength), made from facts and events and followed up and down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators import graph as G

#: The kinds of edges, and the strength of an edge from a function to an event it raised.
KINDS = ("causes", "enables", "prevents", "correlates")
RAISED = 0.9


def causal_edges(calls: DataFrame, events: DataFrame) -> DataFrame:
    """(src, dst, kind, strength, evidence): calls (caller, callee) and events (id, seq, cause, source) as causes.

    An event is caused by its `cause` (strength 1) and its `source` (0.9), if that is a function of the calls or an event
    not later in seq. evidence counts the facts behind an edge. Null ends make no edge.
    """
    called = calls.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit(1.0).alias("strength")).dropna()
    functions = called.select(F.col("src").alias("id")).union(called.select("dst")).distinct().select("id", F.lit(None).cast("long").alias("since"))
    known = functions.union(events.groupBy("id").agg(F.min("seq").alias("since"))).groupBy("id").agg((F.count("*") > F.count("since")).alias("static"), F.min("since").alias("since"))
    pieces = F.explode(F.array(*[F.struct(F.col(c).alias("src"), F.lit(s).alias("strength")) for c, s in (("cause", 1.0), ("source", RAISED))])).alias("e")
    traced = events.select(F.col("id").alias("dst"), "seq", pieces).select("e.src", "dst", "e.strength", "seq").dropna()
    traced = traced.join(known, (F.col("src") == F.col("id")) & (F.col("static") | (F.col("since") <= F.col("seq")))).select("src", "dst", "strength")
    return called.union(traced).groupBy("src", "dst", "strength").agg(F.count("*").alias("evidence")).select("src", "dst", F.lit("causes").alias("kind"), "strength", "evidence")


def _followed(edges: DataFrame, kinds: tuple[str, ...], least: float) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds) & (F.col("strength") >= least))


def causes(edges: DataFrame, start: DataFrame, depth: int, least: float = 0.0, kinds: tuple[str, ...] = KINDS[:3]) -> DataFrame:
    """(root, id, depth, is_first): what leads to each id of start over edges of these kinds and at least this strength.

    Mere correlations are left out unless asked for. is_first: nothing at all leads to it, over any edge.
    """
    found = G.reach(G.reverse(_followed(edges, kinds, least)), start, depth, keep_start=False)
    led = edges.select(F.col("dst").alias("id")).distinct().withColumn("led", F.lit(True))
    return found.join(led, "id", "left").select("root", "id", "depth", F.col("led").isNull().alias("is_first"))


def effects(edges: DataFrame, start: DataFrame, depth: int, least: float = 0.0, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(root, id, depth, is_last): what each id of start leads to, correlations included. is_last: it leads to nothing, over any edge."""
    found = G.reach(_followed(edges, kinds, least), start, depth, keep_start=False)
    leading = edges.select(F.col("src").alias("id")).distinct().withColumn("leading", F.lit(True))
    return found.join(leading, "id", "left").select("root", "id", "depth", F.col("leading").isNull().alias("is_last"))
