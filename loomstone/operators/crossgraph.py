"""Edges between graphs of different kinds: which they are, how importance comes over them, and along which chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.evidence import epistemic_risk, risk_level
from loomstone.operators.graph import cut

#: Fixed values: (graph of the source, or None for any, graph of the target, kind of edge, kind across graphs).
CROSSINGS = [
    ("code", "rationale", "documents", "documented_by_decision"),
    ("code", "rationale", "part_of", "documented_by_decision"),
    ("code", "rationale", "depends_on", "constrained_by_decision"),
    ("rationale", "epistemic", "depends_on", "justified_by_claim"),
    ("rationale", "epistemic", "part_of", "justified_by_claim"),
    ("rationale", "epistemic", "similar_to", "assumes_claim"),
    ("epistemic", "code", "tests", "verified_by_test"),
    ("epistemic", "code", "documents", "evidenced_by_code"),
    ("epistemic", "code", "depends_on", "evidenced_by_code"),
    (None, "org", "authored_by", "owned_by_expert"),
    ("rationale", "org", "reviewed_by", "decided_by"),
]
#: What an edge of each kind lets through.
DAMPING = {
    "documented_by_decision": 0.8,
    "constrained_by_decision": 0.9,
    "justified_by_claim": 0.7,
    "assumes_claim": 0.5,
    "verified_by_test": 0.9,
    "evidenced_by_code": 0.7,
    "owned_by_expert": 0.3,
    "decided_by": 0.5,
}
#: The part of incoming edges, of an edge taken backwards, of an entity's own importance; what counts as none.
FORWARD, BACKWARD, OWN, LEAST_IMPORTANCE = 0.7, 0.5, 0.7, 0.01
#: Links of a chain from which on no further node is opened.
LONGEST_CHAIN = 10


def cross_edges(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(src, src_graph, dst, dst_graph, kind, weight, confidence): the edges that lead from one graph to another, by their kind across graphs.

    edges: src, dst, kind, weight, confidence. graphs: id, graph, one row an entity. Edges with an end of unknown graph,
    within one graph, or of a kind that doesn't cross there, are left out.
    """
    source, target = graphs.select(F.col("id").alias("src"), F.col("graph").alias("src_graph")), graphs.select(F.col("id").alias("dst"), F.col("graph").alias("dst_graph"))
    both = edges.join(source, "src").join(target, "dst").where("src_graph <> dst_graph")
    across = None
    for a, b, kind, name in CROSSINGS:
        here = (F.col("dst_graph") == b) & (F.col("kind") == kind)
        here = here if a is None else here & (F.col("src_graph") == a)
        across = F.when(here, name) if across is None else across.when(here, name)
    return both.withColumn("kind", across).where("kind is not null").select("src", "src_graph", "dst", "dst_graph", "kind", "weight", "confidence")


def damping(kind: str = "kind") -> Column:
    """Of an edge's kind; 0 for kinds that don't cross."""
    table = F.create_map(*[F.lit(x) for pair in DAMPING.items() for x in pair])
    return F.coalesce(table[F.col(kind)], F.lit(0.0))


def influence_chains(targets: DataFrame, importance: DataFrame, edges: DataFrame, longest: int = LONGEST_CHAIN) -> DataFrame:
    """(target, place, src, dst, kind, importance, factor): along which edges importance came to each target, in the order in which they are found.

    targets: id. importance: id, value; sources that are not in it give nothing. edges: src, dst, kind, weight,
    confidence, as cross_edges makes them; factor: damping times weight times confidence. Nodes are opened breadth first; of
    an opened node the incoming edges whose source is not opened yet are links, the most important source first, then by
    src and kind. No node is opened once a chain has `longest` links, so the last opened one may make it longer. Many
    targets are followed at once, a level at a time; at most `longest` levels have links.
    """
    worth = importance.select(F.col("id").alias("src"), F.col("value").alias("importance"))
    known = edges.join(worth, "src").withColumn("factor", damping() * F.col("weight") * F.col("confidence"))
    into = cut(known.select("src", F.col("dst").alias("node"), "kind", "importance", "factor"))
    # place: the order in which nodes of a level are opened; made: links found before the level.
    level = cut(targets.select(F.col("id").alias("target"), F.col("id").alias("node"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("made")).distinct())
    opened = cut(level.select("target", "node"))
    links = None
    for _ in range(longest):
        step = level.join(into, "node").where("src <> node")
        if links is not None:  # at first only the target is open
            turn = level.select("target", F.col("node").alias("src"), F.col("place").alias("_turn"))
            old = opened.join(level.select("target", "node"), ["target", "node"], "left_anti").withColumnRenamed("node", "src")
            step = step.join(old, ["target", "src"], "left_anti").join(turn, ["target", "src"], "left").where("_turn is null or _turn > place")
        # How many links the nodes opened before it at this level have made.
        per_node = step.groupBy("target", "node", "place", "made").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("target").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        goes = per_node.withColumn("_before", F.col("made") + before).where(F.col("_before") < longest).select("target", "node", "_before")
        within = F.row_number().over(Window.partitionBy("target", "node").orderBy(F.desc("importance"), "src", "kind"))
        found = cut(step.join(goes, ["target", "node"]).withColumn("place", F.col("_before") + within).select("target", "place", "src", F.col("node").alias("dst"), "kind", "importance", "factor"))
        if found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        made = found.groupBy("target").agg(F.max("place").alias("made"))
        later = found.groupBy("target", F.col("src").alias("node")).agg(F.min("place").alias("place"))
        level = cut(later.join(made, "target").join(opened, ["target", "node"], "left_anti").select("target", "node", "place", "made"))
        # Only chains that go on are looked up again.
        opened = cut(opened.join(level.select("target").distinct(), "target", "left_semi").unionByName(level.select("target", "node")))
    empty = into.where(F.lit(False)).select(F.col("node").alias("target"), F.lit(0).cast("long").alias("place"), "src", F.col("node").alias("dst"), "kind", "importance", "factor")
    return empty if links is None else links


def chain_summary(links: DataFrame) -> DataFrame:
    """(target, links, factor): the length of each chain, and the product of all its factors."""
    factors = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("place", "factor"))), lambda s: s["factor"]), F.lit(1.0), lambda a, x: a * x)
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("links"), factors.alias("factor"))


def propagate(importance: DataFrame, edges: DataFrame, normalise: bool = True) -> DataFrame:
    """(id, value, propagated, delta, sources): each entity's importance, blended with what comes over its edges.

    importance: id, value. edges: as cross_edges makes them. An edge brings its source's importance to its target, and
    half as much back. All edges of an entity count in the mean, those from entities that are unknown or of no
    importance with nothing; sources: how many brought something. With normalise the greatest result becomes 1. A hub's
    edges are summed before the shuffle.
    """
    worth = importance.select(F.col("id").alias("other"), F.col("value").alias("_v"))
    let = damping() * F.col("weight") * F.col("confidence")
    inward = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), (let * FORWARD).alias("_w"))
    outward = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), (let * BACKWARD * (1 - FORWARD)).alias("_w"))
    counts = F.coalesce(F.col("_v") >= LEAST_IMPORTANCE, F.lit(False))
    came = inward.unionByName(outward).join(worth, "other", "left").groupBy("id").agg(F.sum(F.when(counts, F.col("_w") * F.col("_v")).otherwise(0.0)).alias("_sum"), F.count(F.lit(1)).alias("_edges"), F.count(F.when(counts, 1)).alias("sources"))
    joined = importance.join(came, "id", "left")
    mean = F.coalesce(F.col("_sum") / F.greatest(F.lit(1.0), F.col("_edges") * 0.5), F.lit(0.0))
    blended = joined.select("id", "value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), OWN * F.col("value") + (1 - OWN) * mean)).alias("propagated"), F.coalesce("sources", F.lit(0)).alias("sources"))
    if normalise:
        most = blended.agg(F.max("propagated").alias("_most"))
        blended = blended.crossJoin(F.broadcast(most)).withColumn("propagated", F.when(F.col("_most") > 0, F.col("propagated") / F.col("_most")).otherwise(F.col("propagated"))).drop("_most")
    return blended.select("id", "value", "propagated", (F.col("propagated") - F.col("value")).alias("delta"), "sources")


def propagate_batch(importance: DataFrame, edges: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: entities, with_influence, mean_delta, max_delta, critical_risks, high_risks, over what propagate gives.

    claims: load, confidence, vulnerability, for the risks of claims.
    """
    size = F.abs("delta")
    sums = propagate(importance, edges).agg(F.count(F.lit(1)).alias("entities"), F.count(F.when(F.col("sources") > 0, 1)).alias("with_influence"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_delta"), F.coalesce(F.max(size), F.lit(0.0)).alias("max_delta"))
    level = risk_level(epistemic_risk("load", "confidence", "vulnerability"))
    risks = claims.select(level.alias("level")).agg(F.count(F.when(F.col("level") == "critical", 1)).alias("critical_risks"), F.count(F.when(F.col("level") == "high", 1)).alias("high_risks"))
    return sums.crossJoin(risks)
