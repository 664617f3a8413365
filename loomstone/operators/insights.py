"""Composite analyses: arguments, change impact, health, packages, memory search, arms, code complexity, clusters, loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.functions.scores import banded, clamp01, col

#: Edge types of arguments.
SUPPORT, CONFLICT, DECISION = ["supports", "warrants"], ["contradicts", "undermines", "rebuts"], ["supersedes", "depends_on"]


def edges_of(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.where(F.col("kind").isin(kinds))


def support(edges: DataFrame) -> DataFrame:
    """(id, n, strength, confidence) of incoming supports and warrants: mean weight; min(.95, mean confidence * (1 + .1 log10(n + 1)))."""
    n = F.count(F.lit(1))
    return edges_of(edges, SUPPORT).groupBy(F.col("dst").alias("id")).agg(n.alias("n"), F.avg("weight").alias("strength"), F.least(F.lit(0.95), F.avg("confidence") * (1 + F.log10(n + 1) * 0.1)).alias("confidence"))


def conflict(edges: DataFrame, strict: Column | None = None) -> DataFrame:
    """(id, n, severity) of incoming conflicts: critical for a strict rebuttal or 3 of mean weight .8, high for 2 or .7, medium from .5, else low.

    Means are taken to 12 digits: what is left depends on the order of the sum.
    """
    hard = F.max(F.coalesce((F.col("kind") == "rebuts") & (strict if strict is not None else F.lit(False)), F.lit(False)).cast("int")) == 1
    n, w = F.count(F.lit(1)), F.round(F.avg("weight"), 12)
    severity = F.when(hard | ((n >= 3) & (w >= 0.8)), "critical").when((n >= 2) | (w >= 0.7), "high").when(w >= 0.5, "medium").otherwise("low")
    return edges_of(edges, CONFLICT).groupBy(F.col("dst").alias("id")).agg(n.alias("n"), severity.alias("severity"))


def change_impact(depth: Column | str, is_test: Column, cochange: Column) -> Column:
    """1 for direct, else max(.25, 1 / (depth + .5)); + .12 for a test, + .35 of the co-change weight; within 0 to 1, 4 decimals."""
    d = col(depth)
    decay = F.when(d <= 1, 1.0).otherwise(F.greatest(F.lit(0.25), 1 / (d + 0.5)))
    return clamp01(F.round(decay + F.when(is_test, 0.12).otherwise(0.0) + F.least(F.lit(0.35), F.greatest(F.lit(0.0), F.coalesce(cochange, F.lit(0.0))) * 0.35), 4))


def is_test_path(path: Column | str) -> Column:
    return col(path).rlike(r"(?i)(?:\.test\.|\.spec\.|__tests__|/tests/)")


def health_report(summary: DataFrame, isolated: str, confidence: Column, stability: Column, loop_risk: Column, amplification: Column) -> DataFrame:
    """One row from a graph summary (nodes, density, mean_degree, and `isolated`): four parts of 25 and a grade."""
    structural = (F.greatest(F.lit(0.0), 1 - F.col("density")) + (1 - F.col(isolated) / F.greatest(F.lit(1), F.col("nodes"))) + F.greatest(F.lit(0.0), 1 - F.col("mean_degree") / 20)) / 3
    coupling = (1 - loop_risk) * (1 - amplification)
    score = F.round(25 * (structural + confidence + stability + coupling))
    return summary.select(F.round(100 * structural).alias("structural"), F.round(100 * confidence).alias("confidence"), F.round(100 * stability).alias("stability"), F.round(100 * coupling).alias("coupling"), score.alias("score"), banded(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F").alias("grade"))


def package_metrics(edges: DataFrame, abstractness: DataFrame) -> DataFrame:
    """(id, ca, ce, instability, abstractness, distance): |a + i - 1| per package, over edges between packages and (id, abstractness)."""
    from loomstone.operators.aggregates import coupling

    c = coupling(edges.where("src <> dst"))
    out = c.join(abstractness, "id", "left").withColumn("abstractness", F.coalesce("abstractness", F.lit(0.0)))
    return out.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))


def search_facts(facts: DataFrame, question: str, now: Column, half_life_days: float = 30.0, newest: int = 300, limit: int = 10) -> DataFrame:
    """(id, score) over facts (id, content, confidence, evergreen, updated): min(1, .75 (Jaccard + .2 if contained) + .25 confidence) * recency, among the newest 300."""
    q = T.distinct_tokens(F.lit(question))
    recent = facts.orderBy(F.desc("updated"), "id").limit(newest)
    similar = T.jaccard(q, T.distinct_tokens("content")) + F.when(F.lower("content").contains(question.lower().strip()), 0.2).otherwise(0.0)
    days = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("updated")) / 86400)
    recency = F.when(F.col("evergreen"), 1.0).otherwise(F.pow(F.lit(0.5), days / half_life_days))
    scored = recent.withColumn("score", F.least(F.lit(1.0), similar * 0.75 + F.col("confidence") * 0.25) * recency)
    return scored.orderBy(F.desc("score"), F.desc("updated"), "id").limit(limit).select("id", "score")


#: Retrieval strategies.
ARMS = ["hybrid", "semantic", "structural", "keyword", "graph"]


def choose_arm(rewards: DataFrame, intent: str, seed: int = 0) -> tuple[str, dict[str, float]]:
    """Thompson sampling over ARMS: a Beta(s + 1, f + 1) draw each from rewards (intent, arm, success), and the greatest."""
    counts = {r["arm"]: (r["s"], r["f"]) for r in rewards.where(F.col("intent") == intent).groupBy("arm").agg(F.count(F.when(F.col("success"), 1)).alias("s"), F.count(F.when(~F.col("success"), 1)).alias("f")).collect()}
    rng = np.random.default_rng(seed)
    drawn = {a: float(rng.beta(counts.get(a, (0, 0))[0] + 1, counts.get(a, (0, 0))[1] + 1)) for a in ARMS}
    return max(drawn, key=drawn.get), drawn


def complexity_bands(functions: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """(band, n) of line spans: low under 10, medium under 50, high under 100, else critical."""
    lines = F.greatest(F.lit(0), F.col(stop) - F.col(start))
    return functions.groupBy(F.when(lines < 10, "low").when(lines < 50, "medium").when(lines < 100, "high").otherwise("critical").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def edge_boost(edges: DataFrame) -> DataFrame:
    """(id, boost) from edges (src, dst, confidence): .125 of the mean incoming over .5 (.05 at most), .1 of the outgoing (.04), .005 an edge from 3 on (.03); .12 in all."""
    both = edges.select(F.col("dst").alias("id"), F.col("confidence").alias("i"), F.lit(None).cast("double").alias("o")).union(edges.select("src", F.lit(None).cast("double"), "confidence"))
    part = lambda c, f, cap: F.coalesce(F.least(F.lit(cap), F.greatest(F.lit(0.0), (F.avg(c) - 0.5) * f)), F.lit(0.0))
    n = F.count(F.lit(1))
    total = F.when(F.count("i") > 0, part("i", 0.125, 0.05)).otherwise(0.0) + F.when(F.count("o") > 0, part("o", 0.1, 0.04)).otherwise(0.0) + F.when(n >= 3, F.least(F.lit(0.03), n * 0.005)).otherwise(0.0)
    return both.groupBy("id").agg(F.least(F.lit(0.12), total).alias("boost"))


def feedback_loops(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, density, kind) of strong components of 2 or more: two nodes are mutual recursion, density over .7 a state cycle, else a circular import."""
    big = components.where("size > 1")
    inner = edges.select("src", "dst").distinct().join(big.select(F.col("id").alias("src"), F.col("component").alias("_a")), "src").join(big.select(F.col("id").alias("dst"), F.col("component").alias("_b")), "dst").where("_a = _b and src <> dst")
    n = inner.groupBy(F.col("_a").alias("component")).agg(F.count(F.lit(1)).alias("_e"))
    sizes = big.groupBy("component").agg(F.max("size").alias("size"))
    density = F.col("_e") / (F.col("size") * (F.col("size") - 1))
    return sizes.join(n, "component").withColumn("density", density).select("component", "size", "density", F.when(F.col("size") == 2, "mutual_recursion").when(F.col("density") > 0.7, "state_cycle").otherwise("circular_import").alias("kind"))


def clone_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, n, similarity, kind, potential) from members (id, cluster) and pairs (a, b, similarity, kind) within clusters; kind is the most frequent, ties to the lesser."""
    inside = pairs.join(members.select(F.col("id").alias("a"), "cluster"), "a").join(members.select(F.col("id").alias("b"), F.col("cluster").alias("_c")), "b").where("cluster = _c")
    kinds = inside.groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.min_by("kind", F.struct(-F.col("k"), F.col("kind"))).alias("kind"))
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    out = size.join(inside.groupBy("cluster").agg(F.avg("similarity").alias("similarity")), "cluster").join(kinds, "cluster")
    by_kind = F.when(F.col("kind") == "exact", 1.0).when(F.col("kind") == "type1", 0.9).when(F.col("kind") == "type2", 0.7).otherwise(0.5)
    return out.withColumn("potential", 0.3 * F.least(F.lit(1.0), F.col("n") / 5) + 0.4 * F.col("similarity") + 0.3 * by_kind)


def debt_hotspots(debt: DataFrame, centrality: DataFrame, n: int) -> DataFrame:
    """(id, debt, centrality, score): debt times .5 betweenness + .5 closeness, the n greatest."""
    c = centrality.select("id", (0.5 * F.col("betweenness") + 0.5 * F.col("closeness")).alias("centrality"))
    return debt.join(c, "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0))).withColumn("score", F.col("debt") * F.col("centrality")).orderBy(F.desc("score"), "id").limit(n)


def metric_vectors(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(id, vector): each metric over its greatest value."""
    from loomstone.operators.windows import with_totals

    wide = with_totals(metrics, **{f"_{n}": F.max(n) for n in names})
    return wide.select("id", F.array(*[F.col(n) / F.greatest(F.col(f"_{n}"), F.lit(0.001)) for n in names]).alias("vector"))


def bridges(nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, bridge): betweenness at the threshold or more, and fewer neighbours in its community than max(1, floor(degree / 2)). nodes: id, betweenness, degree, inside."""
    return nodes.select("id", ((F.col("betweenness") >= threshold) & (F.col("inside") < F.greatest(F.lit(1), F.floor(F.col("degree") / 2)))).alias("bridge"))
