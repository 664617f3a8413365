"""Importance of entities in the code, rationale, epistemic and organisation graphs, and over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.scores import clamp01

#: Weights of the graphs, thresholds of the flags, how far a decision of each status counts.
WEIGHTS = {"code": 0.3, "rationale": 0.2, "epistemic": 0.25, "org": 0.1, "cross_graph": 0.15}
THRESHOLDS = {"load_bearing": 0.7, "foundational": 0.7, "at_risk": 0.6, "needs_validation": 0.5, "truck_factor": 0.8, "hotspot": 0.5}
ACTIVITY = {"accepted": 1.0, "proposed": 0.5, "deprecated": 0.3, "superseded": 0.0}


def code_importance(page_rank: Column, centrality: Column, hotspot: Column) -> Column:
    """Shares of the greatest page rank and centrality, and the hotspot score (0.5 where there is none)."""
    return 0.4 * page_rank + 0.3 * centrality + 0.3 * F.coalesce(hotspot, F.lit(0.5))


def rationale_importance(foundationality: Column, status: Column, tradeoffs: Column, constraints: Column) -> Column:
    """A decision without a status is accepted; five tradeoffs and ten constraints are the most that count."""
    active = F.coalesce(status, F.lit("accepted"))
    activity = F.coalesce(*[F.when(active == name, F.lit(share)) for name, share in ACTIVITY.items()])
    return 0.5 * foundationality * activity + 0.3 * F.least(F.lit(1.0), tradeoffs / 5) + 0.2 * F.least(F.lit(1.0), constraints / 10)


def defeater_vulnerability(active: Column, pending: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 * active + 0.1 * pending)


def epistemic_importance(load: Column, depth: Column, vulnerability: Column, blocking: Column) -> Column:
    """Shares of the greatest load and evidence depth; blocking contradictions take up to half."""
    return clamp01(load * depth * (1 - vulnerability) / (1 + F.least(F.lit(1.0), 0.5 * blocking)))


def org_importance(authorship: DataFrame, entity: str, author: str, weight: str, expertise: Column, reviews: DataFrame | None = None) -> DataFrame:
    """(entity, concentration, expertise, coverage, importance) from a row for each author of an entity.

    concentration: 1 less the entropy of the authors' weights over its maximum, 1 for a single author or no weight.
    expertise: a column of authorship, 0.5 where null. reviews: rows with the entity; five are the most that count.
    """
    total = F.sum(weight)
    # The entropy from sums that combine before the shuffle: log2 W - (sum of w log2 w) / W.
    parts = authorship.groupBy(entity).agg(
        total.alias("_w"),
        F.sum(F.when(F.col(weight) > 0, F.col(weight) * F.log2(weight)).otherwise(0.0)).alias("_wl"),
        F.count(F.lit(1)).alias("_n"),
        F.least(F.lit(1.0), F.sum(F.col(weight) * F.coalesce(expertise, F.lit(0.5)))).alias("expertise"),
    )
    entropy = F.log2("_w") - F.col("_wl") / F.col("_w")
    alone = (F.col("_n") <= 1) | (F.col("_w") == 0)
    parts = parts.withColumn("concentration", F.when(alone, 1.0).otherwise(1 - entropy / F.log2(F.col("_n").cast("double"))))
    if reviews is None:
        parts = parts.withColumn("coverage", F.lit(0.0))
    else:
        counted = reviews.groupBy(entity).agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 5).alias("coverage"))
        parts = parts.join(counted, entity, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    importance = clamp01(0.3 * (1 - F.col("concentration")) + 0.4 * F.col("expertise") + 0.3 * F.col("coverage"))
    return parts.select(entity, "concentration", "expertise", "coverage", importance.alias("importance"))


def unified_importance(weights: dict[str, float] | None = None, **graphs: Column) -> Column:
    """The weighted sum over the graphs named, 0 to 1."""
    weights = weights or WEIGHTS
    return clamp01(sum((weights[g] * c for g, c in graphs.items()), F.lit(0.0)))


def importance_flags(code, rationale, epistemic, foundationality, load, depth, vulnerability, concentration, hotspot, unified, confidence, thresholds: dict[str, float] | None = None) -> dict[str, Column]:
    """One boolean Column for each flag; a null confidence is 1."""
    t = thresholds or THRESHOLDS
    sure = F.coalesce(confidence, F.lit(1.0))
    return {
        "load_bearing": (code >= t["load_bearing"]) | (rationale >= t["load_bearing"]) | (epistemic >= t["load_bearing"]),
        "foundational": (foundationality >= t["foundational"]) | (load >= t["foundational"]),
        "at_risk": (unified >= t["at_risk"]) & (sure < 0.5),
        "needs_validation": (vulnerability >= t["needs_validation"]) | ((depth < 0.3) & (load >= 0.5)),
        "truck_factor_risk": concentration >= t["truck_factor"],
        "hotspot": hotspot >= t["hotspot"],
    }
