"""Importance queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import importance as I
from loomstone.plans.registry import query


def r6(c):
    return F.round(c, 6)


PARTS = """
WITH raw AS (
  SELECT p_partkey AS id, p_size / 50.0 AS page_rank, (p_partkey % 11) / 10.0 AS centrality,
         CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 4) / 3.0 END AS hotspot, (p_partkey % 7) / 6.0 AS foundationality,
         ['accepted', 'proposed', 'deprecated', 'superseded'][p_partkey % 4 + 1] AS status, p_partkey % 8 AS tradeoffs, p_size % 13 AS constraints,
         (p_partkey % 5) / 4.0 AS load, (p_size % 6) / 5.0 AS depth, p_partkey % 3 AS active, p_size % 4 AS pending, p_partkey % 2 AS blocking,
         (p_size % 10) / 9.0 AS org, (p_partkey % 9) / 8.0 AS concentration, (p_partkey % 13) / 12.0 AS cross_graph,
         CASE WHEN p_partkey % 3 = 0 THEN (p_size % 5) / 4.0 END AS confidence
  FROM part),
scored AS (
  SELECT *, page_rank * 0.4 + centrality * 0.3 + COALESCE(hotspot, 0.5) * 0.3 AS code,
         foundationality * CASE status WHEN 'proposed' THEN 0.5 WHEN 'deprecated' THEN 0.3 WHEN 'superseded' THEN 0 ELSE 1 END * 0.5
           + CASE WHEN tradeoffs > 5 THEN 1 ELSE tradeoffs / 5.0 END * 0.3 + CASE WHEN constraints > 10 THEN 1 ELSE constraints / 10.0 END * 0.2 AS rationale,
         least(1.0, active * 0.3 + pending * 0.1) AS vulnerability
  FROM raw),
known AS (SELECT *, load * depth * (1 - vulnerability) / (1 + blocking * 0.5) AS epistemic FROM scored),
final AS (
  SELECT *, greatest(0.0, least(1.0, code * 0.3 + rationale * 0.2 + epistemic * 0.25 + org * 0.1 + cross_graph * 0.15)) AS unified FROM known)
"""


def scored_parts(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    statuses = F.array(*[F.lit(x) for x in ("accepted", "proposed", "deprecated", "superseded")])
    raw = t.part.select(
        k.alias("id"), (s / 50).alias("page_rank"), (k % 11 / 10).alias("centrality"), F.when(k % 4 > 0, k % 4 / 3).alias("hotspot"),
        (k % 7 / 6).alias("foundationality"), F.get(statuses, (k % 4).cast("int")).alias("status"), (k % 8).alias("tradeoffs"), (s % 13).alias("constraints"),
        (k % 5 / 4).alias("load"), (s % 6 / 5).alias("depth"), (k % 3).alias("active"), (s % 4).alias("pending"), (k % 2).alias("blocking"),
        (s % 10 / 9).alias("org"), (k % 9 / 8).alias("concentration"), (k % 13 / 12).alias("cross_graph"), F.when(k % 3 == 0, s % 5 / 4).alias("confidence"),
    )
    c = F.col
    scored = raw.withColumns({
        "code": I.code_importance(c("page_rank"), c("centrality"), c("hotspot")),
        "rationale": I.rationale_importance(c("foundationality"), c("status"), c("tradeoffs"), c("constraints")),
        "vulnerability": I.defeater_vulnerability(c("active"), c("pending")),
    })
    scored = scored.withColumn("epistemic", I.epistemic_importance(c("load"), c("depth"), c("vulnerability"), c("blocking")))
    return scored.withColumn("unified", I.unified_importance(**{g: c(g) for g in I.WEIGHTS}))


@query("importance_by_graph", PARTS + "SELECT id, round(code, 6) AS code, round(rationale, 6) AS rationale, round(epistemic, 6) AS epistemic, round(vulnerability, 6) AS vulnerability FROM final")
def _(t):
    return scored_parts(t).select("id", *[r6(x).alias(x) for x in ("code", "rationale", "epistemic", "vulnerability")])


@query("importance_unified", PARTS + "SELECT id, round(unified, 6) AS importance FROM final")
def _(t):
    return scored_parts(t).select("id", r6("unified").alias("importance"))


FLAGS = PARTS + """
SELECT id, greatest(code, rationale, epistemic) >= 0.7 AS load_bearing, greatest(foundationality, load) >= 0.7 AS foundational,
       unified >= 0.6 AND COALESCE(confidence, 1) < 0.5 AS at_risk, vulnerability >= 0.5 OR (depth < 0.3 AND load >= 0.5) AS needs_validation,
       concentration >= 0.8 AS truck_factor_risk, COALESCE(hotspot, 0.5) >= 0.5 AS hotspot
FROM final"""


@query("importance_flags", FLAGS)
def _(t):
    c = {x: F.col(x) for x in "code rationale epistemic foundationality load depth vulnerability concentration unified confidence".split()}
    flags = I.importance_flags(**c, hotspot=F.coalesce("hotspot", F.lit(0.5)))
    return scored_parts(t).select("id", *[f.alias(name) for name, f in flags.items()])


ORG = """
WITH a AS (SELECT l_partkey AS file, l_suppkey AS author, SUM(l_quantity) / SUM(SUM(l_quantity)) OVER (PARTITION BY l_partkey) AS w FROM lineitem GROUP BY 1, 2),
v AS (SELECT l_partkey AS file, least(1.0, COUNT(*) / 5.0) AS coverage FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
e AS (SELECT file, CASE WHEN COUNT(*) = 1 THEN 1.0 ELSE 1 + SUM(w * log2(w)) / log2(COUNT(*)) END AS concentration,
             least(1.0, SUM(w * CASE WHEN author % 3 = 0 THEN 0.5 ELSE (author % 10) / 10.0 END)) AS expertise FROM a GROUP BY 1)
SELECT file, round(concentration, 6) AS concentration, round(expertise, 6) AS expertise, round(COALESCE(coverage, 0), 6) AS coverage,
       round(0.3 * (1 - concentration) + 0.4 * expertise + 0.3 * COALESCE(coverage, 0), 6) AS importance
FROM e LEFT JOIN v USING (file)"""


@query("org_importance", ORG)
def _(t):
    from loomstone.operators.aggregates import ownership

    own = ownership(t.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), "l_quantity"), "file", "author", "l_quantity", least=0.0)
    expertise = F.when(F.col("author") % 3 != 0, F.col("author") % 10 / 10)
    reviews = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("file"))
    out = I.org_importance(own, "file", "author", "share", expertise, reviews)
    # Shares of small whole numbers often end on a half; sums in any order differ in the 16th digit, so those go first.
    return out.select("file", *[r6(F.round(c, 12)).alias(c) for c in ("concentration", "expertise", "coverage", "importance")])
