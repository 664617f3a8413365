"""Queries on debts, priorities and causes, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import debts as D
from loomstone.functions import priorities as P
from loomstone.functions import scores as S
from loomstone.operators import causal, evidence
from loomstone.plans.graph_queries import TREE, start, tree
from loomstone.plans.registry import query


def pick(values, n):
    """The value at place n of a list; null beyond it."""
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


#: Inputs of every kind of debt, by part.
DEBTS = """
WITH raw AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 6 > 0 THEN (p_partkey % 11) / 10.0 END AS coverage, CASE WHEN p_size % 7 > 0 THEN p_size % 5 > 0 END AS tested,
         CASE WHEN p_partkey % 4 > 0 THEN p_name END AS purpose, CASE WHEN p_partkey % 3 > 0 THEN p_type || ' ' || p_name END AS summary,
         CASE WHEN p_partkey % 8 > 0 THEN (p_partkey * 7) % 101 END AS risk,
         p_size % 3 AS n_exact, p_partkey % 2 AS n_renamed, (p_partkey + p_size) % 4 AS n_similar, p_size % 2 AS n_semantic, p_size * 9 AS shared,
         CASE WHEN p_partkey % 5 > 0 THEN p_size % 4 END AS cycle, p_partkey % 7 = 0 AS is_root,
         CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS n_critical, p_partkey % 3 AS n_low
  FROM part),
debts AS (
  SELECT id,
         CASE WHEN NOT COALESCE(tested, FALSE) THEN 50 WHEN coverage IS NULL THEN 25 WHEN coverage < 0.2 THEN 50 WHEN coverage < 0.4 THEN 35 WHEN coverage < 0.6 THEN 20 WHEN coverage < 0.8 THEN 10 ELSE 0 END AS coverage,
         CASE WHEN COALESCE(length(purpose), 0) < 10 THEN 30 ELSE 0 END + CASE WHEN COALESCE(length(summary), 0) < 20 THEN 20 ELSE 0 END AS documentation,
         CASE WHEN risk > 80 THEN 50 WHEN risk > 60 THEN 35 WHEN risk > 40 THEN 20 WHEN risk > 20 THEN 10 ELSE 0 END AS security,
         least(100, CASE WHEN n_exact > 0 THEN 40 ELSE 0 END + CASE WHEN n_renamed > 0 THEN 25 ELSE 0 END + CASE WHEN n_similar > 0 THEN 15 ELSE 0 END
           + CASE WHEN n_semantic > 0 THEN 10 ELSE 0 END + CASE WHEN shared > 200 THEN 10 ELSE 0 END) AS duplication,
         least(100, CASE WHEN cycle > 1 THEN CASE WHEN is_root THEN 50 ELSE 40 END ELSE 0 END + n_critical * 30 + n_low * 5) AS architecture
  FROM raw),
summed AS (SELECT *, coverage * 0.15 + documentation * 0.05 + security * 0.1 + duplication * 0.15 + architecture * 0.15 AS total FROM debts)
"""
#: Weights of these kinds in the total.
WEIGHTS = {"coverage": 0.15, "documentation": 0.05, "security": 0.1, "duplication": 0.15, "architecture": 0.15}


def debts(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    clones = {"exact": size % 3, "renamed": k % 2, "similar": (k + size) % 4, "semantic": size % 2}
    return t.part.select(
        k.alias("id"),
        D.coverage_debt(F.when(k % 6 > 0, k % 11 / 10), F.when(size % 7 > 0, size % 5 > 0)).alias("coverage"),
        D.documentation_debt(F.when(k % 4 > 0, F.col("p_name")), F.when(k % 3 > 0, F.concat("p_type", F.lit(" "), "p_name"))).alias("documentation"),
        D.security_debt(F.when(k % 8 > 0, k * 7 % 101)).alias("security"),
        D.duplication_debt(clones, size * 9).alias("duplication"),
        D.architecture_debt(F.when(k % 5 > 0, size % 4), k % 7 == 0, {"critical": F.when(k % 13 == 0, 1).otherwise(0), "low": k % 3}).alias("architecture"),
    )


@query("debt_by_kind", DEBTS + "SELECT * FROM debts")
def _(t):
    return debts(t)


@query("debt_fix_hours", DEBTS + """
SELECT id, round(total, 6) AS total, round(total / 10 + CASE WHEN architecture > 50 THEN 8 ELSE 0 END + CASE WHEN duplication > 50 THEN 2 ELSE 0 END + CASE WHEN security > 50 THEN 6 ELSE 0 END, 1) AS hours
FROM (SELECT * REPLACE (CAST(total AS DOUBLE) AS total) FROM summed)""")  # fmt: skip
def _(t):
    kinds = {k: F.col(k) for k in WEIGHTS}
    d = debts(t).withColumn("total", S.debt_total(kinds, WEIGHTS))
    return d.select("id", F.round("total", 6).alias("total"), D.fix_hours("total", kinds).alias("hours"))


LEVELS = ["none", "minimal", "low", "medium", "high", "critical", "odd"]
TAGS = ["Security-fix", "gdpr", "ui", "audit-log", "stability", "docs"]
EASES = ["trivial", "simple", "moderate", "complex", "heroic"]

WORK = f"""
WITH work AS (
  SELECT p_partkey AS id, {LEVELS}[p_partkey % 8 + 1] AS level, {LEVELS}[p_size % 8 + 1] AS risk, {EASES}[p_size % 6 + 1] AS ease,
         [{TAGS}[p_partkey % 6 + 1], {TAGS}[p_size % 6 + 1]] AS tags, ['all', 'subset', '5000', '20'][p_partkey % 5 + 1] AS users,
         ['easy', 'difficult', 'irreversible'][p_size % 3 + 1] AS undo, ['debt', 'feature'][p_partkey % 2 + 1] AS kind,
         CASE WHEN p_partkey % 4 > 0 THEN p_size - 4 END AS days, p_size % 3 = 0 AS hard, p_partkey % 4 AS refs,
         CASE WHEN p_partkey % 9 > 0 THEN list_filter([p_partkey % 4, p_size % 4], lambda r: r > 0) END AS ranks
  FROM part)
SELECT id,
  CASE WHEN ranks IS NULL THEN 50 WHEN len(ranks) = 0 THEN 30 ELSE CAST(least(100, 50 + list_sum(list_transform(ranks, lambda r: (4 - r) * 15))) AS BIGINT) END AS alignment,
  round(CAST(CASE WHEN level IS NULL THEN 50 ELSE least(100, COALESCE(MAP {P.IMPACT}[level], 50) * CASE users WHEN 'all' THEN 1.3 WHEN '5000' THEN 1.2 ELSE 1 END
    * CASE WHEN undo = 'easy' THEN 1 ELSE 1.15 END) END AS DOUBLE), 6) AS impact,
  least(100, 30 + 20 * len(list_filter(tags, lambda x: COALESCE(x IN ('Security-fix', 'stability'), FALSE))) + COALESCE(MAP {P.RISK}[risk], 0) + CASE WHEN kind = 'debt' THEN 15 ELSE 0 END) AS risk_reduction,
  round(COALESCE(MAP {P.VALUE}[COALESCE(level, 'medium')], 50) * COALESCE(MAP {P.EASE}[COALESCE(ease, 'moderate')], 50) / 100.0, 6) AS value,
  least(100, CASE WHEN days IS NULL THEN 30 ELSE least(100, CASE WHEN days < 0 THEN 95 WHEN days < 3 THEN 90 WHEN days < 7 THEN 75 WHEN days < 14 THEN 60 ELSE 30 END + CASE WHEN hard THEN 10 ELSE 0 END) END
    + 5 * refs + CASE WHEN len(list_filter(tags, lambda x: x IN ('gdpr', 'audit-log'))) > 0 THEN 20 ELSE 0 END) AS pressure
FROM work
"""


@query("work_factors", WORK)
def _(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    level, risk, tags = pick(LEVELS, k % 8), pick(LEVELS, size % 8), F.array(pick(TAGS, k % 6), pick(TAGS, size % 6))
    ranks = F.when(k % 9 > 0, F.filter(F.array(k % 4, size % 4), lambda r: r > 0))
    return t.part.select(
        k.alias("id"),
        P.strategic_alignment(ranks).alias("alignment"),
        F.round(P.user_impact(level, pick(["all", "subset", "5000", "20"], k % 5), pick(["easy", "difficult", "irreversible"], size % 3)), 6).alias("impact"),
        P.risk_reduction(tags, risk, pick(["debt", "feature"], k % 2)).alias("risk_reduction"),
        F.round(P.effort_value(level, pick(EASES, size % 6)), 6).alias("value"),
        P.external_pressure(F.when(k % 4 > 0, size - 4), size % 3 == 0, k % 4, tags).alias("pressure"),
    )


#: The tree of parts with kinds and strengths of edges.
CAUSAL = TREE + ", k AS (SELECT src, dst, ['causes', 'enables', 'prevents', 'correlates'][src % 4 + 1] AS kind, (src % 10) / 10.0 AS strength FROM e) "


def causal_tree(t):
    return tree(t).select("src", "dst", pick(causal.KINDS, F.col("src") % 4).alias("kind"), (F.col("src") % 10 / 10).alias("strength"))


@query("causal_causes", CAUSAL + """
, b AS (SELECT CAST(3 AS BIGINT) AS id, 0 AS depth UNION SELECT k.src, depth + 1 FROM b JOIN k ON k.dst = b.id WHERE depth < 6 AND kind <> 'correlates' AND strength >= 0.2)
SELECT CAST(3 AS BIGINT) AS root, id, min(depth) AS depth, id NOT IN (SELECT dst FROM k) AS is_first FROM b WHERE id <> 3 GROUP BY id""")  # fmt: skip
def _(t):
    return causal.causes(causal_tree(t), start(t, 3), 6, least=0.2)


@query("causal_effects", CAUSAL + """
, s AS (SELECT unnest([197, 198, 199]) AS root), b AS (SELECT CAST(root AS BIGINT) AS root, CAST(root AS BIGINT) AS id, 0 AS depth FROM s UNION SELECT root, k.dst, depth + 1 FROM b JOIN k ON k.src = b.id WHERE depth < 10)
SELECT root, id, min(depth) AS depth, id NOT IN (SELECT src FROM k) AS is_last FROM b WHERE id <> root GROUP BY root, id""")  # fmt: skip
def _(t):
    return causal.effects(causal_tree(t), start(t, 197, 198, 199), 10)


@query("causal_graph", """
WITH calls AS (SELECT 'f' || o_custkey AS src, 'f' || ((o_orderkey * 7 + o_custkey) % 1500) AS dst FROM orders),
ev AS (SELECT event_id AS seq, 'e' || event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'e' || (event_id + 1 - event_id % 4) END AS cause, 'f' || user_id AS source FROM events),
ends AS (SELECT id AS dst, cause AS src, 1.0 AS strength, seq FROM ev UNION ALL SELECT id, source, 0.9, seq FROM ev),
known AS (SELECT src AS id, CAST(NULL AS BIGINT) AS since FROM calls UNION SELECT dst, NULL FROM calls UNION ALL SELECT id, min(seq) FROM ev GROUP BY id),
every AS (
  SELECT src, dst, 1.0 AS strength FROM calls
  UNION ALL
  SELECT src, dst, strength FROM ends JOIN known ON known.id = ends.src WHERE since IS NULL OR since <= seq)
SELECT src, dst, 'causes' AS kind, CAST(strength AS DOUBLE) AS strength, COUNT(*) AS evidence FROM every GROUP BY src, dst, strength""")  # fmt: skip
def _(t):
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    key, event = F.col("o_custkey"), F.col("event_id")
    calls = t.orders.select(named("f", key).alias("caller"), named("f", (F.col("o_orderkey") * 7 + key) % 1500).alias("callee"))
    cause = F.when(event % 3 == 0, named("e", event + 1 - event % 4))
    events = t.events.select(named("e", event).alias("id"), event.alias("seq"), cause.alias("cause"), named("f", F.col("user_id")).alias("source"))
    return causal.causal_edges(calls, events)


CLAIMS = """
WITH d AS (SELECT event_id, ['rebutting', 'undercutting', 'undermining'][event_id % 3 + 1] AS type, ['active', 'resolved'][user_id % 2 + 1] AS status,
  ['full', 'partial', 'warning'][user_id % 3 + 1] AS severity, [user_id, event_id % 50] AS affected, user_id AS claim_a, event_id % 50 AS claim_b FROM events)
"""


def claims(t):
    k, user = F.col("event_id"), F.col("user_id")
    type_, status = pick(["rebutting", "undercutting", "undermining"], k % 3), pick(["active", "resolved"], user % 2)
    severity = pick(["full", "partial", "warning"], user % 3)
    return t.events.select("event_id", type_.alias("type"), status.alias("status"), severity.alias("severity"), F.array(user, k % 50).alias("affected"), user.alias("claim_a"), (k % 50).alias("claim_b"))


@query("defeater_scan", CLAIMS + "SELECT event_id, type, severity FROM d WHERE status = 'active' AND type = 'undercutting' AND list_contains(affected, 7)")
def _(t):
    return evidence.defeaters(claims(t), type="undercutting", status="active", claim=7).select("event_id", "type", "severity")


@query("contradiction_scan", CLAIMS + "SELECT event_id, claim_a, claim_b FROM d WHERE severity = 'partial' AND (claim_a = 7 OR claim_b = 7)")
def _(t):
    return evidence.contradictions(claims(t), severity="partial", claim=7).select("event_id", "claim_a", "claim_b")


@query("epistemic_risks", """
WITH r AS (SELECT p_partkey AS id, p_size / 50.0 * (1 - COALESCE(CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 11) / 10.0 END, 0.5)) * (1 + (p_partkey % 5) / 4.0) AS risk FROM part)
SELECT id, round(risk, 6) AS risk, CASE WHEN round(risk, 9) >= 0.8 THEN 'critical' WHEN round(risk, 9) >= 0.6 THEN 'high' WHEN round(risk, 9) >= 0.4 THEN 'medium' ELSE 'low' END AS level
FROM r WHERE round(risk, 9) >= 0.3""")  # fmt: skip
def _(t):
    k = F.col("p_partkey")
    raw = t.part.select(k.alias("id"), (F.col("p_size") / 50).alias("load"), F.when(k % 3 > 0, k % 11 / 10).alias("confidence"), (k % 5 / 4).alias("vulnerability"))
    risk = evidence.epistemic_risk("load", "confidence", "vulnerability")
    # Rounded before it is held against edges: both engines' sums may differ in the last bit.
    return raw.withColumn("risk", F.round(risk, 9)).where(F.col("risk") >= evidence.LEAST_RISK).select("id", F.round("risk", 6).alias("risk"), evidence.risk_level("risk").alias("level"))


@query("progress_trend", """
WITH s AS (SELECT user_id, value / 100 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events WHERE value IS NOT NULL),
l AS (SELECT user_id, COUNT(*) AS periods, regr_slope(y, x) AS slope, regr_r2(y, x) AS fit, min(y) AS low, max(y) AS high FROM s GROUP BY user_id)
SELECT user_id, CASE WHEN periods = 1 THEN CASE WHEN low > 0 THEN 'improving' ELSE 'stable' END WHEN slope > 0.05 THEN 'improving' WHEN slope < -0.05 THEN 'declining' ELSE 'stable' END AS trend,
  round(CASE WHEN periods = 1 THEN low ELSE slope END, 6) AS rate, periods,
  round(CASE WHEN periods = 1 THEN 0.1 WHEN low = high THEN 0 ELSE least(1.0, sqrt(fit) * least(1.0, periods / 10)) END, 6) AS confidence FROM l""")  # fmt: skip
def _(t):
    scored = t.events.withColumn("y", F.col("value") / 100)
    out = evidence.progress_trend(scored, ["user_id"], ["ts", "event_id"], "y")
    return out.withColumns({"rate": F.round("rate", 6), "confidence": F.round("confidence", 6)})


@query("calibration_trend", """
WITH r AS (SELECT user_id, value / 100 AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS samples FROM r WHERE n <= 5),
h AS (SELECT user_id, max(samples) AS samples, avg(e) FILTER (n > samples // 2) - avg(e) FILTER (n <= samples // 2) AS better FROM c GROUP BY user_id)
SELECT user_id, CASE WHEN better > 0.02 THEN 'improving' WHEN better < -0.02 THEN 'degrading' ELSE 'stable' END AS trend, samples FROM h""")  # fmt: skip
def _(t):
    return evidence.calibration_trend(t.events.withColumn("e", F.col("value") / 100), ["user_id"], [F.desc("ts"), F.desc("event_id")], "e")
