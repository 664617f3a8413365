"""Composite analyses on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import graph as G
from loomstone.operators import insights as I
from loomstone.operators import memory as M
from loomstone.plans.registry import query


def r6(c):
    return F.round(c, 6)


ARGUMENTS = "WITH a AS (SELECT l_orderkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 'supports' WHEN 'A' THEN 'warrants' ELSE 'contradicts' END AS kind, l_quantity / 50 AS weight, 1 - l_discount AS confidence FROM lineitem) "


def arguments(t):
    flag = F.col("l_returnflag")
    return t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(flag == "R", "supports").when(flag == "A", "warrants").otherwise("contradicts").alias("kind"), (F.col("l_quantity") / 50).alias("weight"), (1 - F.col("l_discount")).alias("confidence"))


@query("argument_support", ARGUMENTS + "SELECT dst AS id, COUNT(*) AS n, round(avg(weight), 6) AS strength, round(least(0.95, avg(confidence) * (1 + log10(COUNT(*) + 1) * 0.1)), 6) AS confidence FROM a WHERE kind IN ('supports', 'warrants') GROUP BY 1")
def _(t):
    return I.support(arguments(t)).select("id", "n", r6("strength").alias("strength"), r6("confidence").alias("confidence"))


@query("argument_conflicts", ARGUMENTS + "SELECT dst AS id, COUNT(*) AS n, CASE WHEN COUNT(*) >= 3 AND avg(weight) >= 0.8 THEN 'critical' WHEN COUNT(*) >= 2 OR avg(weight) >= 0.7 THEN 'high' WHEN avg(weight) >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM a WHERE kind = 'contradicts' GROUP BY 1")
def _(t):
    return I.conflict(arguments(t))


@query("change_impact_scores", "SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, round(CASE WHEN l_linenumber <= 1 THEN 1.0 ELSE greatest(0.25, 1 / (l_linenumber + 0.5)) END + CASE WHEN l_returnflag = 'R' THEN 0.12 ELSE 0 END + least(0.35, l_discount * 0.35), 4))) AS score FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", I.change_impact("l_linenumber", F.col("l_returnflag") == "R", F.col("l_discount")).alias("score"))


@query("package_distance", "WITH e AS (SELECT o_custkey % 40 AS src, o_orderkey % 40 AS dst FROM orders WHERE o_custkey % 40 <> o_orderkey % 40), c AS (SELECT id, SUM(i)::BIGINT AS ca, SUM(o)::BIGINT AS ce, SUM(o) / (SUM(i) + SUM(o)) AS instability FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1) SELECT id, ca, ce, round(instability, 6) AS instability, id % 5 / 4.0 AS abstractness, round(abs(id % 5 / 4.0 + instability - 1), 6) AS distance FROM c")
def _(t):
    e = t.orders.select((F.col("o_custkey") % 40).alias("src"), (F.col("o_orderkey") % 40).alias("dst"))
    a = t.spark.range(40).select("id", (F.col("id") % 5 / 4.0).alias("abstractness"))
    return I.package_metrics(e, a).withColumns({"instability": r6("instability"), "distance": r6("distance")})


@query("complexity_distribution", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 50 THEN 'medium' ELSE 'high' END AS band, COUNT(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return I.complexity_bands(t.lineitem.select(F.lit(0).alias("start"), F.col("l_quantity").cast("int").alias("stop")))


@query("edge_aggregation_boost", "WITH e AS (SELECT o_custkey AS src, o_orderkey % 500 AS dst, o_orderkey % 11 / 10.0 AS confidence FROM orders), b AS (SELECT dst AS id, confidence AS i, NULL AS o FROM e UNION ALL SELECT src, NULL, confidence FROM e) SELECT id, round(least(0.12, CASE WHEN COUNT(i) > 0 THEN least(0.05, greatest(0, (avg(i) - 0.5) * 0.125)) ELSE 0 END + CASE WHEN COUNT(o) > 0 THEN least(0.04, greatest(0, (avg(o) - 0.5) * 0.1)) ELSE 0 END + CASE WHEN COUNT(*) >= 3 THEN least(0.03, COUNT(*) * 0.005) ELSE 0 END), 6) AS boost FROM b GROUP BY 1")
def _(t):
    e = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 500).alias("dst"), (F.col("o_orderkey") % 11 / 10.0).alias("confidence"))
    return I.edge_boost(e).withColumn("boost", r6("boost"))


@query("feedback_loops", "WITH k AS (SELECT s_suppkey AS id, s_suppkey - s_suppkey % 4 AS c FROM supplier) SELECT c AS component, COUNT(*) AS size, round(1.0 / (COUNT(*) - 1), 6) AS density, CASE WHEN COUNT(*) = 2 THEN 'mutual_recursion' WHEN 1.0 / (COUNT(*) - 1) > 0.7 THEN 'state_cycle' ELSE 'circular_import' END AS kind FROM k GROUP BY c HAVING COUNT(*) = 4")
def _(t):
    k = F.col("s_suppkey")
    ring = t.supplier.select(k.alias("src"), F.when(k % 4 == 3, k - 3).otherwise(k + 1).alias("dst"))
    ring = ring.join(t.supplier.select(k.alias("dst")), "dst", "left_semi").select("src", "dst")
    return I.feedback_loops(G.strong_components(ring), ring).withColumn("density", r6("density"))


@query("memory_search")
def _(t):
    now = t.events.agg(F.max("ts").cast("timestamp").alias("now")).first()["now"]
    facts = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.lit(0.8).alias("confidence"), (F.col("turn") == 0).alias("evergreen"), (F.lit(now) - F.make_interval(days=(F.col("conv_id") % 60).cast("int"))).alias("updated"))
    return I.search_facts(facts, "the thing of that", F.lit(now))


@query("metric_vectors", "WITH m AS (SELECT l_partkey AS id, COUNT(*) AS a, SUM(l_quantity) AS b FROM lineitem GROUP BY 1) SELECT id, [round(a / max(a) OVER (), 6), round(b / max(b) OVER (), 6)] AS vector FROM m")
def _(t):
    m = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("a"), F.sum("l_quantity").alias("b"))
    return I.metric_vectors(m, ["a", "b"]).select("id", F.transform("vector", r6).alias("vector"))


#: The graph of orders; customers without any are isolated, lines tell how sure and steady the system is, loops and hubs how coupled.
HEALTH = """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, o_orderkey % 1500 AS dst FROM orders WHERE o_custkey <> o_orderkey % 1500),
n AS (SELECT o_custkey AS id FROM orders UNION SELECT o_orderkey % 1500 FROM orders),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
g AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY dst)) AS max_in,
  (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT id FROM n)) AS isolated, (SELECT count(*) FROM r WHERE src = dst) AS looped,
  (SELECT avg(1 - l_discount) FROM lineitem) AS sure, (SELECT avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) FROM lineitem) AS steady),
p AS (SELECT *, (greatest(0.0, 1 - edges / (nodes * (nodes - 1))) + (1 - isolated / greatest(1, nodes)) + greatest(0.0, 1 - edges / nodes / 20)) / 3 AS structural, (1 - looped / nodes) * (1 - least(1.0, max_in / nodes)) AS coupling FROM g),
s AS (SELECT *, round(25 * (structural + sure + steady + coupling)) AS score FROM p)
SELECT round(100 * structural) AS structural, round(100 * sure) AS confidence, round(100 * steady) AS stability, round(100 * coupling) AS coupling, score,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s"""


@query("system_health", HEALTH)
def _(t):
    e = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1500).alias("dst"))
    isolated = t.customer.join(G.nodes(e), F.col("c_custkey") == F.col("id"), "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    lines = t.lineitem.agg(F.avg(1 - F.col("l_discount")).alias("sure"), F.avg((F.col("l_returnflag") != "R").cast("double")).alias("steady"))
    loops = G.strong_components(e).agg(F.count(F.when(F.col("size") > 1, 1)).alias("looped"))
    rows = G.graph_summary(e).crossJoin(isolated).crossJoin(lines).crossJoin(loops)  # one row each
    hubs = F.least(F.lit(1.0), F.col("max_in") / F.col("nodes"))
    return I.health_report(rows, "isolated", F.col("sure"), F.col("steady"), F.col("looped") / F.col("nodes"), hubs)



def written(t):
    facts = t.conversations.select((F.col("conv_id") % 16).alias("scope"), "conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return M.write_facts(facts, "scope", ["conv_id", "turn"], "id", "text")


@query("memory_writes")
def _(t):
    return written(t)


@query("memory_facts_after")
def _(t):
    return M.facts_after(written(t), "scope", ["conv_id", "turn"])
