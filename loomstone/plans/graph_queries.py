"""Graph analytics on graphs of the driver's tables, and the flagship plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import aggregates as A
from loomstone.operators import graph as G
from loomstone.operators import ranking as R
from loomstone.plans.registry import query


def r6(c):
    return F.round(c, 6)


#: A directed graph of customers by order keys: every customer of orders points to the customer numbered by the order.
EDGES = "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7 + o_custkey) % 1500 AS dst FROM orders WHERE o_custkey <> (o_orderkey * 7 + o_custkey) % 1500) "


def edges(t):
    return t.orders.select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 1500).alias("dst")).where("src <> dst").distinct()


#: Each part points to a part of about half its number: no cycles.
TREE = "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey <> p_partkey // 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey <> p_partkey // 3) "


def tree(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("src"), F.floor(k / 2).alias("dst")).union(t.part.select(k, F.floor(k / 3))).where("src <> dst").distinct()


def start(t, *ids):
    return t.spark.createDataFrame([(i,) for i in ids], "id long")


@query("graph_degree_stats", EDGES + ", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src AS id, COUNT(*) AS c FROM e GROUP BY 1), i AS (SELECT dst AS id, COUNT(*) AS c FROM e GROUP BY 1) SELECT id, COALESCE(i.c, 0) AS indegree, COALESCE(o.c, 0) AS outdegree, CASE WHEN i.c IS NULL THEN 'root' WHEN o.c IS NULL THEN 'leaf' ELSE 'inner' END AS role FROM n LEFT JOIN o USING (id) LEFT JOIN i USING (id)")
def _(t):
    return G.degrees(edges(t))


@query("graph_density", EDGES + ", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT (SELECT COUNT(*) FROM n) AS nodes, COUNT(*) AS edges, round(COUNT(*) / ((SELECT COUNT(*) FROM n) * ((SELECT COUNT(*) FROM n) - 1)), 9) AS density, round(COUNT(*) / (SELECT COUNT(*) FROM n), 6) AS mean_degree, (SELECT max(c) FROM (SELECT COUNT(*) AS c FROM e GROUP BY dst)) AS max_in, (SELECT max(c) FROM (SELECT COUNT(*) AS c FROM e GROUP BY src)) AS max_out FROM e")
def _(t):
    return G.graph_summary(edges(t)).withColumns({"density": F.round("density", 9), "mean_degree": r6("mean_degree")})


BFS = ", b AS (SELECT CAST({s} AS BIGINT) AS id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM b JOIN e ON e.src = b.id WHERE depth < {d}) "


@query("graph_khop", EDGES + BFS.format(s=7, d=2) + "SELECT CAST(7 AS BIGINT) AS root, id, min(depth) AS depth FROM b GROUP BY id")
def _(t):
    return G.reach(edges(t), start(t, 7), 2)


@query("graph_closure", TREE + BFS.format(s=1999, d=30) + "SELECT DISTINCT id FROM b WHERE depth > 0")
def _(t):
    return G.reach(tree(t), start(t, 1999), 30, keep_start=False).select("id")


@query("exhaustive_dependents", TREE + ", b AS (SELECT CAST(10 AS BIGINT) AS id, 0 AS depth UNION SELECT e.src, depth + 1 FROM b JOIN e ON e.dst = b.id) SELECT id, min(depth) AS depth FROM b WHERE depth > 0 AND id <> 10 GROUP BY id")
def _(t):
    return G.reach(G.reverse(tree(t)), start(t, 10), keep_start=False).select("id", "depth")


@query("undirected_expansion", TREE + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), b AS (SELECT CAST(40 AS BIGINT) AS id, 0 AS depth UNION SELECT u.dst, depth + 1 FROM b JOIN u ON u.src = b.id WHERE depth < 2) SELECT DISTINCT id FROM b")
def _(t):
    return G.reach(G.both_ways(tree(t)), start(t, 40), 2).select("id")


@query("graph_shortest_path", TREE + ", b AS (SELECT [CAST(1999 AS BIGINT)] AS path UNION ALL SELECT list_append(path, e.dst) FROM b JOIN e ON e.src = path[-1] WHERE len(path) < 12 AND path[-1] <> 3) SELECT path FROM b WHERE path[-1] = 3 ORDER BY len(path), path LIMIT 1")
def _(t):
    return G.shortest_path(tree(t), 1999, 3)


@query("graph_cycles_short", EDGES + "SELECT [a.src, a.dst] AS cycle FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT [a.src, a.dst, b.dst] FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst")
def _(t):
    return G.cycles(edges(t), 3)


@query("graph_scc", "WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS src, CASE WHEN s_suppkey % 5 = 4 THEN s_suppkey - 4 ELSE s_suppkey + 1 END AS dst FROM supplier), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS (SELECT id, least(id, COALESCE((SELECT min(a.dst) FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src = id), id)) AS component FROM n) SELECT id, component, COUNT(*) OVER (PARTITION BY component) AS size FROM c")
def _(t):
    k = F.col("s_suppkey")
    return G.strong_components(t.supplier.select(k.alias("src"), F.when(k % 5 == 4, k - 4).otherwise(k + 1).alias("dst")))


def _sweeps(n: int) -> str:
    parts = ["n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)", "c AS (SELECT COUNT(*) AS n FROM n)", "l AS (SELECT src, dst, COUNT(*) OVER (PARTITION BY src) AS o FROM e)", "r0 AS (SELECT id, 1.0 / c.n AS r FROM n, c)"]
    for i in range(n):
        parts.append(f"r{i + 1} AS (SELECT n.id, 0.15 / c.n + 0.85 * COALESCE(g.s, 0) AS r FROM n CROSS JOIN c LEFT JOIN (SELECT dst, SUM(r / o) AS s FROM l JOIN r{i} ON id = src GROUP BY dst) g ON g.dst = n.id)")
    return ", " + ", ".join(parts) + f" SELECT id, round(r, 9) AS rank FROM r{n}"


@query("pagerank_k5", EDGES + _sweeps(5))
def _(t):
    return G.pagerank(edges(t), rounds=5, tolerance=0).withColumn("rank", F.round("rank", 9))


@query("eigenvector_centrality")
def _(t):
    return G.eigenvector(edges(t))


@query("closeness_bounded", TREE + ", b AS (SELECT src AS root, src AS id, 0 AS depth FROM (SELECT src FROM e UNION SELECT dst FROM e) UNION SELECT root, e.dst, depth + 1 FROM b JOIN e ON e.src = b.id WHERE depth < 4), m AS (SELECT root, id, min(depth) AS depth FROM b GROUP BY 1, 2) SELECT root AS id, round(CASE WHEN COUNT(*) > 1 THEN (COUNT(*) - 1) / SUM(depth) ELSE 0.0 END, 6) AS closeness FROM m GROUP BY root")
def _(t):
    return G.closeness(tree(t), 4).withColumn("closeness", r6("closeness"))


@query("betweenness")
def _(t):
    return G.betweenness_joins(tree(t))


@query("communities")
def _(t):
    return G.communities(tree(t))


@query("impact_bfs_decay", TREE + BFS.format(s=1500, d=3) + ", m AS (SELECT id, min(depth) AS depth FROM b GROUP BY id) SELECT id, depth, round(pow(0.7, depth), 6) AS score FROM m WHERE depth > 0")
def _(t):
    return G.reach(tree(t), start(t, 1500), 3, keep_start=False).select("id", "depth", r6(F.pow(F.lit(0.7), F.col("depth"))).alias("score"))


@query("cascade_risk", TREE + ", w AS (SELECT src, dst, 0.5 + src % 5 / 10.0 AS w FROM e), b AS (SELECT CAST(6 AS BIGINT) AS id, CAST(1.0 AS DOUBLE) AS v, 0 AS depth UNION ALL SELECT w.src, b.v * 0.8 * w.w, depth + 1 FROM b JOIN w ON w.dst = b.id WHERE depth < 3 AND b.v * 0.8 * w.w >= 0.01) SELECT id, round(max(v), 6) AS value FROM b WHERE id <> 6 GROUP BY id")
def _(t):
    w = tree(t).withColumn("w", 0.5 + F.col("src") % 5 / 10.0)
    return G.spread(w, start(t, 6), lambda v, w: v * 0.8 * w, 3, 0.01, incoming=True).select("id", r6("value").alias("value"))


@query("blast_radius", TREE + ", w AS (SELECT src, dst, 0.5 + src % 5 / 10.0 AS w FROM e), b AS (SELECT CAST(6 AS BIGINT) AS id, CAST(1.0 AS DOUBLE) AS v, 0 AS depth UNION ALL SELECT w.src, b.v * 0.8 * w.w, depth + 1 FROM b JOIN w ON w.dst = b.id WHERE depth < 3 AND b.v * 0.8 * w.w >= 0.01), m AS (SELECT id, max(v) AS v FROM b WHERE id <> 6 GROUP BY id) SELECT COUNT(*) AS affected, round(SUM(v), 6) AS total, SUM(v) > 2 OR COUNT(*) > 10 AS high FROM m")
def _(t):
    w = tree(t).withColumn("w", 0.5 + F.col("src") % 5 / 10.0)
    s = G.spread(w, start(t, 6), lambda v, w: v * 0.8 * w, 3, 0.01, incoming=True)
    return s.agg(F.count(F.lit(1)).alias("affected"), r6(F.sum("value")).alias("total"), ((F.sum("value") > 2) | (F.count(F.lit(1)) > 10)).alias("high"))


VALUES = ", v AS (SELECT p_partkey AS id, p_size / 50.0 AS value FROM part) "


def values(t):
    return t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("value"))


@query("confidence_propagation", TREE + VALUES + "SELECT v.id, round(CASE WHEN m.m IS NULL THEN v.value ELSE 0.7 * v.value + 0.3 * m.m END, 6) AS value FROM v LEFT JOIN (SELECT src, avg(value) AS m FROM e JOIN v ON v.id = dst GROUP BY src) m ON m.src = v.id")
def _(t):
    return G.one_hop_mean(tree(t), values(t)).withColumn("value", r6("value"))


@query("risk_one_hop", TREE + VALUES + ", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT n.id, COALESCE(value, 0.5) AS value FROM n LEFT JOIN v USING (id)) SELECT o.id, round(greatest(o.value, COALESCE(m, 0)), 6) AS risk FROM o LEFT JOIN (SELECT src, 0.7 * max(value) AS m FROM e JOIN o ON o.id = dst WHERE value > 0.3 GROUP BY src) x ON x.src = o.id")
def _(t):
    return G.one_hop_risk(tree(t), values(t)).withColumn("risk", r6("risk"))


@query("cross_graph_influence", "WITH e AS (SELECT l_partkey AS src, l_suppkey + 100000 AS dst, CASE l_returnflag WHEN 'R' THEN 'tests' WHEN 'A' THEN 'documents' ELSE 'other' END AS kind, l_discount * 10 AS weight FROM lineitem), i AS (SELECT p_partkey AS id, p_size / 50.0 AS v FROM part), d AS (SELECT *, weight * CASE kind WHEN 'tests' THEN 0.9 WHEN 'documents' THEN 0.8 ELSE 0.5 END AS w FROM e), b AS (SELECT dst AS id, src AS other, w, 1 AS inward FROM d UNION ALL SELECT src, dst, w * 0.5, 0 FROM d) SELECT b.id, round(least(1.0, (0.7 * SUM(CASE WHEN inward = 1 THEN w * COALESCE(v, 0) ELSE 0 END) + 0.3 * SUM(CASE WHEN inward = 0 THEN w * COALESCE(v, 0) ELSE 0 END)) / greatest(1.0, 0.5 * COUNT(*))), 6) AS influence FROM b LEFT JOIN i ON i.id = other GROUP BY b.id")
def _(t):
    flag = F.col("l_returnflag")
    e = t.lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 100000).alias("dst"), F.when(flag == "R", "tests").when(flag == "A", "documents").otherwise("other").alias("kind"), (F.col("l_discount") * 10).alias("weight"), F.lit(1.0).alias("confidence"))
    return G.cross_influence(e, values(t)).withColumn("influence", r6("influence"))


@query("union_edges_filtered", "WITH a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 'uses' AS kind, 0.9 AS weight FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_partkey AS src, l_suppkey AS dst, 'uses' AS kind, max(l_discount) AS weight FROM lineitem GROUP BY 1, 2), u AS (SELECT *, 0 AS p FROM a UNION ALL SELECT *, 1 FROM b) SELECT src, dst, kind, round(arg_min(weight, p), 6) AS weight FROM u WHERE weight >= 0.05 GROUP BY 1, 2, 3")
def _(t):
    key = [F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")]
    a = t.lineitem.where("l_linenumber = 1").select(*key).distinct().select("src", "dst", F.lit("uses").alias("kind"), F.lit(0.9).alias("weight"), F.lit(1.0).alias("confidence"))
    b = t.lineitem.groupBy(*key).agg(F.max("l_discount").alias("weight")).select("src", "dst", F.lit("uses").alias("kind"), "weight", F.lit(1.0).alias("confidence"))
    return G.knowledge_edges([a, b], 0.05).select("src", "dst", "kind", r6("weight").alias("weight"))


@query("intervention", EDGES + "SELECT src, dst FROM e WHERE dst <> 7")
def _(t):
    return G.without_incoming(edges(t), 7)


def flagship(t):
    """Files that change together, weighed by hotspot and owner: co-change, ownership and top-k in one plan."""
    lines = t.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), "l_quantity")
    partners = A.partners(t.lineitem.select("l_orderkey", F.col("l_partkey").alias("file")), "l_orderkey", "file")
    own = A.primary_owner(A.ownership(lines, "file", "author", "l_quantity"), "file", "author")
    hot = A.by_author(lines, "file", "author", F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).groupBy("file").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    score = r6(F.pow(F.least(F.lit(1.0), F.col("n") / 100), F.lit(0.7)) * F.pow(F.least(F.lit(1.0), F.col("q") / 2000), F.lit(0.5)) * F.log2(1 + F.col("partners")))
    joined = hot.join(partners, "file").join(own, "file").withColumn("score", score)
    return R.top(joined, "score", 20, "file").select("file", "owner", "contributors", "partners", "together", "score")


@query("flagship_hotspots", "WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT a.l_partkey AS a, b.l_partkey AS b, COUNT(*) AS together FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2), u AS (SELECT file, SUM(together)::BIGINT AS together, COUNT(*) AS partners FROM (SELECT a AS file, together FROM p UNION ALL SELECT b, together FROM p) GROUP BY 1), s AS (SELECT l_partkey AS file, l_suppkey AS author, SUM(l_quantity) / SUM(SUM(l_quantity)) OVER (PARTITION BY l_partkey) AS share FROM lineitem GROUP BY 1, 2), w AS (SELECT file, arg_min(author, (-share, author)) AS owner, COUNT(CASE WHEN share >= 0.1 THEN 1 END) AS contributors FROM s WHERE share >= 0.05 GROUP BY 1), h AS (SELECT l_partkey AS file, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT file, owner, contributors, partners, together, round(pow(least(1.0, n / 100.0), 0.7) * pow(least(1.0, q / 2000.0), 0.5) * log2(1 + partners), 6) AS score FROM h JOIN u USING (file) JOIN w USING (file) ORDER BY round(pow(least(1.0, n / 100.0), 0.7) * pow(least(1.0, q / 2000.0), 0.5) * log2(1 + partners), 6) DESC, file LIMIT 20")
def _(t):
    return flagship(t)
