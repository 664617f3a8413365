"""Scans, filters, joins and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import scores
from loomstone.operators import joins, ranking, scans
from loomstone.plans.registry import query
from loomstone.tables import append_new, delete_where, upsert


def symbols(t):
    """Parts as symbols: name, kind (type), file (brand), line (size)."""
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), (F.col("p_partkey") % 2 == 0).alias("exported"))


def ledger(t):
    return t.events.select("event_id", "ts", F.col("user_id").alias("session"), F.col("event_type").alias("kind"), "value", "props")


SYMBOLS = "WITH s AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS file, p_size AS line, p_partkey % 2 = 0 AS exported FROM part) "


@query("symbol_exact", SYMBOLS + "SELECT * FROM s WHERE name = (SELECT min(name) FROM s)")
def _(t):
    s = symbols(t)
    return scans.find_symbols(s, name=s.agg(F.min("name")).first()[0])


@query("symbol_ignore_case", SYMBOLS + "SELECT * FROM s WHERE lower(name) = lower((SELECT max(name) FROM s))")
def _(t):
    s = symbols(t)
    return scans.find_symbols(s, name=s.agg(F.upper(F.max("name"))).first()[0], ignore_case=True)


@query("symbol_by_kind_and_file", SYMBOLS + "SELECT * FROM s WHERE kind = (SELECT min(kind) FROM s) AND file = (SELECT min(file) FROM s) AND exported")
def _(t):
    s = symbols(t)
    kind, file = s.agg(F.min("kind"), F.min("file")).first()
    return scans.find_symbols(s, kind=kind, file=file, exported=True)


@query("symbol_fuzzy", SYMBOLS + "SELECT * FROM s WHERE lower(name) LIKE '%re%' ORDER BY CASE WHEN lower(name) = 're' THEN 0 ELSE 1 END, length(name), name, file, line LIMIT 50")
def _(t):
    return scans.find_fuzzy(symbols(t), "RE")


@query("symbol_query_limited", SYMBOLS + "SELECT * FROM s WHERE exported AND lower(name) LIKE '%e%' ORDER BY name, file, line LIMIT 25")
def _(t):
    return scans.find_symbols(symbols(t), exported=True, like="%E%", limit=25)


@query("symbol_stats_by_kind", SYMBOLS + "SELECT k.kind, COUNT(s.id) AS n, COUNT(DISTINCT s.file) AS files FROM (SELECT DISTINCT kind FROM s UNION SELECT 'no such kind') k LEFT JOIN s ON s.kind = k.kind GROUP BY k.kind")
def _(t):
    s = symbols(t)
    kinds = sorted(r[0] for r in s.select("kind").distinct().collect())  # a fixed vocabulary in use
    return scans.symbol_stats(s, [*kinds, "no such kind"])


@query("symbol_upsert", SYMBOLS + "SELECT id, name, CASE WHEN id % 10 = 0 THEN 'renewed' ELSE kind END AS kind FROM s UNION ALL SELECT -1, 'new', 'added'")
def _(t):
    s = symbols(t).select("id", "name", "kind")
    new = s.where("id % 10 = 0").withColumn("kind", F.lit("renewed"))
    extra = s.sparkSession.createDataFrame([(-1, "new", "added")], s.schema)
    return upsert(s, new.unionByName(extra), ["id"])


@query("symbol_delete_file", SYMBOLS + "SELECT id, file FROM s WHERE file <> (SELECT min(file) FROM s)")
def _(t):
    s = symbols(t)
    return delete_where(s, F.col("file") == s.agg(F.min("file")).first()[0]).select("id", "file")


@query("search_filter_before_limit", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2) ORDER BY vec_id LIMIT 20")
def _(t):
    return t.embeddings.where(F.col("label").isin(1, 2)).orderBy("vec_id").limit(20).select("vec_id", "label")


@query("ledger_kind_time_scan", "SELECT event_id, ts, user_id AS session, event_type AS kind, value FROM events WHERE event_type IN ('error', 'purchase') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' ORDER BY ts, event_id LIMIT 100 OFFSET 10")
def _(t):
    import datetime

    found = scans.query_ledger(ledger(t), kinds=["error", "purchase"], since=datetime.datetime(2024, 1, 5), until=datetime.datetime(2024, 1, 12), order=["ts", "event_id"], limit=100, offset=10)
    return found.select("event_id", "ts", "session", "kind", "value")


@query("ledger_json_filter", "SELECT event_id, user_id AS session, event_type AS kind FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(t):
    return scans.query_ledger(ledger(t), json=("props", "$.k", "7")).select("event_id", "session", "kind")


@query("ledger_payload_like", "SELECT event_id, event_type AS kind FROM events WHERE props LIKE '%9%' AND user_id = 5")
def _(t):
    return scans.query_ledger(ledger(t), session=5, contains=("props", "9")).select("event_id", "kind")


@query("ledger_append_new", "SELECT event_id FROM events UNION SELECT -1")
def _(t):
    rows = ledger(t).select("event_id")
    return append_new(rows, rows.where("event_id % 3 = 0").union(t.spark.createDataFrame([(-1,), (-1,)], rows.schema)), ["event_id"])


@query("edge_scan_options", "SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS kind, l_linestatus AS source_file FROM lineitem WHERE l_partkey IN (1, 2, 3, 5, 8) AND l_returnflag IN ('R', 'A')")
def _(t):
    edges = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("source_file"))
    return scans.scan_edges(edges, from_ids=[1, 2, 3, 5, 8], kinds=["R", "A"])


@query("ids_in_json_array", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(role = 'system')")
def _(t):
    packed = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_set("role")).alias("roles"))
    return packed.where(scans.holds_id("roles", "system")).select("conv_id")


@query("page_of_entities", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 15 OFFSET 30")
def _(t):
    return scans.page(t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"], 15, 2)


@query("commits_by_file", "SELECT l_partkey, COUNT(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY l_partkey")
def _(t):
    commits = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("files"))
    touched = joins.explode_join(commits, "files", "l_partkey", t.part.select("p_partkey"), "p_partkey")
    return touched.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("commits"))


@query("latest_result_per_query", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(t):
    return joins.latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("left_join_defaults", "SELECT d.doc_id, COALESCE(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return joins.left_default(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), ["doc_id"], {"quality": -1})


@query("new_files_not_indexed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return joins.only_new(t.documents.select("doc_id"), t.labels.select("doc_id"), ["doc_id"])


@query("boost_known_candidates", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0.8 ELSE 0.5 END AS score FROM documents")
def _(t):
    flagged = joins.flag_members(t.documents.select("doc_id"), t.labels.where("quality = 1"), "doc_id", "known")
    return flagged.select("doc_id", F.when(F.col("known"), 0.8).otherwise(0.5).alias("score"))


@query("merge_graph_and_candidates", "WITH c AS (SELECT doc_id AS id, round(n_chars / 40000.0, 6) AS score FROM documents WHERE doc_id % 2 = 0), g AS (SELECT doc_id AS id, CAST(quality AS DOUBLE) AS confidence FROM labels) SELECT c.id, round(CASE WHEN g.id IS NOT NULL THEN least(1.0, score + 0.3) ELSE score END, 6) AS score FROM c LEFT JOIN g ON c.id = g.id UNION ALL SELECT g.id, round(0.85 + 0.1 * confidence, 6) FROM g WHERE g.id NOT IN (SELECT id FROM c)")
def _(t):
    c = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.round(F.col("n_chars") / 40000.0, 6).alias("score"))
    g = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("confidence"))
    return joins.merge_graph_results(g, c).select("id", F.round("score", 6).alias("score"))


@query("candidate_merge", "WITH a AS (SELECT o_custkey AS id, max(o_totalprice) AS s FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), b AS (SELECT c_custkey AS id, c_acctbal AS s, c_mktsegment AS path FROM customer) SELECT COALESCE(a.id, b.id) AS id, greatest(a.s, b.s) AS s, b.path FROM a FULL JOIN b ON a.id = b.id")
def _(t):
    a = t.orders.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("s")).withColumn("path", F.lit(None).cast("string"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("s"), F.col("c_mktsegment").alias("path"))
    return joins.merge_candidates(a, b, ["id"], ["s"], ["path"])


@query("line_overlap_join", "WITH a AS (SELECT l_orderkey % 50 AS f, l_partkey AS start, l_partkey + 9 AS stop FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_orderkey % 50 AS f, l_suppkey * 20 AS start, l_suppkey * 20 + 15 AS stop FROM lineitem WHERE l_linenumber = 2) SELECT a.f, a.start, a.stop, b.start AS other_start, b.stop AS other_stop, least(a.stop, b.stop) - greatest(a.start, b.start) + 1 AS overlap FROM a JOIN b ON a.f = b.f AND a.start <= b.stop AND b.start <= a.stop")
def _(t):
    a = t.lineitem.where("l_linenumber = 1").select((F.col("l_orderkey") % 50).alias("f"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 9).alias("stop"))
    b = t.lineitem.where("l_linenumber = 2").select((F.col("l_orderkey") % 50).alias("f"), (F.col("l_suppkey") * 20).alias("start"), (F.col("l_suppkey") * 20 + 15).alias("stop"))
    return joins.overlap_join(a, b, ["f"])


@query("suffix_match_join")
def _(t):
    paths = t.pages.select(F.regexp_replace(F.regexp_extract("url", r"https?://([^?#]+)", 1), "/$", "").alias("path")).distinct()
    names = paths.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    return joins.suffix_join(names, paths)


@query("pairs_within_order", "SELECT l.o AS l_orderkey, l.p AS a, r.p AS b FROM (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem) l JOIN (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem) r ON l.o = r.o AND l.p < r.p")
def _(t):
    return joins.pairs_within(t.lineitem, ["l_orderkey"], "l_partkey")


@query("hotspot_inputs_merged", "SELECT c_custkey, COALESCE(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, CASE WHEN c_custkey % 2 = 0 THEN -1.0 END, 0.0) AS v FROM customer")
def _(t):
    return t.customer.select("c_custkey", joins.last_defined(F.lit(0.0), F.when(F.col("c_custkey") % 2 == 0, -1.0), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal"))).alias("v"))


@query("entity_difference", "WITH a AS (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier WHERE s_suppkey % 7 <> 0), b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_acctbal END AS v FROM supplier WHERE s_suppkey % 11 <> 0) SELECT COALESCE(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.id = b.id")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return joins.difference(s.where("id % 7 <> 0"), s.where("id % 11 <> 0").withColumn("v", F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.col("v"))), ["id"], ["v"])


@query("involved_entities", "SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select(F.col("l_partkey").alias("id")).union(t.lineitem.select("l_suppkey")).distinct()


@query("new_and_deleted_entities", "(SELECT doc_id, 'new' AS state FROM documents EXCEPT SELECT doc_id, 'new' FROM labels) UNION ALL (SELECT vec_id, 'deleted' FROM embeddings EXCEPT SELECT doc_id, 'deleted' FROM documents)")
def _(t):
    ids = t.documents.select("doc_id")
    new = ids.subtract(t.labels.select("doc_id")).withColumn("state", F.lit("new"))
    return new.union(t.embeddings.select("vec_id").subtract(ids).withColumn("state", F.lit("deleted")))


@query("dead_symbols", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    used = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joins.only_new(t.part.select("p_partkey"), used, ["p_partkey"])


@query("high_impact_changes", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 50000 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def _(t):
    return t.lineitem.where("l_extendedprice >= 50000").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("top_hotspots", "SELECT l_partkey AS id, round(pow(least(1.0, COUNT(*) / 100.0), 0.7) * pow(least(1.0, SUM(l_quantity) / 2000.0), 0.5), 6) AS score FROM lineitem GROUP BY 1 ORDER BY round(pow(least(1.0, COUNT(*) / 100.0), 0.7) * pow(least(1.0, SUM(l_quantity) / 2000.0), 0.5), 6) DESC, 1 LIMIT 10")
def _(t):
    per = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    scored = per.select("id", F.round(scores.hotspot_score(F.least(F.lit(1.0), F.col("n") / 100), F.least(F.lit(1.0), F.col("q") / 2000)), 6).alias("score"))
    return ranking.top(scored, "score", 10, "id")
