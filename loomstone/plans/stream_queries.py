"""Streaming-shaped queries in their batch form; the stream forms are held against these in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.plans import intents
from loomstone.plans.registry import query
from loomstone.streaming import changes as S


@query("session_debounce", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS \"end\", COUNT(*) AS events, max(ts) AS last FROM g GROUP BY user_id, s")
def _(t):
    return S.debounce(t.events, "user_id", "ts", "2 hours")


@query("storm_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, COUNT(*) AS events, COUNT(DISTINCT user_id) AS keys, COUNT(*) >= 16 AS storm FROM events GROUP BY 1")
def _(t):
    return S.batches(t.events, "user_id", "ts", "1 hour", storm=16)


@query("sliding_error_rate", "WITH s AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) SELECT start, event_type, COUNT(*) AS n FROM s GROUP BY 1, 2")
def _(t):
    return S.sliding(t.events, "ts", "2 hours", "1 hour", ["event_type"], n=F.count(F.lit(1)))


@query("unchanged_suppressed", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE NOT (doc_id % 3 = 0)")
def _(t):
    d = t.documents.select("doc_id", T.content_hash("text").alias("hash"))
    known = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return S.changed_only(d, known, "doc_id", "hash")


@query("cascade_reindex", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey % 500 = 3 AND l_orderkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 500 = 3) ORDER BY 1 LIMIT 50")
def _(t):
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return S.cascade(t.lineitem.where("l_partkey % 500 = 3").select("l_partkey"), edges, "l_partkey")


@query("learning_laplace_tiers", "WITH g AS (SELECT user_id, COUNT(CASE WHEN event_type <> 'error' THEN 1 END) AS successes, COUNT(*) AS n FROM events GROUP BY 1) SELECT user_id, successes, n, round((successes + 1) / (n + 2), 6) AS estimate, CASE WHEN (successes + 1) / (n + 2) >= 0.8 AND n >= 20 THEN 'core' WHEN (successes + 1) / (n + 2) >= 0.6 AND n >= 5 THEN 'useful' ELSE 'trial' END AS tier FROM g")
def _(t):
    return S.learn_batch(t.events, "user_id", F.col("event_type") != "error").withColumn("estimate", F.round("estimate", 6))


@query("late_outcomes", "SELECT p.event_id AS key, p.ts AS made, p.value AS p, o.ts AS seen, o.value AS y FROM events p JOIN events o ON o.user_id * 100000 + o.event_id % 1000 = p.user_id * 100000 + p.event_id % 1000 AND o.event_type = 'purchase' AND p.event_type = 'click' AND o.ts >= p.ts AND o.ts <= p.ts + INTERVAL 20 DAYS")
def _(t):
    k = F.col("user_id") * 100000 + F.col("event_id") % 1000
    p = t.events.where("event_type = 'click'").select(k.alias("k"), F.col("event_id").alias("key"), F.col("ts").alias("made"), F.col("value").alias("p"))
    o = t.events.where("event_type = 'purchase'").select(k.alias("k"), F.col("ts").alias("seen"), F.col("value").alias("y"))
    return S.join_outcomes(p, o, "k", "20 days").drop("k")


@query("import_rule_violations", "SELECT DISTINCT p_type || '/' || p_name AS src, p_brand || '/x' AS dst, 'block' AS level FROM part WHERE p_type = 'SMALL' AND p_brand = 'Brand#4'")
def _(t):
    edges = t.part.select(F.concat_ws("/", "p_type", "p_name").alias("src"), F.concat(F.col("p_brand"), F.lit("/x")).alias("dst")).distinct()
    rules = t.spark.createDataFrame([("SMALL/", "Brand#4/", "block")], "from_prefix string, to_prefix string, level string")
    return S.violations(edges, rules)


@query("cache_categories", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(error|exception|bug|failed|failing|timeout|trace|stack)\\b|why does') THEN 'diagnostic' WHEN regexp_matches(lower(text), '\\bhow does\\b|\\barchitecture\\b|\\bdesign\\b|\\boverview\\b|\\bconcept\\b') THEN 'conceptual' ELSE 'lookup' END AS category FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", T.cache_category("text").alias("category"))


@query("exhaustive_intents")
def _(t):
    return t.conversations.select("conv_id", "turn", intents.exhaustive_column("text").alias("exhaustive"))
