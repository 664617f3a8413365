"""Aggregations and windows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import aggregates as A
from loomstone.operators import windows as W
from loomstone.plans.registry import query


def r6(c):
    return F.round(c, 6)


def rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query("cochange_pairs", "WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_partkey AS a, b.l_partkey AS b, COUNT(*) AS together, round(COUNT(*) / (SELECT COUNT(DISTINCT l_orderkey) FROM o), 9) AS strength FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING COUNT(*) >= 2")
def _(t):
    return A.cochange(t.lineitem, "l_orderkey", "l_partkey", first=None, least_count=2).withColumn("strength", F.round("strength", 9))


SHARES = "WITH s AS (SELECT l_partkey AS file, l_suppkey AS author, SUM(l_quantity) AS lines, SUM(l_quantity) / SUM(SUM(l_quantity)) OVER (PARTITION BY l_partkey) AS share FROM lineitem GROUP BY 1, 2), k AS (SELECT * FROM s WHERE share >= 0.05) "


def shares(t):
    return A.ownership(t.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), "l_quantity"), "file", "author", "l_quantity")


@query("ownership_shares", SHARES + "SELECT file, author, lines, round(share, 9) AS share FROM k")
def _(t):
    return shares(t).withColumn("share", F.round("share", 9))


@query("ownership_primary", SHARES + "SELECT file, arg_min(author, (-share, author)) AS owner, round(max(share), 6) AS share, COUNT(CASE WHEN share >= 0.1 THEN 1 END) AS contributors FROM k GROUP BY file")
def _(t):
    return rounded(A.primary_owner(shares(t), "file", "author"), "share")


@query("ownership_concentration", SHARES + "SELECT file, round(CASE WHEN COUNT(*) = 1 THEN 1.0 ELSE 1 - SUM(-share * log2(share)) / log2(COUNT(*)) END, 6) AS concentration FROM k GROUP BY file")
def _(t):
    return rounded(A.concentration(shares(t), "file"), "concentration")


@query("author_rollup", SHARES + "SELECT author, COUNT(*) AS files, SUM(lines) AS lines FROM k GROUP BY author")
def _(t):
    return shares(t).groupBy("author").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


@query("line_expert", "SELECT l_suppkey AS author, max(least(l_partkey + 40, 900) - greatest(l_partkey, 700) + 1) AS overlap FROM lineitem WHERE least(l_partkey + 40, 900) - greatest(l_partkey, 700) + 1 > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def _(t):
    chunks = t.lineitem.select(F.col("l_suppkey").alias("author"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 40).alias("stop"))
    return A.line_expert(chunks, 700, 900, "author")


@query("coupling_instability", "SELECT id, SUM(i)::BIGINT AS ca, SUM(o)::BIGINT AS ce, round(SUM(o) / (SUM(i) + SUM(o)), 6) AS instability FROM (SELECT o_custkey AS id, 0 AS i, 1 AS o FROM orders UNION ALL SELECT o_orderkey % 1000, 1, 0 FROM orders) GROUP BY id")
def _(t):
    edges = t.orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst"))
    return rounded(A.coupling(edges), "instability")


@query("workflow_patterns", "SELECT user_id, COUNT(*) AS n, COUNT(CASE WHEN event_type = 'error' THEN 1 END) AS errors, COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases FROM events GROUP BY user_id")
def _(t):
    return A.conditional_counts(t.events, ["user_id"], errors=F.col("event_type") == "error", purchases=F.col("event_type") == "purchase")


@query("dominant_category_first", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, COUNT(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def _(t):
    return A.dominant(t.events, ["user_id"], "event_type")


@query("dominant_category_last", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, COUNT(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, event_type DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def _(t):
    return A.dominant(t.events, ["user_id"], "event_type", later_wins=True)


CLAIMS = "WITH c AS (SELECT l_discount * 10 AS p, l_quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) "


def claims(t):
    return t.lineitem.select((F.col("l_discount") * 10).alias("p"), "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))


REPORT = "r AS (SELECT CASE WHEN p >= 0.9 THEN '[0.9, 1]' WHEN p >= 0.7 THEN '[0.7, 0.9)' WHEN p >= 0.5 THEN '[0.5, 0.7)' WHEN p >= 0 THEN '[0, 0.5)' END AS bucket, COUNT(*) AS n, avg(p) AS stated, avg(y) AS accuracy FROM c GROUP BY 1) "


@query("calibration_fixed_buckets", CLAIMS + ", " + REPORT + "SELECT bucket, n, round(stated, 6) AS stated, round(accuracy, 6) AS accuracy, round(abs(stated - accuracy), 6) AS error, CASE WHEN stated - accuracy > 0.02 THEN 'over' WHEN stated - accuracy < -0.02 THEN 'under' ELSE 'good' END AS calibration FROM r")
def _(t):
    return rounded(A.calibration_report(claims(t), "p", "y"), "stated", "accuracy", "error")


@query("calibration_overall_error", CLAIMS + ", " + REPORT + "SELECT round(SUM(abs(stated - accuracy) * n) / SUM(n), 6) AS overall_error FROM r WHERE bucket <> '[0, 0.5)'")
def _(t):
    return rounded(A.overall_error(A.calibration_report(claims(t), "p", "y")), "overall_error")


CURVE = CLAIMS + ", k AS (SELECT CAST(least(9, greatest(0, floor(p / 0.1))) AS INT) AS bin, CAST(COUNT(*) AS DOUBLE) AS n, avg(p) AS stated, avg(y) AS accuracy FROM c GROUP BY 1), g AS (SELECT *, abs(stated - accuracy) AS gap FROM k) "


@query("calibration_equal_bins", CURVE + "SELECT bin, n, round(stated, 6) AS stated, round(accuracy, 6) AS accuracy, round(gap, 6) AS gap, round(sqrt(accuracy * (1 - accuracy) / n), 6) AS std_error FROM g")
def _(t):
    return rounded(A.calibration_curve(claims(t), "p", "y"), "stated", "accuracy", "gap", "std_error")


@query("calibration_ece_mce", CURVE + "SELECT round(SUM(n * gap) / SUM(n), 6) AS ece, round(max(gap), 6) AS mce, round(SUM(CASE WHEN stated > accuracy THEN n ELSE 0 END) / SUM(n), 6) AS overconfidence FROM g")
def _(t):
    return rounded(A.curve_summary(A.calibration_curve(claims(t), "p", "y")), "ece", "mce", "overconfidence")


@query("calibration_weighted_bins", CLAIMS + "SELECT CAST(least(9, greatest(0, floor(p / 0.1))) AS INT) AS bin, SUM(l_quantity) AS n, round(SUM(p * l_quantity) / SUM(l_quantity), 6) AS stated, round(SUM(y * l_quantity) / SUM(l_quantity), 6) AS accuracy FROM c GROUP BY 1")
def _(t):
    return rounded(A.calibration_curve(claims(t), "p", "y", weight="l_quantity").select("bin", "n", "stated", "accuracy"), "stated", "accuracy")


@query("calibration_reliability_resolution", CURVE + "SELECT round(SUM(n * gap * gap) / SUM(n), 6) AS reliability, round(SUM(n * pow(accuracy - (SELECT SUM(n * accuracy) / SUM(n) FROM g), 2)) / SUM(n), 6) AS resolution FROM g")
def _(t):
    return rounded(A.brier_parts(A.calibration_curve(claims(t), "p", "y")), "reliability", "resolution")


@query("brier_and_log_loss", CLAIMS + "SELECT COUNT(*) AS n, round(avg(pow(least(1, greatest(0, p)) - y, 2)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN least(greatest(p, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(p, 1e-15), 1 - 1e-15) END)), 5) AS log_loss FROM c")
def _(t):
    return A.scoring_rules(claims(t), "p", "y").select("n", r6(F.col("brier")).alias("brier"), F.round("log_loss", 5).alias("log_loss"))


@query("calibration_adjustment", CLAIMS + ", k AS (SELECT CAST(least(9, greatest(0, floor(p / 0.1))) AS INT) AS bin, COUNT(*) AS n, avg(y) AS acc FROM c GROUP BY 1), d AS (SELECT DISTINCT round(p, 6) AS p FROM c) SELECT p, round(CASE WHEN COALESCE(n, 0) < 3 THEN p ELSE least(1, greatest(0, p * (1 - least(1.0, n / 20.0)) + acc * least(1.0, n / 20.0))) END, 6) AS adjusted FROM d LEFT JOIN k ON bin = CAST(least(9, greatest(0, floor(p / 0.1))) AS INT)")
def _(t):
    from loomstone.functions.confidence import shrink_to_bucket

    curve = A.calibration_curve(claims(t), "p", "y").select("bin", "n", "accuracy")
    d = claims(t).select(r6(F.col("p")).alias("p")).distinct().withColumn("bin", A.bin_of(F.col("p"), 10))
    return d.join(curve, "bin", "left").select("p", r6(shrink_to_bucket("p", "accuracy", "n")).alias("adjusted"))


RANKED = "WITH r AS (SELECT o_custkey AS query, o_orderkey % 60 AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), g AS (SELECT DISTINCT c_custkey AS query, i AS item, (1 + i % 3)::DOUBLE AS grade FROM customer, range(0, 60, 7) t(i)) "


def ranked(t):
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 60).alias("item"), "o_totalprice", "o_orderkey").select("query", "item", F.row_number().over(w).alias("rank"))


def relevant(t):
    return t.customer.select(F.col("c_custkey").alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"), F.lit(7).cast("long"))).alias("item")).withColumn("grade", (1 + F.col("item") % 3).cast("double"))


METRICS = RANKED + """, h AS (SELECT r.*, g.grade FROM r LEFT JOIN g USING (query, item)),
p AS (SELECT query, COUNT(*) AS returned, COALESCE(max(CASE WHEN grade IS NOT NULL THEN 1.0 / rank END), 0) AS mrr, COUNT(CASE WHEN rank <= 5 AND grade IS NOT NULL THEN 1 END) AS hits, SUM(CASE WHEN rank <= 5 THEN COALESCE(grade, 0) / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY query),
i AS (SELECT query, SUM(CASE WHEN n <= 5 THEN grade / log2(n + 1) ELSE 0 END) AS idcg FROM (SELECT g.*, row_number() OVER (PARTITION BY query ORDER BY grade DESC, item) AS n FROM g) JOIN p USING (query) WHERE n <= returned GROUP BY query),
m AS (SELECT query, round(mrr, 6) AS mrr, round(hits / 9.0, 6) AS recall5, round(hits / 5.0, 6) AS precision5, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit5, round(dcg / idcg, 6) AS ndcg5 FROM p JOIN i USING (query)) """


@query("retrieval_metrics_at_5", METRICS + "SELECT query, mrr, recall5, precision5, CAST(hit5 AS DOUBLE) AS hit5, ndcg5 FROM m")
def _(t):
    return rounded(A.retrieval_metrics(ranked(t), relevant(t), (5,)), "mrr", "recall5", "precision5", "ndcg5")


@query("retrieval_report", METRICS + "SELECT COUNT(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(recall5), 6) AS recall5, round(avg(ndcg5), 6) AS ndcg5, avg(recall5) >= 0.7 AS complies FROM m")
def _(t):
    m = rounded(A.retrieval_metrics(ranked(t), relevant(t), (5,)), "mrr", "recall5", "ndcg5")
    return m.agg(F.count(F.lit(1)).alias("queries"), r6(F.avg("mrr")).alias("mrr"), r6(F.avg("recall5")).alias("recall5"), r6(F.avg("ndcg5")).alias("ndcg5"), (F.avg("recall5") >= 0.7).alias("complies"))


@query("retrieval_compare_methods", METRICS + "SELECT COUNT(*) AS queries, round(avg(ndcg5), 6) AS mean_a, round(avg(mrr), 6) AS mean_b, COUNT(CASE WHEN ndcg5 > mrr + 0.01 THEN 1 END) AS wins_a, COUNT(CASE WHEN mrr > ndcg5 + 0.01 THEN 1 END) AS wins_b, COUNT(*) - COUNT(CASE WHEN ndcg5 > mrr + 0.01 THEN 1 END) - COUNT(CASE WHEN mrr > ndcg5 + 0.01 THEN 1 END) AS ties, round((avg(mrr) - avg(ndcg5)) / avg(ndcg5), 6) AS change FROM m")
def _(t):
    m = rounded(A.retrieval_metrics(ranked(t), relevant(t), (5,)), "mrr", "ndcg5")
    return rounded(A.compare_methods(m.select("query", F.col("ndcg5").alias("v")), m.select("query", F.col("mrr").alias("v")), "v"), "mean_a", "mean_b", "change")


CAUSAL = """
WITH o AS (SELECT user_id AS unit, CASE WHEN event_type <> 'error' THEN event_type || CAST(event_id % 4 AS VARCHAR) END AS cause,
                  CASE WHEN event_type = 'error' THEN 'error' || CAST(event_id % 5 AS VARCHAR) END AS effect FROM events),
c AS (SELECT DISTINCT unit, cause FROM o WHERE cause IS NOT NULL), e AS (SELECT DISTINCT unit, effect FROM o WHERE effect IS NOT NULL),
n AS (SELECT COUNT(DISTINCT unit) AS n FROM o),
nc AS (SELECT cause, COUNT(*) AS n_cause FROM c GROUP BY 1 HAVING COUNT(*) >= 3), ne AS (SELECT effect, COUNT(*) AS n_effect FROM e GROUP BY 1 HAVING COUNT(*) >= 3),
j AS (SELECT cause, effect, COUNT(*) AS joint FROM c JOIN e USING (unit) GROUP BY 1, 2 HAVING COUNT(*) >= 2),
x AS (SELECT cause, effect, joint, joint / n_cause AS probability, n_effect / n AS base_rate FROM j JOIN nc USING (cause) JOIN ne USING (effect), n)
SELECT cause, effect, joint, round(probability / base_rate, 6) AS lift, round(probability, 6) AS probability, round(base_rate, 6) AS base_rate,
       round(least(1.0, (probability / base_rate - 1) / 2) * least(1.0, joint / 10.0), 6) AS confidence
FROM x WHERE probability / base_rate >= 1.0"""


@query("causal_lift", CAUSAL)
def _(t):
    error, part = F.col("event_type") == "error", F.col("event_id")
    cause = F.when(~error, F.concat("event_type", (part % 4).cast("string")))
    effect = F.when(error, F.concat(F.lit("error"), (part % 5).cast("string")))
    o = t.events.select(F.col("user_id").alias("unit"), cause.alias("cause"), effect.alias("effect"))
    return rounded(A.causal_lift(o, "unit", "cause", "effect", least_lift=1.0), "lift", "probability", "base_rate", "confidence")


@query("index_completeness", "SELECT lang, source, COUNT(*) AS total, COUNT(l.doc_id) AS indexed, round(COUNT(l.doc_id) / COUNT(*), 6) AS coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def _(t):
    return rounded(A.completeness(t.documents.select("doc_id", "lang", "source"), t.labels.select("doc_id"), "doc_id", ["lang", "source"]), "coverage")


@query("latency_p50_p99", "WITH n AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000), s AS (SELECT list_sort(list(value)) AS v FROM n) SELECT v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS p50, v[CAST(floor(len(v) * 0.99) AS INT) + 1] AS p99, len(v) AS samples, round((SELECT avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) FROM events), 6) AS hit_rate FROM s")
def _(t):
    out = A.latency_summary(t.events, "value", [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error")
    return rounded(out.withColumn("samples", F.col("samples").cast("long")), "hit_rate")


@query("sla_adherence", "SELECT event_type, round(100 * avg(CASE WHEN value <= 80 THEN 1.0 ELSE 0.0 END), 6) AS adherence FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(r6(100 * F.avg((F.col("value") <= 80).cast("double"))).alias("adherence"))


@query("session_cost_distribution", "SELECT user_id AS session, COUNT(*) AS n, round(SUM(value), 2) AS cost, round(avg(value), 2) AS latency FROM events GROUP BY 1 ORDER BY round(SUM(value), 2) DESC, COUNT(*) DESC, 1 LIMIT 10")
def _(t):
    g = t.events.groupBy(F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("cost"), F.round(F.avg("value"), 2).alias("latency"))
    return g.orderBy(F.desc("cost"), F.desc("n"), "session").limit(10)


@query("confidence_state", "SELECT lang, round(avg(c), 6) AS mean, round(exp(avg(ln(greatest(c, 0.01)))), 6) AS geometric, COUNT(CASE WHEN c < 0.5 THEN 1 END) AS low FROM (SELECT lang, least(1.0, n_chars / 5000.0) AS c FROM documents) GROUP BY 1")
def _(t):
    d = t.documents.select("lang", F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("c"))
    return d.groupBy("lang").agg(r6(F.avg("c")).alias("mean"), r6(F.exp(F.avg(F.log(F.greatest("c", F.lit(0.01)))))).alias("geometric"), F.count(F.when(F.col("c") < 0.5, 1)).alias("low"))


@query("confidence_stats", "SELECT lang, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS deviation, min(n_chars) AS least, max(n_chars) AS greatest, median(n_chars) AS middle FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.stddev_pop("n_chars"), 4).alias("deviation"), F.min("n_chars").alias("least"), F.max("n_chars").alias("greatest"), F.median("n_chars").alias("middle"))


@query("agent_comparison", "WITH g AS (SELECT avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS m FROM events) SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) - (SELECT m FROM g), 6) AS delta FROM events GROUP BY 1")
def _(t):
    ok = (F.col("event_type") != "error").cast("double")
    per = t.events.groupBy("user_id").agg(F.avg(ok).alias("s"))
    return per.crossJoin(F.broadcast(t.events.agg(F.avg(ok).alias("m")))).select("user_id", r6("s").alias("success"), r6(F.col("s") - F.col("m")).alias("delta"))


@query("performance_metrics", "SELECT event_type, COUNT(*) AS n, round(avg(value), 6) AS duration, round(COUNT(*) / greatest(1.0, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) / 86400.0), 6) AS per_day FROM events GROUP BY 1")
def _(t):
    span = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400.0
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("duration"), r6(F.count(F.lit(1)) / F.greatest(F.lit(1.0), span)).alias("per_day"))


@query("speed_score", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT event_type, value AS p75 FROM r WHERE i = least(CAST(floor(n * 0.75) AS BIGINT), n - 1)) SELECT event_type, p75, round(p75 / (avg(value) + p75), 6) AS speed FROM events JOIN p USING (event_type) GROUP BY event_type, p75")
def _(t):
    p = W.nearest_rank(t.events.select("event_type", "value"), ["event_type"], "value", 0.75).withColumnRenamed("value", "p75")
    mean = t.events.groupBy("event_type").agg(F.avg("value").alias("m"))
    return p.join(mean, "event_type").select("event_type", "p75", r6(F.col("p75") / (F.col("m") + F.col("p75"))).alias("speed"))


@query("percentile_nearest_rank", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, value FROM r WHERE i = CAST(floor(0.8 * (n - 1)) AS BIGINT)")
def _(t):
    return W.nearest_rank(t.events.select("user_id", "value"), ["user_id"], "value", 0.8, from_zero=False)


@query("percentile_linear", "SELECT user_id, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(r6(F.percentile("value", 0.9)).alias("p90"))


@query("percentile_global_rank", "SELECT value AS p99 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, COUNT(*) OVER () AS n FROM events) WHERE i = CAST(floor(n * 0.99) AS BIGINT)")
def _(t):
    return t.spark.createDataFrame([(W.global_rank(t.events, "value", 0.99),)], "p99 double")


@query("blame_runs", "WITH e AS (SELECT l_orderkey % 20 AS f, row_number() OVER (PARTITION BY l_orderkey % 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line, l_returnflag AS author FROM lineitem), g AS (SELECT *, line - row_number() OVER (PARTITION BY f, author ORDER BY line) AS grp FROM e) SELECT f, author, min(line) AS start, max(line) AS stop, COUNT(*) AS rows FROM g GROUP BY f, author, grp")
def _(t):
    from pyspark.sql import Window

    f = (F.col("l_orderkey") % 20).alias("f")
    w = Window.partitionBy("f").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    e = t.lineitem.select(f, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("author")).withColumn("line", F.row_number().over(w))
    return W.runs(e.select("f", "line", "author"), ["f"], "line", ["author"])


@query("spike_detection", "SELECT event_id, round(delta, 6) AS delta FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events) WHERE abs(delta) >= 60")
def _(t):
    return W.spikes(t.events, ["user_id"], ["ts", "event_id"], "value", 60).select("event_id", r6("delta").alias("delta"))


@query("stability_metrics", "WITH b AS (SELECT user_id, value, row_number() OVER w - 1 AS i, value - lag(value) OVER w AS d, lag(value) OVER w AS prev, avg(value) OVER (PARTITION BY user_id) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT user_id, COUNT(*) AS n, COALESCE(stddev_pop(d), 0) AS volatility, COALESCE(regr_slope(value, i), 0) AS slope, COALESCE(SUM((value - m) * (prev - m)) / SUM((prev - m) * (prev - m)), 0) AS phi FROM b GROUP BY 1) SELECT user_id, n, round(volatility, 5) AS volatility, round(slope, 5) AS slope, round(phi, 5) AS phi, round(CASE WHEN n < 2 THEN 0 ELSE ln(2) / abs(-ln(abs(phi) + 0.001)) END, 4) AS half_life FROM g")
def _(t):
    s = W.stability(t.events, ["user_id"], ["ts", "event_id"], "value")
    return s.select("user_id", "n", F.round("volatility", 5).alias("volatility"), F.round("slope", 5).alias("slope"), F.round("phi", 5).alias("phi"), F.round("half_life", 4).alias("half_life"))


@query("trend_last_ten", "WITH r AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), g AS (SELECT user_id, COUNT(*) AS seen, avg(CASE WHEN n <= 10 THEN ok END) AS recent, avg(CASE WHEN n > 10 THEN ok END) AS earlier FROM r WHERE n <= 20 GROUP BY 1) SELECT user_id, seen, round(recent, 6) AS recent, round(earlier, 6) AS earlier, CASE WHEN seen < 10 THEN 'stable' WHEN recent - COALESCE(earlier, recent) > 0.1 + 1e-9 THEN 'improving' WHEN recent - COALESCE(earlier, recent) < -0.1 - 1e-9 THEN 'declining' ELSE 'stable' END AS trend FROM g")
def _(t):
    return rounded(W.trend_last(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error", band=0.1 + 1e-9), "recent", "earlier")


@query("min_max_normalised", "SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS scaled FROM supplier")
def _(t):
    return W.min_max(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "scaled").select("s_suppkey", r6("scaled").alias("scaled"))


@query("max_normalised", "SELECT s_suppkey, round(s_acctbal / greatest(max(s_acctbal) OVER (), 0.001), 6) AS scaled FROM supplier")
def _(t):
    return W.over_max(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "scaled").select("s_suppkey", r6("scaled").alias("scaled"))


@query("symbols_per_file_cap", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_name, p_partkey) AS n FROM part) WHERE n <= 5")
def _(t):
    return W.first_per(t.part, ["p_brand"], ["p_size", "p_name", "p_partkey"], 5).select("p_brand", "p_partkey")


@query("token_budget_cut", "WITH r AS (SELECT conv_id, turn, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens, SUM(CAST(ceil(length(text) / 3.5) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS running, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, tokens, running::BIGINT AS running FROM r WHERE running <= 300 OR n = 1")
def _(t):
    c = t.conversations.select("conv_id", "turn", T.estimate_tokens("text").alias("tokens"))
    return W.budget_cut(c, ["conv_id"], ["turn"], "tokens", 300)


@query("distribution_shift", "WITH e AS (SELECT label % 2 AS g, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), a AS (SELECT d, avg(x::DOUBLE) AS m, var_pop(x::DOUBLE) AS v FROM e WHERE g = 0 GROUP BY d), b AS (SELECT d, avg(x::DOUBLE) AS m FROM e WHERE g = 1 GROUP BY d) SELECT round(avg(pow(a.m - b.m, 2) / (a.v + 1e-8)), 5) AS shift, avg(pow(a.m - b.m, 2) / (a.v + 1e-8)) > 0.5 AS shifted FROM a JOIN b USING (d)")
def _(t):
    e = t.embeddings
    return A.distribution_shift(e.where("label % 2 = 0"), e.where("label % 2 = 1"), "embedding").withColumn("shift", F.round("shift", 5))


@query("knowledge_rollup", "SELECT o_custkey, round(min(c), 6) AS least, round(max(c), 6) AS greatest, round(avg(c), 6) AS mean, round(SUM(c * w) / SUM(w), 6) AS weighted, round(max(r) + 0.05 * COUNT(*), 6) AS risk FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 / 100.0 END AS c, 1.0 + o_orderkey % 3 AS w, o_orderkey % 10 / 10.0 AS r FROM orders) GROUP BY 1")
def _(t):
    k = F.col("o_orderkey")
    o = t.orders.select("o_custkey", F.when(k % 5 > 0, k % 100 / 100.0).alias("c"), (1.0 + k % 3).alias("w"), (k % 10 / 10.0).alias("r"), F.lit(1).alias("e"))
    return rounded(A.rollup_children(o, ["o_custkey"], "c", "r", "w", "e"), "least", "greatest", "mean", "weighted", "risk")


@query("edge_statistics", "SELECT l_returnflag AS kind, l_linestatus AS pair, COUNT(*) AS n, round(avg(l_quantity), 6) AS weight, round(avg(l_discount), 6) AS confidence FROM lineitem GROUP BY 1, 2")
def _(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("pair")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("weight"), r6(F.avg("l_discount")).alias("confidence"))


@query("churn_debt", "SELECT l_partkey, COUNT(DISTINCT l_orderkey) AS commits, round(avg(l_discount * 10), 6) AS complexity, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS structural FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("commits"), r6(F.avg(F.col("l_discount") * 10)).alias("complexity"), r6(F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("structural"))


@query("evolution_timeline", "SELECT * FROM (SELECT o_custkey AS id, o_orderdate AS at, 'order' AS kind FROM orders UNION ALL SELECT user_id, ts, event_type FROM events)")
def _(t):
    orders = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"))
    return orders.unionByName(t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))).orderBy("id", "at", "kind")


@query("isotonic_calibration")
def _(t):
    from loomstone.functions.isotonic import fit_isotonic

    return fit_isotonic(claims(t).withColumn("y", F.col("y").cast("double")), "p", "y")
