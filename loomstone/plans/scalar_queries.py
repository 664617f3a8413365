"""Scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import confidence as C
from loomstone.functions import scores as S
from loomstone.functions import text as T
from loomstone.plans.registry import query


def r6(c):
    return F.round(c, 6)


@query("clamp_and_lerp", "SELECT c_custkey, round(least(1.0, greatest(0.0, c_acctbal / 5000)), 6) AS clamped, round(10 + (20 - 10) * (c_acctbal / 10000), 6) AS lerped FROM customer")
def _(t):
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", r6(S.clamp01(x / 5000)).alias("clamped"), r6(S.lerp(10, 20, x / 10000)).alias("lerped"))


AGE = "WITH e AS (SELECT event_id, date_diff('second', ts, (SELECT max(ts) FROM events)) / 3600.0 AS age, CASE event_type WHEN 'error' THEN 24.0 WHEN 'signup' THEN 240.0 WHEN 'click' THEN 72.0 END AS sla FROM events) "


def aged(t):
    last = t.events.agg(F.max("ts").alias("_last"))
    sla = F.when(F.col("event_type") == "error", 24.0).when(F.col("event_type") == "signup", 240.0).when(F.col("event_type") == "click", 72.0)
    e = t.events.crossJoin(F.broadcast(last))
    seconds = F.unix_timestamp(F.date_trunc("second", "_last")) - F.unix_timestamp(F.date_trunc("second", "ts"))
    return e.select("event_id", (seconds / 3600.0).alias("age"), sla.alias("sla"))


@query("freshness_decay", AGE + "SELECT event_id, round(CASE WHEN sla IS NULL OR age <= 0 THEN 1.0 ELSE pow(0.5, age / sla) END, 6) AS freshness FROM e")
def _(t):
    return aged(t).select("event_id", r6(S.half_life("age", "sla")).alias("freshness"))


@query("staleness_category", AGE + "SELECT event_id, CASE WHEN age <= sla THEN 'fresh' WHEN age < 2 * sla THEN 'stale' ELSE 'critical' END AS category FROM e")
def _(t):
    return aged(t).select("event_id", S.staleness("age", "sla").alias("category"))


@query("freshness_confidence", AGE + "SELECT event_id, round(CASE WHEN sla IS NULL THEN 0.1 WHEN age <= sla THEN 1.0 WHEN age <= 2 * sla THEN 1 - 0.5 * (age - sla) / sla ELSE greatest(0.1, 0.5 * sla / age) END, 6) AS confidence FROM e")
def _(t):
    return aged(t).select("event_id", r6(S.freshness_confidence("age", "sla")).alias("confidence"))


@query("staleness_precedence", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'relative' WHEN o_totalprice > 150000 THEN 'absolute' WHEN o_orderkey % 10 / 10.0 < 0.5 THEN 'dependency' ELSE 'none' END AS reason FROM orders")
def _(t):
    reason = S.stale_reason(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") > 150000, F.col("o_orderkey") % 10 / 10.0)
    return t.orders.select("o_orderkey", reason.alias("reason"))


@query("refresh_priority", "SELECT o_orderkey, round(0.5 * (o_orderkey % 3 / 2.0) + 0.3 * (o_custkey % 5 / 4.0) + 0.2 * (o_orderkey % 7 / 6.0), 6) AS priority, CASE WHEN round(0.5 * (o_orderkey % 3 / 2.0) + 0.3 * (o_custkey % 5 / 4.0) + 0.2 * (o_orderkey % 7 / 6.0), 6) > 0.7 THEN 'high' WHEN round(0.5 * (o_orderkey % 3 / 2.0) + 0.3 * (o_custkey % 5 / 4.0) + 0.2 * (o_orderkey % 7 / 6.0), 6) > 0.4 THEN 'normal' ELSE 'low' END AS band FROM orders")
def _(t):
    p = r6(S.refresh_priority(F.col("o_orderkey") % 3 / 2.0, F.col("o_custkey") % 5 / 4.0, F.col("o_orderkey") % 7 / 6.0))
    return t.orders.select("o_orderkey", p.alias("priority")).withColumn("band", S.priority_band("priority"))


@query("recency_score", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 9 = 0 THEN 0.5 ELSE exp(-greatest(date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)), 0) / 30.0) END, 6) AS recency FROM orders")
def _(t):
    last = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("_last"))
    days = F.when(F.col("o_orderkey") % 9 != 0, F.datediff("_last", F.to_date("o_orderdate")))
    return t.orders.crossJoin(F.broadcast(last)).select("o_orderkey", r6(S.recency(days, 30.0, 0.5)).alias("recency"))


@query("hotspot_scores", "WITH p AS (SELECT l_partkey AS id, COUNT(*) AS n, COUNT(DISTINCT l_suppkey) AS authors, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS recent, SUM(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT id, round(pow((least(1.0, n / 100.0) + least(1.0, authors / 10.0) + least(1.0, least(1.0, recent / 20.0) * 1.3)) / 3, 0.7) * pow(least(1.0, q / 2000.0), 0.5), 6) AS score FROM p")
def _(t):
    p = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("authors"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("recent"), F.sum("l_quantity").alias("q"))
    none = F.lit(None).cast("double")
    churn = S.churn_score("n", "authors", "recent", none, none)
    return p.select("id", r6(S.hotspot_score(churn, S.capped("q", 2000))).alias("score"))


DEBT = "SELECT p_partkey AS id, (CASE WHEN n * 10 > 500 THEN 40 WHEN n * 10 > 300 THEN 25 WHEN n * 10 > 150 THEN 10 ELSE 0 END) + (CASE WHEN p_size > 50 THEN 30 WHEN p_size > 20 THEN 20 WHEN p_size > 10 THEN 10 ELSE 0 END) AS complexity, CASE WHEN n < 20 THEN 60.0 ELSE 20.0 END AS churn FROM part JOIN (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"


def debts(t):
    n = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.part.join(n, "p_partkey").select(F.col("p_partkey").alias("id"), S.complexity_debt(F.col("n") * 10, "p_size").alias("complexity"), F.when(F.col("n") < 20, 60.0).otherwise(20.0).alias("churn"))


@query("complexity_debt", DEBT)
def _(t):
    return debts(t)


@query("debt_weighted_total", f"SELECT id, round(least(100.0, complexity * 0.6 + churn * 0.4), 6) AS total, CASE WHEN least(100.0, complexity * 0.6 + churn * 0.4) >= 80 THEN 'critical' WHEN least(100.0, complexity * 0.6 + churn * 0.4) >= 60 THEN 'high' WHEN least(100.0, complexity * 0.6 + churn * 0.4) >= 40 THEN 'medium' ELSE 'low' END AS priority FROM ({DEBT})")
def _(t):
    total = S.debt_total({"complexity": F.col("complexity"), "churn": F.col("churn")}, {"complexity": 0.6, "churn": 0.4})
    return debts(t).select("id", r6(total).alias("total"), S.debt_priority(total).alias("priority"))


@query("debt_health_grade", f"SELECT round(avg(100 - complexity), 4) AS score, CASE WHEN avg(100 - complexity) >= 90 THEN 'A' WHEN avg(100 - complexity) >= 80 THEN 'B' WHEN avg(100 - complexity) >= 70 THEN 'C' WHEN avg(100 - complexity) >= 60 THEN 'D' ELSE 'F' END AS grade, SUM(CASE WHEN complexity >= 40 THEN 1 ELSE 0 END)::BIGINT AS critical FROM ({DEBT})")
def _(t):
    score = F.avg(100 - F.col("complexity"))
    return debts(t).agg(F.round(score, 4).alias("score"), S.grade(score).alias("grade"), F.count(F.when(F.col("complexity") >= 40, 1)).alias("critical"))


@query("debt_roi_and_risk", "SELECT s_suppkey, round(greatest(0.0, (1 + s_suppkey % 5 / 10.0 - 1) * 12), 6) AS roi, round(100 * (0.4 * (s_suppkey % 3 / 2.0) + 0.2 * least(1.0, s_suppkey / 20.0) + 0.2 * least(1.0, s_suppkey * 5 / 365.0) + 0.2 * least(1.0, greatest(0.0, 10 * (1 + s_suppkey % 5 / 10.0 - 1)))), 6) AS risk FROM supplier")
def _(t):
    rate = 1 + F.col("s_suppkey") % 5 / 10.0
    return t.supplier.select("s_suppkey", r6(S.debt_roi(rate, F.lit(1.0))).alias("roi"), r6(S.debt_risk(F.col("s_suppkey") % 3 / 2.0, "s_suppkey", F.col("s_suppkey") * 5, rate)).alias("risk"))


@query("priority_factors", "SELECT c_custkey, round(CASE WHEN n = 0 THEN 20.0 ELSE least(85.0, 40 + 25 * log2(n + 1)) END, 6) AS unblock, least(85.0, 50 + 10.0 * n) AS momentum FROM (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def _(t):
    n = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return n.select("c_custkey", r6(S.unblock_score("n")).alias("unblock"), S.momentum_score("n").alias("momentum"))


@query("time_decay_bonus", "SELECT o_orderkey, round(CASE WHEN d > 30 THEN least(20.0, (d - 30) * 0.5) WHEN d < 7 THEN 10.0 ELSE 0.0 END, 6) AS bonus FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) AS d FROM orders)")
def _(t):
    last = t.orders.agg(F.to_date(F.max("o_orderdate")).alias("_last"))
    d = F.datediff("_last", F.to_date("o_orderdate"))
    return t.orders.crossJoin(F.broadcast(last)).select("o_orderkey", r6(S.time_decay_bonus(d, 30, 0.5, 20.0)).alias("bonus"))


@query("diff_complexity", "SELECT l_orderkey, round(0.3 * least(1.0, n / 5.0) + 0.4 * least(1.0, (a + r) / 100.0) + 0.3 * (1 - CASE WHEN a + r > 0 THEN abs(a - r) / (a + r) ELSE 0 END), 6) AS complexity FROM (SELECT l_orderkey, COUNT(*) AS n, SUM(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS a, SUM(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY 1)")
def _(t):
    even = F.col("l_linenumber") % 2 == 0
    p = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(even, F.col("l_quantity")).otherwise(0.0)).alias("a"), F.sum(F.when(~even, F.col("l_quantity")).otherwise(0.0)).alias("r"))
    return p.select("l_orderkey", r6(S.diff_complexity("n", "a", "r")).alias("complexity"))


@query("uncertainty_metrics", "SELECT l_orderkey, l_linenumber, round(CASE WHEN p <= 0 OR p >= 1 THEN 0.0 ELSE -(p * log2(p)) - (1 - p) * log2(1 - p) END, 6) AS entropy, round(p * (1 - p), 6) AS variance FROM (SELECT *, l_discount * 10 AS p FROM lineitem)")
def _(t):
    e, v = S.uncertainty(F.col("l_discount") * 10)
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(e).alias("entropy"), r6(v).alias("variance"))


@query("edge_confidence", "SELECT l_orderkey, l_linenumber, round(least(0.95, greatest(0.15, 0.5 + CASE l_returnflag WHEN 'R' THEN 0.35 WHEN 'A' THEN 0.2 ELSE 0.1 END + CASE WHEN l_linenumber = 1 THEN 0.05 ELSE 0 END + CASE WHEN l_quantity > 25 THEN 0.05 ELSE 0 END - CASE WHEN l_tax > 0.05 THEN 0.1 ELSE 0 END - CASE WHEN l_linestatus = 'O' THEN 0.15 ELSE 0 END)), 6) AS confidence FROM lineitem")
def _(t):
    source = F.when(F.col("l_returnflag") == "R", "compiler").when(F.col("l_returnflag") == "A", "parser").otherwise("heuristic")
    c = S.edge_confidence(source, F.col("l_linenumber") == 1, F.col("l_quantity") > 25, F.col("l_tax") > 0.05, F.col("l_linestatus") == "O")
    return t.lineitem.select("l_orderkey", "l_linenumber", r6(c).alias("confidence"))


OUTCOMES = "WITH o AS (SELECT l_partkey AS id, COUNT(*) AS n, SUM(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS s FROM lineitem GROUP BY 1) "


def outcomes(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("s"))


@query("wilson_interval", OUTCOMES + "SELECT id, round(greatest(0, (s/n + z*z/(2*n))/(1+z*z/n) - z*sqrt((s/n)*(1-s/n)/n + z*z/(4.0*n*n))/(1+z*z/n)), 6) AS low, round(least(1, (s/n + z*z/(2*n))/(1+z*z/n) + z*sqrt((s/n)*(1-s/n)/n + z*z/(4.0*n*n))/(1+z*z/n)), 6) AS high FROM (SELECT id, CAST(n AS DOUBLE) AS n, CAST(s AS DOUBLE) AS s, CAST(1.959963984540054 AS DOUBLE) AS z FROM o)")
def _(t):
    low, high = C.wilson("s", "n")
    return outcomes(t).select("id", r6(low).alias("low"), r6(high).alias("high"))


@query("bayes_posterior", OUTCOMES + "SELECT id, round((0.5 + s) / (1.0 + n), 6) AS mean, round((0.5 + s) * (0.5 + n - s) / ((1.0 + n) * (1.0 + n) * (2.0 + n)), 6) AS variance, round((s + 2.0) / (n + 5.0), 6) AS smoothed FROM o")
def _(t):
    a, b = 0.5 + F.col("s"), 0.5 + F.col("n") - F.col("s")
    return outcomes(t).select("id", r6(C.beta_mean(a, b)).alias("mean"), r6(C.beta_variance(a, b)).alias("variance"), r6(C.smooth("s", "n", 2.0, 3.0)).alias("smoothed"))


@query("bayes_interval", OUTCOMES + "SELECT id, round(greatest(0.0, m - 1.96 * sqrt(v)), 6) AS low, round(least(1.0, m + 1.96 * sqrt(v)), 6) AS high FROM (SELECT id, (0.5 + s) / (1.0 + n) AS m, (0.5 + s) * (0.5 + n - s) / ((1.0 + n) * (1.0 + n) * (2.0 + n)) AS v FROM o)")
def _(t):
    low, high = C.beta_interval(0.5 + F.col("s"), 0.5 + F.col("n") - F.col("s"))
    return outcomes(t).select("id", r6(low).alias("low"), r6(high).alias("high"))


@query("bayes_ordered_fold", "WITH RECURSIVE x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, l_returnflag <> 'R' AS ok FROM lineitem), f AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS i, CAST(0.5 AS DOUBLE) AS p FROM x UNION ALL SELECT f.l_orderkey, x.i, least(0.95, greatest(0.05, p + 0.7 * (CASE WHEN ok THEN p * 0.85 / (p * 0.85 + (1 - p) * 0.35) ELSE p * (1 - 0.85) / (p * (1 - 0.85) + (1 - p) * (1 - 0.35)) END - p))) FROM f JOIN x ON x.l_orderkey = f.l_orderkey AND x.i = f.i + 1) SELECT l_orderkey, round(arg_max(p, i), 6) AS p FROM f GROUP BY 1")
def _(t):
    ordered = t.lineitem.withColumn("ok", F.col("l_returnflag") != "R").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "ok"))).alias("o"))
    return ordered.select("l_orderkey", r6(C.bayes_fold(F.lit(0.5), F.transform("o", lambda x: x["ok"]))).alias("p"))


@query("information_gain", OUTCOMES + "SELECT id, round(q * log2(q / p) + (1 - q) * log2((1 - q) / (1 - p)), 6) AS bits FROM (SELECT id, 0.5 AS p, (0.5 + s) / (1.0 + n) AS q FROM o)")
def _(t):
    return outcomes(t).select("id", r6(C.information_gain(F.lit(0.5), (0.5 + F.col("s")) / (1.0 + F.col("n")))).alias("bits"))


@query("entropy_of_event_types", "SELECT user_id, round(-SUM(p * log2(p)), 6) AS bits FROM (SELECT user_id, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def _(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    packed = n.groupBy("user_id").agg(F.array_sort(F.collect_list("n")).alias("n"))
    return packed.select("user_id", r6(C.entropy_bits(F.col("n"))).alias("bits"))


@query("kl_and_js_divergence", "WITH m AS (SELECT c_nationkey AS k, c_custkey % 3 AS b, COUNT(*) + 1.0 AS n FROM customer GROUP BY 1, 2), f AS (SELECT k, b, COALESCE(n, 1.0) AS n FROM (SELECT DISTINCT k FROM m) CROSS JOIN (VALUES (0), (1), (2)) v(b) LEFT JOIN m USING (k, b)), p AS (SELECT k, n / SUM(n) OVER (PARTITION BY k) AS p, 1.0 / 3 AS q FROM f) SELECT k, round(SUM(p * log2(p / q)), 6) AS kl, round(SUM(0.5 * p * log2(p / ((p + q) / 2)) + 0.5 * q * log2(q / ((p + q) / 2))), 6) AS js FROM p GROUP BY k")
def _(t):
    n = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(*[(F.count(F.when(F.col("c_custkey") % 3 == b, 1)) + 1.0).alias(f"n{b}") for b in range(3)])
    total = F.col("n0") + F.col("n1") + F.col("n2")
    p, q = F.array(*[F.col(f"n{b}") / total for b in range(3)]), F.array(*[F.lit(1.0 / 3)] * 3)
    return n.select("k", r6(C.kl_bits(p, q)).alias("kl"), r6(C.js_bits(p, q)).alias("js"))


@query("mutual_information", "WITH j AS (SELECT event_type, user_id % 4 AS g, COUNT(*) / (SELECT COUNT(*) FROM events) AS p FROM events GROUP BY 1, 2), a AS (SELECT event_type, SUM(p) AS pa FROM j GROUP BY 1), b AS (SELECT g, SUM(p) AS pb FROM j GROUP BY 1) SELECT round(SUM(p * log2(p / (pa * pb))), 6) AS bits FROM j JOIN a USING (event_type) JOIN b USING (g)")
def _(t):
    from loomstone.operators.windows import with_totals

    n = t.events.groupBy("event_type", (F.col("user_id") % 4).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    j = with_totals(n, total=F.sum("n")).select("event_type", "g", (F.col("n") / F.col("total")).alias("p"))
    a, b = j.groupBy("event_type").agg(F.sum("p").alias("pa")), j.groupBy("g").agg(F.sum("p").alias("pb"))
    return j.join(a, "event_type").join(b, "g").agg(r6(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("pa") * F.col("pb"))))).alias("bits"))


GROUPED = "WITH g AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 7 THEN NULL ELSE 1 - l_discount END AS c FROM lineitem) "


@query("confidence_algebra", GROUPED + "SELECT k, CASE WHEN COUNT(*) = COUNT(c) THEN round(min(c), 6) END AS seq, CASE WHEN COUNT(*) = COUNT(c) THEN round(product(c), 6) END AS all_, CASE WHEN COUNT(*) = COUNT(c) THEN round(1 - product(1 - c), 6) END AS any_, CASE WHEN COUNT(*) = COUNT(c) THEN round(0.7 * product(c) + 0.3 * min(c), 6) END AS all_correlated, round(0.7 * (1 - product(1 - c)) + 0.3 * max(c), 6) AS any_skipping FROM g GROUP BY k")
def _(t):
    g = t.lineitem.select(F.col("l_orderkey").alias("k"), F.when(F.col("l_linenumber") != 7, 1 - F.col("l_discount")).alias("c"))
    return g.groupBy("k").agg(r6(C.sequence_confidence("c")).alias("seq"), r6(C.parallel_all("c")).alias("all_"), r6(C.parallel_any("c")).alias("any_"), r6(C.parallel_all("c", 0.3)).alias("all_correlated"), r6(C.parallel_any("c", 0.3, True)).alias("any_skipping"))


@query("interval_operations", "SELECT l_orderkey, round(min(1 - l_discount - 0.1), 6) AS and_low, round(min(1 - l_discount), 6) AS and_high, round(1 - product(l_discount + 0.1), 6) AS or_low, round(1 - product(l_discount), 6) AS or_high FROM lineitem GROUP BY 1")
def _(t):
    low, high = 0.9 - F.col("l_discount"), 1 - F.col("l_discount")
    (al, ah), (ol, oh) = C.interval_and(low, high), C.interval_or(low, high)
    return t.lineitem.groupBy("l_orderkey").agg(r6(al).alias("and_low"), r6(ah).alias("and_high"), r6(ol).alias("or_low"), r6(oh).alias("or_high"))


@query("opinion_pools", "SELECT l_orderkey, round(SUM(p * w) / SUM(w), 6) AS linear_, round(COALESCE(1 / (1 + exp(-SUM(CASE WHEN p > 0 AND p < 1 THEN w * ln(p / (1 - p)) END) / SUM(CASE WHEN p > 0 AND p < 1 THEN w END))), 0.5), 6) AS log_ FROM (SELECT l_orderkey, l_discount * 10 AS p, l_quantity AS w FROM lineitem) GROUP BY 1")
def _(t):
    x = t.lineitem.select("l_orderkey", (F.col("l_discount") * 10).alias("p"), F.col("l_quantity").alias("w"))
    return x.groupBy("l_orderkey").agg(r6(C.linear_pool("p", "w")).alias("linear_"), r6(C.log_pool("p", "w")).alias("log_"))


@query("aggregate_confidence", "SELECT l_orderkey, round(exp(SUM(l_quantity * ln(greatest(l_discount * 10, 0.001))) / SUM(l_quantity)), 6) AS confidence FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(r6(C.weighted_geometric_mean(F.col("l_discount") * 10, "l_quantity")).alias("confidence"))


@query("decay_kinds", "SELECT event_id, round(CASE WHEN value > 50 THEN 0.0 ELSE 0.8 END, 6) AS step, round(0.8 * greatest(0.0, 1 - value / 50), 6) AS linear_, round(0.8 * pow(0.5, value / 50), 6) AS exponential FROM events")
def _(t):
    d = lambda k: r6(C.bounded_decay(0.8, "value", k, 50.0))
    return t.events.select("event_id", d("step").alias("step"), d("linear").alias("linear_"), d("exponential").alias("exponential"))


@query("formula_evaluation", "SELECT o_orderkey, round(least(1.0, 0.5 * (o_custkey % 10 / 10.0) + 0.5 * greatest(o_orderkey % 7 / 7.0, o_orderkey % 3 / 3.0)), 6) AS v FROM orders")
def _(t):
    half = {"op": "const", "value": 0.5}
    tree = {"op": "min", "args": [{"op": "const", "value": 1}, {"op": "add", "args": [{"op": "mul", "args": [half, {"op": "input", "name": "a"}]}, {"op": "mul", "args": [half, {"op": "max", "args": [{"op": "input", "name": "b"}, {"op": "input", "name": "c"}]}]}]}]}
    values = {"a": F.col("o_custkey") % 10 / 10.0, "b": F.col("o_orderkey") % 7 / 7.0, "c": F.col("o_orderkey") % 3 / 3.0}
    return t.orders.select("o_orderkey", r6(C.evaluate_formula(tree, values)).alias("v"))


@query("belief_masses", "SELECT event_id, round(0.5 + v * 0.3, 6) AS belief, round(1.0 - (1 - v) * 0.2, 6) AS plausibility, round(0.5 + v * 0.3 / 1 + (0.5 - v * 0.3 - (1 - v) * 0.2) / 2, 6) AS pignistic FROM (SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS v FROM events)")
def _(t):
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    focal = lambda members, mass: F.struct(F.array(*[F.lit(m) for m in members]).alias("members"), mass.alias("mass"))
    masses = F.array(focal("a", 0.5 + v * 0.3), focal("b", (1 - v) * 0.2), focal("ab", 0.5 - v * 0.3 - (1 - v) * 0.2))
    a = F.array(F.lit("a"))
    return t.events.select("event_id", r6(C.belief(masses, a)).alias("belief"), r6(C.plausibility(masses, a)).alias("plausibility"), r6(C.pignistic(masses, "a")).alias("pignistic"))


@query("dempster_combine", "SELECT event_id, round((0.6 * v + 0.6 * (1 - v) + 0.4 * v) / 1.0, 6) AS mass_a FROM (SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS v FROM events)")
def _(t):
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100))
    focal = lambda members, mass: F.struct(F.array(*[F.lit(m) for m in members]).alias("members"), mass.alias("mass"))
    one = F.array(focal("a", F.lit(0.6)), focal("ab", F.lit(0.4)))
    two = F.array(focal("a", v), focal("ab", 1 - v))
    both = C.combine_dempster(one, two)
    of_a = F.filter(both, lambda m: F.size(m["members"]) == 1)
    return t.events.select("event_id", r6(F.aggregate(of_a, F.lit(0.0), lambda s, m: s + m["mass"])).alias("mass_a"))


@query("sample_size_bounds", "SELECT n, round(least(1.0, sqrt(ln(2.0 * 10 / 0.05) / (2 * n / 10))), 6) AS accuracy, CAST(ceil(ln(2.0 * 10 / 0.05) / (2 * 0.1 * 0.1)) AS BIGINT) AS needed FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS n FROM part)")
def _(t):
    return t.part.select(F.col("p_size").cast("double").alias("n")).distinct().select("n", r6(C.hoeffding_accuracy("n", 0.95, 10)).alias("accuracy"), C.hoeffding_samples(0.1, 0.95, 10).alias("needed"))


@query("doc_distinct_tokens", "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 2))), ' ') AS tokens FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", F.array_join(T.distinct_tokens("text"), " ").alias("tokens"))


@query("doc_jaccard_to_item", "WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 2)) AS w FROM benchmark), z AS (SELECT w FROM b WHERE item_id = 0) SELECT b.item_id, round(len(list_intersect(b.w, z.w)) / len(list_distinct(list_concat(b.w, z.w))), 6) AS jaccard, round(2 * len(list_intersect(b.w, z.w)) / (len(b.w) + len(z.w)), 6) AS dice FROM b, z")
def _(t):
    b = t.benchmark.select("item_id", T.distinct_tokens("text").alias("w"))
    z = b.where("item_id = 0").select(F.col("w").alias("z"))
    return b.crossJoin(F.broadcast(z)).select("item_id", r6(T.jaccard(F.col("w"), F.col("z"))).alias("jaccard"), r6(T.dice(F.col("w"), F.col("z"))).alias("dice"))


@query("intent_normalize")
def _(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", T.normalize_intent("text").alias("intent"))


@query("intent_behavior_coherence", "WITH c AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS a, max(CASE WHEN turn = 1 THEN text END) AS b FROM conversations GROUP BY 1), w AS (SELECT conv_id, list_distinct(list_filter(regexp_split_to_array(lower(a), '[^a-z0-9_]+'), lambda x: length(x) >= 2)) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b), '[^a-z0-9_]+'), lambda x: length(x) >= 2)) AS y FROM c WHERE a IS NOT NULL AND b IS NOT NULL) SELECT conv_id, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(x) END, 6) AS coherence FROM w")
def _(t):
    c = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"))
    return c.where("a is not null and b is not null").select("conv_id", r6(T.coherence("a", "b")).alias("coherence"))


@query("char_entropy_scan", "SELECT page_id, round(-SUM(p * log2(p)), 6) AS bits FROM (SELECT page_id, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY page_id) AS p FROM (SELECT page_id, unnest(string_split(url, '')) AS ch FROM pages) GROUP BY page_id, ch) GROUP BY page_id")
def _(t):
    return t.pages.select("page_id", r6(T.char_entropy("url")).alias("bits"))


@query("token_estimate", "SELECT conv_id, turn, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost_tokens FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", T.estimate_tokens("text").alias("tokens"), T.estimate_tokens("text", 4.0).alias("cost_tokens"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(t):
    return t.documents.select("doc_id", T.content_hash("text").alias("hash"))


@query("edge_ids", "SELECT DISTINCT substr(sha256(l_partkey || ':' || l_suppkey || ':' || l_returnflag), 1, 32) AS id FROM lineitem")
def _(t):
    return t.lineitem.select(T.edge_id(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag").alias("id")).distinct()


@query("secret_scan", "SELECT doc_id, CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'aws_key' WHEN regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{36}') THEN 'github_token' WHEN regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private_key' ELSE 'none' END AS secret FROM documents")
def _(t):
    rules = [r for r in T.SECRET_RULES if r[1] in ("aws_key", "github_token", "private_key")]
    return t.documents.select("doc_id", T.first_rule("text", rules, "none").alias("secret"))


@query("page_languages", "SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/(fr|de|es)/') THEN 'other' ELSE 'none' END AS kind FROM pages")
def _(t):
    return t.pages.select("page_id", T.first_rule("url", [("/en/", "english"), ("/(fr|de|es)/", "other")], "none").alias("kind"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("retrieval_escalation", "SELECT user_id, CASE WHEN m < 0.2 THEN 'full' WHEN m < 0.4 OR e > 2.0 THEN 'deep' WHEN m < 0.6 OR e > 1.5 THEN 'widen' ELSE 'none' END AS step FROM (SELECT user_id, round(avg(least(1, greatest(0, value / 100))), 6) AS m, round(COUNT(*) % 5 / 2.0, 6) AS e FROM events GROUP BY 1)")
def _(t):
    g = t.events.groupBy("user_id").agg(r6(F.avg(S.clamp01(F.col("value") / 100))).alias("m"), (F.count(F.lit(1)) % 5 / 2.0).alias("e"))
    return g.select("user_id", S.escalation("m", "e").alias("step"))
