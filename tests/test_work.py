"""Debts, priorities, causes and trends on small rows, with nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from loomstone.functions import debts as D
from loomstone.functions import priorities as P
from loomstone.operators import causal, evidence


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_debts(spark):
    none, lit = F.lit(None), F.lit
    got = values(
        spark,
        *[D.coverage_debt(lit(c), lit(True)) for c in (0.0, 0.2, 0.4, 0.6, 0.8)], D.coverage_debt(none.cast("double"), lit(True)), D.coverage_debt(lit(0.9), none.cast("boolean")),
        D.documentation_debt(none.cast("string"), lit("x" * 20)), D.security_debt(lit(80)), D.security_debt(none.cast("int")),
        D.duplication_debt({k: lit(1) for k in D.CLONES}, lit(201)), D.duplication_debt({"exact": none.cast("int")}, none.cast("int")),
        D.architecture_debt(lit(2), lit(True), {"critical": lit(5)}), D.architecture_debt(lit(1), lit(True), {"low": none.cast("int")}),
        D.fix_hours(lit(45.0), {"architecture": lit(51), "security": lit(50), "complexity": lit(71)}),
    )
    assert got == [50, 35, 20, 10, 0, 25, 50, 30, 35, 0, 100, 0, 100, 0, 16.5]


def test_priorities(spark):
    lit, text, array = F.lit, F.lit(None).cast("string"), lambda *x: F.array(*map(F.lit, x))
    nulls = F.lit(None).cast("array<string>")
    got = values(
        spark,
        P.strategic_alignment(F.lit(None).cast("array<int>")), P.strategic_alignment(F.array().cast("array<int>")), P.strategic_alignment(array(1, 3)),
        P.user_impact(text, text, text), P.user_impact(lit("low"), lit("1001"), lit("difficult")), P.user_impact(lit("critical"), lit("all"), text),
        P.risk_reduction(nulls, text, text), P.risk_reduction(array("Data-Integrity", "ui"), lit("high"), lit("debt")),
        P.effort_value(text, text), P.effort_value(lit("critical"), lit("trivial")),
        P.external_pressure(F.lit(None).cast("int"), lit(True), lit(2), nulls), P.external_pressure(lit(-1), lit(True), F.lit(None).cast("int"), array("GDPR")), P.external_pressure(lit(14), lit(False), lit(0), nulls),
    )
    assert [round(x, 6) for x in got] == [50, 30, 100, 50.0, round(40 * 1.2 * 1.15, 6), 100.0, 30, 100, 30.0, 90.25, 40, 100, 30]


def test_causal_graph(spark):
    calls = spark.createDataFrame([("f", "g"), ("f", "g"), ("g", "h"), (None, "h")], "caller string, callee string")
    events = spark.createDataFrame([("e1", 1, None, "h"), ("e2", 2, "e1", "nobody"), ("e3", 3, "e9", None), ("e0", 0, "e2", "f")], "id string, seq long, cause string, source string")
    edges = causal.causal_edges(calls, events)
    got = {(r["src"], r["dst"]): (r["strength"], r["evidence"]) for r in edges.collect()}
    assert got == {("f", "g"): (1.0, 2), ("g", "h"): (1.0, 1), ("h", "e1"): (0.9, 1), ("e1", "e2"): (1.0, 1), ("f", "e0"): (0.9, 1)}
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    assert {(r["id"], r["depth"], r["is_first"]) for r in causal.causes(edges, one("e2"), 9).collect()} == {("e1", 1, False), ("h", 2, False), ("g", 3, False), ("f", 4, True)}
    assert {(r["id"], r["depth"], r["is_last"]) for r in causal.effects(edges, one("f"), 1).collect()} == {("g", 1, False), ("e0", 1, True)}
    assert causal.causes(edges, one("e2"), 9, least=0.95).count() == 1
    assert causal.effects(edges, one("absent"), 3).count() == 0
    mere = edges.withColumn("kind", F.lit("correlates"))
    assert causal.causes(mere, one("e2"), 9).count() == 0 and causal.effects(mere, one("e1"), 9).count() == 1
    assert causal.causal_edges(calls.limit(0), events.limit(0)).count() == 0


def test_trends(spark):
    rows = [("up", i, 0.1 * i) for i in range(10)] + [("down", i, -0.2 * i) for i in range(3)] + [("flat", i, 0.5) for i in range(4)] + [("lone", 0, 0.7), ("none", 0, None)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    got = {r["k"]: (r["trend"], round(r["rate"], 6), r["periods"], round(r["confidence"], 6)) for r in evidence.progress_trend(df, ["k"], ["t"], "y").collect()}
    assert got == {"up": ("improving", 0.1, 10, 1.0), "down": ("declining", -0.2, 3, 0.3), "flat": ("stable", 0.0, 4, 0.0), "lone": ("improving", 0.7, 1, 0.1)}
    found = {r["k"]: (r["trend"], r["samples"]) for r in evidence.calibration_trend(df, ["k"], [F.desc("t")], "y").collect()}
    assert found == {"up": ("degrading", 5), "down": ("improving", 3), "flat": ("stable", 4), "lone": ("stable", 1), "none": ("stable", 1)}
    assert evidence.progress_trend(df.limit(0), ["k"], ["t"], "y").count() == 0


@pytest.mark.parametrize("weights", [(0.4, 1.0, 1.0), (1.0, 0.4, 1.0), (1.0, 1.0, 0.4)])
def test_severity_does_not_depend_on_the_order_of_sums(spark, weights):
    from loomstone.operators import insights

    e = spark.createDataFrame([(0, 1, "contradicts", w) for w in weights], "src int, dst int, kind string, weight double")
    assert insights.conflict(e.coalesce(1)).first()["severity"] == "critical"
