"""Scans of defeaters and contradictions, and trends of reports over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.scores import banded, col

#: The slope and the change of error from which a trend counts, the reports that make full confidence, and edges of risk
#: with the least that is reported.
SLOPE, ERROR, ENOUGH = 0.05, 0.02, 10
LEAST_RISK = 0.3
RISK_EDGES = [(0.8, "critical"), (0.6, "high"), (0.4, "medium")]


def _equal(df: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    for name, value in wanted.items():
        df = df if value is None else df.where(F.col(name) == value)
    return df


def defeaters(df: DataFrame, type: str | None = None, status: str | None = None, severity: str | None = None, claim: object = None) -> DataFrame:
    """Defeaters of a type, status and severity that affect a claim (one of the array `affected`); what isn't given isn't asked."""
    df = _equal(df, {"type": type, "status": status, "severity": severity})
    return df if claim is None else df.where(F.array_contains("affected", claim))


def contradictions(df: DataFrame, status: str | None = None, severity: str | None = None, claim: object = None) -> DataFrame:
    """Contradictions of a status and severity that have a claim on either side."""
    df = _equal(df, {"status": status, "severity": severity})
    return df if claim is None else df.where((F.col("claim_a") == F.lit(claim)) | (F.col("claim_b") == F.lit(claim)))


def epistemic_risk(load: Column | str, confidence: Column | str, vulnerability: Column | str) -> Column:
    """The risk of a claim: its load where confidence (null: 0.5) is missing, more for the vulnerable."""
    return col(load) * (1 - F.coalesce(col(confidence), F.lit(0.5))) * (1 + col(vulnerability))


def risk_level(risk: Column | str) -> Column:
    return banded(risk, RISK_EDGES, "low")


def progress_trend(reports: DataFrame, by: list[str], at: list[str], score: str) -> DataFrame:
    """(by, trend, rate, periods, confidence): the line through each group's scores in the order of `at`, its periods one apart.

    confidence is the root of the line's share of the variance, less for under ten periods. A single report rates as its score,
    with a confidence of 0.1. Null scores are left out; a group of nothing else has no row.
    """
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*at)).cast("double")
    y = F.col(score).cast("double")
    placed = reports.where(y.isNotNull()).select(*by, y.alias("y"), n.alias("x"))
    lines = placed.groupBy(*by).agg(F.count("*").alias("periods"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("fit"), F.min("y").alias("low"), F.max("y").alias("high"))
    lone = F.col("periods") == 1
    rate = F.when(lone, F.col("low")).otherwise(F.col("slope"))
    fit = F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.greatest(F.col("fit"), F.lit(0.0)))
    sure = F.when(lone, 0.1).otherwise(F.least(F.lit(1.0), F.sqrt(fit) * F.least(F.lit(1.0), F.col("periods") / ENOUGH)))
    least = F.when(lone, 0.0).otherwise(SLOPE)
    trend = F.when(rate > least, "improving").when((rate < -least) & ~lone, "declining").otherwise("stable")
    return lines.select(*by, trend.alias("trend"), rate.alias("rate"), "periods", sure.alias("confidence"))


def calibration_trend(reports: DataFrame, by: list[str], newest_first: list[Column], error: str, newest: int = 5) -> DataFrame:
    """(by, trend, samples): the mean error of the newer half of the newest reports against the older half (the larger, if odd).

    A single report, or a null error among them, is stable.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*newest_first))
    last = reports.select(*by, F.col(error).alias("e"), rank.alias("n")).where(F.col("n") <= newest)
    last = last.groupBy(*by).agg(F.count("*").alias("samples"), F.array_sort(F.collect_list(F.struct("n", "e"))).alias("all"))
    half = F.floor(F.col("samples") / 2)
    mean = lambda test: F.aggregate(F.filter("all", lambda r: test(r["n"])), F.lit(0.0), lambda acc, r: acc + r["e"])
    better = mean(lambda n: n > half) / (F.col("samples") - half) - F.try_divide(mean(lambda n: n <= half), half)
    return last.select(*by, F.when(better > ERROR, "improving").when(better < -ERROR, "degrading").otherwise("stable").alias("trend"), "samples")
