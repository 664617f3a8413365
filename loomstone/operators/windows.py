"""Window-shaped operators: runs, deltas, trends, ranks, normalising over a whole set without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_totals(df: DataFrame, **totals: Column) -> DataFrame:
    """df with aggregates over all its rows in every row: one row is made and broadcast, nothing goes to one task."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(k) for k, c in totals.items()])))


def runs(df: DataFrame, by: list[str], order: str, same: list[str], length: str | None = None) -> DataFrame:
    """Gaps and islands: consecutive rows (order rises by 1, or starts where the last one of `length` ended) with equal `same` columns.

    Returns by..., same..., start, stop, rows.
    """
    w = Window.partitionBy(*by).orderBy(order)
    end = F.col(order) + (F.col(length) if length else F.lit(1))
    before = F.lag(end).over(w)
    fresh = before.isNull() | (before != F.col(order))
    for c in same:
        fresh = fresh | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = df.withColumn("_end", end).withColumn("_new", fresh.cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_run", *same).agg(F.min(order).alias("start"), (F.max("_end") - 1).alias("stop"), F.count(F.lit(1)).alias("rows")).drop("_run")


def deltas(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def spikes(df: DataFrame, by: list[str], order: list, value: str, least: float) -> DataFrame:
    return deltas(df, by, order, value).where(F.abs("delta") >= least)


def stability(df: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Per group: n, volatility (population deviation of first differences), slope on 0..n-1, AR(1) coefficient and half life; zeros for under 2 rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_d": F.col(value) - F.lag(value).over(w), "_prev": F.lag(value).over(w)})
    mean = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    rows = rows.join(mean, by).withColumns({"_x": F.col(value) - F.col("_mean"), "_y": F.col("_prev") - F.col("_mean")})
    phi = F.sum(F.col("_x") * F.col("_y")) / F.sum(F.when(F.col("_y").isNotNull(), F.col("_y") * F.col("_y")))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_pop("_d"), F.lit(0.0)).alias("volatility"), F.coalesce(F.regr_slope(F.col(value), F.col("_i")), F.lit(0.0)).alias("slope"), F.coalesce(phi, F.lit(0.0)).alias("phi"))
    rate = -F.log(F.abs("phi") + 0.001)
    return out.withColumn("half_life", F.when((F.col("n") < 2) | (rate == 0), 0.0).otherwise(F.log(F.lit(2.0)) / F.abs(rate)))


def trend_last(df: DataFrame, by: list[str], order: list, success: Column, size: int = 10, band: float = 0.1) -> DataFrame:
    """The success rate of the newest `size` rows against the `size` before them: improving, declining or stable (also for fewer rows than `size`)."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    ok = success.cast("double")
    out = ranked.where(F.col("_n") <= 2 * size).groupBy(*by).agg(F.count(F.lit(1)).alias("seen"), F.avg(F.when(F.col("_n") <= size, ok)).alias("recent"), F.avg(F.when(F.col("_n") > size, ok)).alias("earlier"))
    change = F.col("recent") - F.coalesce("earlier", "recent")
    return out.withColumn("trend", F.when(F.col("seen") < size, "stable").when(change > band, "improving").when(change < -band, "declining").otherwise("stable"))


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """(v - min) / (max - min) over all rows; with no span 1 if the maximum is positive, else 0."""
    span = F.col("_max") - F.col("_min")
    scaled = F.when(span > 0, (F.col(value) - F.col("_min")) / span).otherwise(F.when(F.col("_max") > 0, 1.0).otherwise(0.0))
    return with_totals(df, _min=F.min(value), _max=F.max(value)).withColumn(out, scaled).drop("_min", "_max")


def over_max(df: DataFrame, value: str, out: str, floor: float = 0.001) -> DataFrame:
    return with_totals(df, _max=F.max(value)).withColumn(out, F.col(value) / F.greatest("_max", F.lit(floor))).drop("_max")


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float, from_zero: bool = True) -> DataFrame:
    """sorted[floor(n * share)] of each group (from_zero False: floor(share * (n - 1))), the last at most."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    at = F.least(F.floor(n * share) if from_zero else F.floor(F.lit(share) * (n - 1)), n - 1)
    return df.where(F.col(value).isNotNull()).withColumns({"_i": F.row_number().over(w) - 1, "_at": at}).where("_i = _at").select(*by, value)


def global_rank(df: DataFrame, value: str, share: float, slack: float = 0.01) -> float | None:
    """sorted[floor(n * share)] of all rows, without sorting them: a bracket by approximate quantiles, an exact count below it, and the few rows inside."""
    rows = df.where(F.col(value).isNotNull()).select(value)
    n = rows.count()
    if not n:
        return None
    k = min(int(n * share), n - 1)
    while True:
        low, high = rows.agg(F.percentile_approx(value, [max(0.0, share - slack), min(1.0, share + slack)], 10000)).first()[0]
        below = rows.where(F.col(value) < low).count()
        inside = rows.where(F.col(value).between(low, high))
        if below <= k < below + inside.count():
            return inside.orderBy(value).offset(k - below).limit(1).first()[0]
        slack *= 4


def first_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def budget_cut(df: DataFrame, by: list[str], order: list, cost: str, budget: float) -> DataFrame:
    """Rows in order while their running cost stays within the budget; the first always stays, and nothing after the first overflow."""
    w = Window.partitionBy(*by).orderBy(*order)
    running = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"running": running, "_n": F.row_number().over(w)}).where((F.col("running") <= budget) | (F.col("_n") == 1)).drop("_n")
