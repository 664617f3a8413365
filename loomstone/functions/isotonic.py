"""Isotonic calibration by pooling adjacent violators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.session import ship


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray, x_end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a non-decreasing fit: (least x, greatest x, value, weight). x ascending; x_end: where each already pooled one ends."""
    low, high, value, weight = [], [], [], []
    for a, z, v, k in zip(x.tolist(), (x if x_end is None else x_end).tolist(), y.tolist(), w.tolist(), strict=True):
        low.append(a)
        high.append(z)
        value.append(v)
        weight.append(k)
        while len(value) > 1 and value[-2] > value[-1]:
            total = weight[-2] + weight[-1]
            value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / total]
            weight[-2:] = [total]
            high[-2:] = [high[-1]]
            low.pop()
    return np.array(low), np.array(high), np.array(value), np.array(weight)


def fit_isotonic(samples: DataFrame, score: str, outcome: str) -> DataFrame:
    """(low, high, value): the steps of the fitted map.

    Samples of equal scores are averaged, the scores range-sorted, and violators pooled within each range by its task;
    pooling goes on the same from there, in whatever order. The driver gets the pooled blocks only: steps of the ranges,
    not scores. Null scores and outcomes are left out; without any sample there are no steps.
    """
    spark = samples.sparkSession
    ship(spark)
    grouped = samples.groupBy(F.col(score).cast("double").alias("x")).agg(F.avg(outcome).alias("y"), F.count(outcome).alias("w")).where("x is not null and y is not null and not isnan(x)")

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the blocks so far of this range, which grow as scores come in order
        for f in frames:
            new = (f["x"].to_numpy(), f["y"].to_numpy(), f["w"].to_numpy(float), f["x"].to_numpy())
            low, high, value, weight = pool(*(new if held is None else (np.concatenate(c) for c in zip(held, new, strict=True))))
            held = low, value, weight, high
        if held is not None:
            yield pd.DataFrame(dict(zip(("x", "y", "w", "z"), held, strict=True)))

    blocks = grouped.repartitionByRange("x").sortWithinPartitions("x").mapInPandas(within, "x double, y double, w double, z double")
    rows = sorted(tuple(r) for r in blocks.toLocalIterator())
    if not rows:
        return spark.createDataFrame([], "low double, high double, value double")
    low, high, value, _ = pool(*(np.array(c, float) for c in zip(*rows, strict=True)))
    return samples.sparkSession.createDataFrame([(float(a), float(b), float(v)) for a, b, v in zip(low, high, value, strict=True)], "low double, high double, value double")


def apply_isotonic(mapping: list[tuple[float, float]], score) -> object:
    """Piecewise linear through (score, value) points, as a Column; flat beyond the ends."""
    points = sorted(mapping)
    s = F.col(score) if isinstance(score, str) else score
    out = F.when(s <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(s <= x1, y0 + (s - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0))
    return out.otherwise(points[-1][1])
