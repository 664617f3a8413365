"""Ranking: top-k, fusion, diversification, budgets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, score: str, n: int, tie: str, least: float | None = None) -> DataFrame:
    """The n rows of the highest score, ties by id; a top-k heap per task, no full sort."""
    rows = df if least is None else df.where(F.col(score) >= least)
    return rows.orderBy(F.desc(score), tie).limit(n)


def fuse_rrf(lists: DataFrame, by: list[str], source: str, item: str, similarity: str, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (one for each `source`): rrf, similarity = greatest of its own and rrf over the best rrf."""
    within = Window.partitionBy(*by, source).orderBy(F.desc(similarity), item)
    ranked = lists.withColumn("_r", F.row_number().over(within))
    summed = ranked.groupBy(*by, item).agg(F.sum(1 / (k + F.col("_r"))).alias("rrf"), F.max(similarity).alias("best"))
    highest = F.max("rrf").over(Window.partitionBy(*by))
    scored = summed.withColumn("similarity", F.greatest("best", F.least(F.lit(1.0), F.col("rrf") / highest)))
    order = Window.partitionBy(*by).orderBy(F.desc("rrf"), F.desc("best"), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(*by, item, "rrf", "similarity", "rank")


def mmr(df: DataFrame, by: list[str], item: str, relevance: str, vector: str, balance: float = 0.5, depth: int = 1000) -> DataFrame:
    """Greedy maximal marginal relevance over the `depth` most relevant candidates of each query: (by..., item, place).

    Ties go to the more relevant, then the lower item; if every relevance is 0 that is the order. Candidates beyond
    depth come after them, by relevance. A task holds depth candidates of a query and takes depth squared steps; what is
    beyond is cut off before the shuffle of vectors.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(relevance), item)
    ranked = df.select(*by, item, relevance, vector).withColumn("_r", F.row_number().over(order))
    few, rest = ranked.where(F.col("_r") <= depth).drop("_r"), ranked.drop(vector).where(F.col("_r") > depth)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in few.select(*by, item).schema] + ["place int"])

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, item], ascending=[False, True]).reset_index(drop=True)
        rel = pdf[relevance].to_numpy(float)
        if not rel.any():
            return pdf.assign(place=np.arange(len(pdf), dtype=np.int32))[[*by, item, "place"]]
        v = np.stack(pdf[vector].map(np.asarray)).astype(float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        nearest, left, order = np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        while left.any():
            value = np.where(left, balance * rel - (1 - balance) * nearest, -np.inf)
            best = int(np.argmax(value))
            order.append(best)
            left[best] = False
            nearest = np.maximum(nearest, v @ v[best])
        out = pdf.iloc[order].copy()
        out["place"] = np.arange(len(order), dtype=np.int32)
        return out[[*by, item, "place"]]

    picked = few.groupBy(*by).applyInPandas(pick, schema)
    return picked.unionByName(rest.select(*by, item, (F.col("_r") - 1).cast("int").alias("place")))


def greedy_fill(df: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows in order that still fit; one that doesn't is skipped and later ones are tried. Groups are one query's candidates."""
    schema = df.schema

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c.lstrip("-") for c in order], ascending=[not c.startswith("-") for c in order])
        used, keep = 0, []
        for c in pdf[cost]:
            keep.append(used + c <= budget)
            used += c if keep[-1] else 0
        return pdf[keep]

    return df.groupBy(*by).applyInPandas(fill, schema)


def lost_in_middle(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Best items at both ends: ranks 1, 3, 5 from the front, 2, 4, 6 from the back."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ranked = df.withColumns({"_r": F.row_number().over(w), "_n": n})
    return ranked.withColumn("place", F.when(F.col("_r") % 2 == 1, (F.col("_r") + 1) / 2).otherwise(F.col("_n") + 1 - F.col("_r") / 2).cast("int")).drop("_r", "_n")


def weighted_signals(signals: dict[str, tuple[Column, float, Column]]) -> tuple[Column, Column]:
    """{name: (score, weight, confidence)} -> score = sum(w c s) / sum(w c), confidence = sum(w c) / sum(w). A signal that is null counts .5 with confidence 0."""
    top_ = sum((F.coalesce(s, F.lit(0.5)) * w * F.when(s.isNull(), 0.0).otherwise(c) for s, w, c in signals.values()), F.lit(0.0))
    wc = sum((w * F.when(s.isNull(), 0.0).otherwise(c) for s, w, c in signals.values()), F.lit(0.0))
    w = sum(w for _, w, _ in signals.values())
    return F.when(wc > 0, top_ / wc).otherwise(0.0), wc / w
