"""Table access: named tables of a folder, slices of allowed methods, upserts and deletes as rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The parquet tables of a folder as attributes: Tables(spark, folder).orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


#: The storage slices and the tables each may touch.
SLICES = {
    "functions": ("functions",),
    "modules": ("modules",),
    "files": ("files", "directories"),
    "symbols": ("symbols",),
    "graph": ("edges", "knowledge_edges", "graph_metrics"),
    "embeddings": ("embeddings", "multi_vectors"),
    "packs": ("context_packs",),
    "ledger": ("evidence_ledger",),
    "epistemics": ("claims", "claim_edges", "defeaters", "contradictions"),
    "history": ("commits", "blame", "diffs", "reflog"),
    "analysis": ("bayesian", "stability", "debt", "clones", "feedback_loops"),
    "state": ("state",),
}


class Slice:
    """A view of Tables that only reaches the tables of one slice."""

    def __init__(self, tables: Tables, name: str):
        self._tables, self._allowed = tables, SLICES[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._allowed:
            raise AttributeError(f"{name} is not in this slice")
        return getattr(self._tables, name)


def all_of(*predicates: Column | None) -> Column:
    """The conjunction of those predicates that are given; true if none is."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows put in: rows replace those of equal key. rows must be unique by key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    """table without the rows for which predicate is true; rows for which it is null stay."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def append_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """An append-only ledger: rows whose key is already there are left out."""
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"))
