"""Join-shaped operators. Every one is an equi-join at its core: overlaps go over buckets, suffixes over their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_join(left: DataFrame, array: str, item: str, right: DataFrame, key: str) -> DataFrame:
    """left with one row for each distinct array item that is a key of right."""
    return left.withColumn(item, F.explode(F.array_distinct(array))).join(right, F.col(item) == right[key])


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def left_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join in which a missing value of right is a default."""
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def only_new(candidates: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return candidates.join(known, on, "left_anti")


def flag_members(df: DataFrame, members: DataFrame, on: str, flag: str) -> DataFrame:
    """df with a boolean that tells whether its key is among members; no row is repeated."""
    return df.join(members.select(F.col(on), F.lit(True).alias(flag)).distinct(), on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def pairs_within(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group..., a, b, a < b) of the distinct items of a group. Meant for groups of bounded size, such as a commit's first files."""
    one = df.select(*group, item).distinct()
    a, b = one.withColumnRenamed(item, "a"), one.withColumnRenamed(item, "b")
    return a.join(b, group).where("a < b")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], bucket: int = 100) -> DataFrame:
    """Rows whose closed intervals [start, stop] meet: columns of left, of right (other_start, other_stop, ...) and overlap.

    Intervals are spread over buckets of fixed width and joined on those; a pair is kept in the first bucket they share.
    """
    def spread(df: DataFrame, start: str, stop: str) -> DataFrame:
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(stop) / bucket))))

    other = right.withColumnsRenamed({c: f"other_{c}" for c in right.columns if c not in on})
    met = spread(left, "start", "stop").join(spread(other, "other_start", "other_stop"), [*on, "_b"])
    low, high = F.greatest("start", "other_start"), F.least("stop", "other_stop")
    return met.where((low <= high) & (F.col("_b") == F.floor(low / bucket))).withColumn("overlap", high - low + 1).drop("_b")


def suffix_join(names: DataFrame, paths: DataFrame) -> DataFrame:
    """names (name) to paths (path): the equal path, else the only path that ends with /name, else the only one of the same last part.

    Every path is exploded into its suffixes, so all three steps are equi-joins. Returns (name, path, how); unresolved names are left out.
    """
    parts = F.split("path", "/")
    suffixes = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("key"))
    last = F.element_at(F.split("name", "/"), -1)
    exact = names.join(paths, names["name"] == paths["path"]).select("name", "path", F.lit(0).alias("step"))
    by_suffix = names.join(suffixes, names["name"] == suffixes["key"]).select("name", "path", F.lit(1).alias("step"))
    base = paths.select("path", F.element_at(parts, -1).alias("key"))
    by_base = names.select("name", last.alias("key")).join(base, "key").select("name", "path", F.lit(2).alias("step"))
    every = exact.union(by_suffix).union(by_base).distinct()
    counted = every.groupBy("name", "step").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n = 1")
    best = counted.groupBy("name").agg(F.min_by(F.struct("step", "path"), "step").alias("m"))
    return best.select("name", "m.path", F.element_at(F.array(F.lit("exact"), F.lit("suffix"), F.lit("basename")), F.col("m.step") + 1).alias("how"))


def merge_candidates(primary: DataFrame, additions: DataFrame, key: list[str], signals: list[str], first: list[str] = ()) -> DataFrame:
    """Full outer merge by key: the greatest of each signal, and of the `first` columns the primary's value or else the other's."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(additions.withColumn("_p", F.lit(1)))
    return both.groupBy(*key).agg(*[F.max(s).alias(s) for s in signals], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in first])


def merge_graph_results(graph: DataFrame, candidates: DataFrame, on: str = "id") -> DataFrame:
    """Candidates (id, score) boosted by 0.3 where the graph (id, confidence) has them, and the graph's others at 0.85 + 0.1 * confidence."""
    flagged = flag_members(candidates, graph, on, "in_graph").select(on, F.when(F.col("in_graph"), F.least(F.lit(1.0), F.col("score") + 0.3)).otherwise(F.col("score")).alias("score"))
    return flagged.unionByName(only_new(graph, candidates, [on]).select(on, (0.85 + 0.1 * F.col("confidence")).alias("score")))


def last_defined(*columns: Column) -> Column:
    """The last of the columns that is not null."""
    return F.coalesce(*reversed(columns))


def difference(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Entity by entity: added, removed, changed or same."""
    left = a.select(*key, F.struct(*values).alias("_a"))
    right = b.select(*key, F.struct(*values).alias("_b"))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return left.join(right, key, "full").select(*key, state.alias("state"))
