"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a document gets a virtual finish time, its source's cumulative words divided by the
source's target, in a fixed shuffled order; copies are range-sorted by that time and the sorted list
is cut at the total budget. Running sums are built in two levels (within a slice, over slices; within
a range, over ranges), so no task ever holds a source or the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import drop, free_names, partitions, ready, staged, table

#: The weights of the sources in order, over and over; share of all words; passes over a source at most.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Slices of a source's shuffled order are the first hex digits of the shuffle key.
SLICE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size) -> + weight, target: shares by weight, stopped at passes x size, the excess reshared.

    The reshared targets are min(cap, weight x level). The level comes from running sums over the sources in
    order of cap / weight: one row a source, so these windows hold the source list and not its documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sources.withColumn("source_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * passes).cast("double"))
    every = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before, here_on = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(total) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = caps.withColumn("level", left / F.sum("weight").over(here_on)).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    # The first open source has the highest level of the open ones: later ones count caps that aren't reached.
    level = level.withColumn("at", F.max(F.when(F.col("open"), F.col("level"))).over(total))
    target = F.when(F.col("at").isNull() | (F.col("cap") <= F.col("weight") * F.col("at")), F.col("cap")).otherwise(F.col("weight") * F.col("at"))
    return level.select("source", "source_rank", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, `carry`, size, source_size, target, copies, taken.

    docs: doc_id, text, source (+ any other columns, not read unless named in carry). Size is the number of words
    of the whole text; a null text has size 0. A null source is a source of its own, after all others. Repeated rows
    are separate documents; ties in the shuffle fall to doc_id and size. A document is taken whole, 0 to `passes` times.
    Documents of size 0 are placed like others and take nothing. An empty table gives an empty table. Reruns agree.
    Other columns may have any name; one in carry that is named like a column made here is a ValueError.
    """
    free_names(carry, *"doc_id source size source_size target copies taken mix_key slice slice_size base within cumulative source_rank".split())
    spark = ready(docs.sparkSession)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = staged(docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"), key.alias("mix_key")), "sized")
    sized = sized.withColumn("slice", F.substring("mix_key", 1, SLICE_DIGITS))
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, passes)
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("slice_size").over(along), F.lit(0)))
    slices = slices.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "slice", "base", "source_rank", "source_size", "target")

    inside = Window.partitionBy("source", "slice").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("within", F.sum("size").over(inside)).alias("d").join(slices.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice")))
    placed = staged(placed.select("doc_id", "d.source", *carry, "size", "source_rank", "source_size", "target", (F.col("base") + F.col("within")).alias("cumulative")), "placed")

    def finish(p: Column | int) -> Column:
        return F.when(F.col("target") > 0, (F.col("source_size") * p + F.col("cumulative")) / F.col("target")).otherwise(F.lit(0.0))

    copies = placed.where("size > 0").select("size", "source_rank", "cumulative", F.explode(F.array(*[F.lit(p) for p in range(passes)])).alias("pass"), "source_size", "target")
    order = ("finish", "source_rank", "cumulative")
    copies = copies.select("size", *order[1:], finish(F.col("pass")).alias("finish")).repartitionByRange(partitions(spark), *order)
    copies = staged(copies.sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "ranges")
    budget = F.sum("source_size") * share
    whole = sources.agg(F.least(budget, (F.sum("source_size") * passes).cast("double")).alias("budget"))
    ends = copies.groupBy("range").agg(F.sum("size").alias("words"))
    ends = ends.withColumn("until", F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    # One row: the range in which the budget runs out.
    last = ends.join(F.broadcast(whole)).where("until > budget").agg(F.min_by(F.struct("range", (F.col("until") - F.col("words")).alias("before"), "budget"), "range").alias("r")).first()["r"]

    if last is None:  # the budget covers every copy
        took = F.lit(passes)
    else:
        running = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        edge = copies.where(F.col("range") == last["range"]).withColumn("running", running + F.lit(last["before"]))
        within = edge.where(F.col("running") <= F.lit(last["budget"])).agg(F.max(F.struct(*order)).alias("c"))
        before = copies.where(F.col("range") < last["range"]).agg(F.max(F.struct(*order)).alias("c"))
        cut = within.union(before).agg(F.max("c").alias("c")).first()["c"]  # the last copy that the mix takes

        def inside_cut(p: int) -> Column:
            if cut is None:
                return F.lit(0)
            mine = F.struct(finish(p).alias("finish"), "source_rank", "cumulative")
            return (mine <= F.struct(F.lit(cut["finish"]), F.lit(cut["source_rank"]), F.lit(cut["cumulative"]).cast("long"))).cast("int")

        took = sum((inside_cut(p) for p in range(1, passes)), inside_cut(0))
    out = placed.withColumn("copies", F.when(F.col("size") > 0, took).otherwise(0).cast("int"))
    return out.select("doc_id", "source", *carry, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op7_source_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT ROW_NUMBER() OVER () AS rn, doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
src AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM sized GROUP BY source),
caps AS (
  SELECT *, CAST(CASE rk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM src),
lev AS (
  SELECT *, (CAST(SUM(source_size) OVER () AS DOUBLE) * 1.5
     - COALESCE(SUM(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / SUM(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
lvl AS (SELECT *, MAX(CASE WHEN cap > w * level THEN level END) OVER () AS at_level FROM lev),
tgt AS (
  SELECT source, rk, source_size, CASE WHEN at_level IS NULL OR cap <= w * at_level THEN cap ELSE w * at_level END AS target FROM lvl),
placed AS (
  SELECT d.rn, d.doc_id, d.size, t.rk, t.source_size, t.target,
         SUM(d.size) OVER (PARTITION BY t.rk ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(p * source_size + cum AS DOUBLE) / target ELSE 0 END AS fin
  FROM placed, (VALUES (0), (1)) AS pass(p)),
cut AS (
  SELECT *, SUM(size) OVER (ORDER BY fin, rk, cum ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM items WHERE size > 0),
budget AS (SELECT CAST(SUM(source_size) AS DOUBLE) * 1.5 AS b FROM src),
took AS (SELECT rn, SUM(CASE WHEN running <= b THEN size ELSE 0 END) AS taken FROM cut, budget GROUP BY rn)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(COALESCE(t.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN took t ON p.rn = t.rn
"""
