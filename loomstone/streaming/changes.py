"""Streaming of changes: debounce, batches, storms, suppression, subscriptions, a closed learning loop, late outcomes.

The watermark and windows are this library's choice: event time, with a delay that callers set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with a watermark on its time, which must have a time zone for that; a batch as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def debounce(events: DataFrame, key: str, ts: str, quiet: str = "200 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, end, events, last): one row for each burst of a key that ends in a quiet period. Batch or stream."""
    e = watermarked(events, ts, late)
    g = e.groupBy(F.session_window(ts, quiet).alias("w"), key).agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "last")


def batches(events: DataFrame, key: str, ts: str, width: str, storm: int = 200, late: str = "10 seconds") -> DataFrame:
    """(start, events, keys, storm): tumbling windows with their number of events and distinct keys; a storm is `storm` events or more."""
    e = watermarked(events, ts, late)
    keys = F.approx_count_distinct(key) if events.isStreaming else F.countDistinct(key)
    g = e.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("events"), keys.alias("keys"))
    return g.select(F.col("w.start").alias("start"), "events", "keys", (F.col("events") >= storm).alias("storm"))


def sliding(events: DataFrame, ts: str, width: str, step: str, by: list[str], late: str = "10 seconds", **aggs: Column) -> DataFrame:
    e = watermarked(events, ts, late)
    g = e.groupBy(F.window(ts, width, step).alias("w"), *by).agg(*[c.alias(k) for k, c in aggs.items()])
    return g.select(F.col("w.start").alias("start"), *by, *aggs)


def changed_only(events: DataFrame, known: DataFrame, key: str, checksum: str) -> DataFrame:
    """Events whose checksum isn't the known one of their key: a stream against a table, or two tables."""
    same = known.select(F.col(key), F.col(checksum).alias("_known"))
    return events.join(same, key, "left").where(~F.coalesce(F.col(checksum) == F.col("_known"), F.lit(False))).drop("_known")


def distinct_events(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first of events with equal keys; on a stream the memory of keys ends with the watermark."""
    return watermarked(events, ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def subscribe(stream: DataFrame, where: Column, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Matching rows of each micro-batch to a handler. The checkpoint is the cursor: after a restart no batch is lost, and one is handled again at most."""
    return stream.where(where).writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class EventBus:
    """Handlers by topic, * for all, fed by one stream; a handler's error is kept and doesn't stop the others."""

    def __init__(self, topic: str):
        self.topic, self.handlers, self.errors = topic, [], []

    def on(self, topic: str, handler: Callable[[DataFrame], None]) -> None:
        self.handlers.append((topic, handler))

    def dispatch(self, batch: DataFrame, _id: int = 0) -> None:
        for topic, handler in self.handlers:
            try:
                handler(batch if topic == "*" else batch.where(F.col(self.topic) == topic))
            except Exception as e:  # noqa: BLE001  errors of subscribers are theirs
                self.errors.append((topic, e))


def cascade(changed: DataFrame, edges: DataFrame, key: str, most: int = 50) -> DataFrame:
    """The dependents of what changed: (id) over edges (src, dst), src depends on dst; the first `most` by id, without the changed themselves."""
    c = changed.select(F.col(key).alias("dst")).distinct()
    return edges.join(c, "dst").select(F.col("src").alias("id")).distinct().join(c.withColumnRenamed("dst", "id"), "id", "left_anti").orderBy("id").limit(most)


#: Tiers of learned knowledge by their least estimate and observations.
TIERS = [("core", 0.8, 20), ("useful", 0.6, 5), ("trial", 0.0, 0)]


def tier(estimate: float, n: int) -> str:
    return next(name for name, least, count in TIERS if estimate >= least and n >= count)


def learn_batch(outcomes: DataFrame, key: str, success: Column) -> DataFrame:
    """(key, successes, n, estimate, tier): Laplace estimates (s + 1) / (n + 2) over all outcomes."""
    g = outcomes.groupBy(key).agg(F.count(F.when(success, 1)).alias("successes"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("estimate", (F.col("successes") + 1) / (F.col("n") + 2))
    t = None
    for name, least, count in TIERS:
        test = (F.col("estimate") >= least) & (F.col("n") >= count)
        t = F.when(test, name) if t is None else t.when(test, name)
    return g.withColumn("tier", t)


def learn_stream(outcomes: DataFrame, key: str, success: str, forget: str = "NoTimeout") -> DataFrame:
    """The same on a stream with state by key: each batch gives the keys it touched their new estimates."""
    kind = outcomes.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s, n = state.get if state.exists else (0, 0)
        for f in frames:
            s, n = s + int(f[success].sum()), n + len(f)
        state.update((s, n))
        e = (s + 1) / (n + 2)
        name = next(t for t, least, count in (("core", 0.8, 20), ("useful", 0.6, 5), ("trial", 0.0, 0)) if e >= least and n >= count)
        yield pd.DataFrame({key: [k[0]], "successes": [s], "n": [n], "estimate": [e], "tier": [name]})

    return outcomes.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, successes long, n long, estimate double, tier string", "s long, n long", "update", forget)


def join_outcomes(predictions: DataFrame, outcomes: DataFrame, key: str, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Predictions (key, made, p) with the outcomes (key, seen, y) that come within `wait`: a stream-stream join whose state the watermarks bound, or a batch join."""
    p = watermarked(predictions, "made", late)
    o = outcomes.withColumnRenamed(key, "_k")
    o = watermarked(o, "seen", late)
    return p.join(o, (F.col(key) == F.col("_k")) & (F.col("seen") >= F.col("made")) & (F.col("seen") <= F.col("made") + F.expr(f"INTERVAL {wait}"))).drop("_k")


def violations(edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Edges (src, dst) that break a rule of blocked (from_prefix, to_prefix, level). Prefixes meet by their first path part, so the join is an equi-join."""
    e = edges.withColumns({"_a": F.element_at(F.split("src", "/"), 1), "_b": F.element_at(F.split("dst", "/"), 1)})
    b = blocked.withColumns({"_a": F.element_at(F.split("from_prefix", "/"), 1), "_b": F.element_at(F.split("to_prefix", "/"), 1)})
    return e.join(b, ["_a", "_b"]).where(F.col("src").startswith(F.col("from_prefix")) & F.col("dst").startswith(F.col("to_prefix"))).select("src", "dst", "level")


def replay(df: DataFrame, path: str, files: int = 4) -> DataFrame:
    """df as a file stream, read back a file a batch: for tests and for catching up."""
    df.repartition(files).write.mode("overwrite").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
