"""Hourly panes of a click stream with revisions: a stateful streaming query that publishes, corrects and forgets.

A pane is one kind within one hour of event time. A processor keeps for each pane what it holds and what was published
of it. A pane that is due is published once; rows that come later retract and replace what was published; a pane that
is closed is forgotten, and its late rows go to the output one by one. What is due and what is closed is told by two
event-time timers on the query's own watermark, the greatest event time of all earlier batches.

A hot pane doesn't go through one task row by row: within a task, rows are added up by pane before the shuffle, and
late rows, which must stay single, are dealt to groups that keep no state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from loomstone.llm.common import new_path, partitions, ready, table

# Spark also asks the processor for its state on the driver, in a worker that doesn't get the shipped package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
#: A pane is due so long after its hour has ended, and closed so long after.
GRACE_MS, CLOSE_MS = 2 * HOUR_MS, 3 * DAY_MS
BATCHES = 12
#: Panes that a task adds up before it sends them on.
MOST_PANES = 100_000

STATE = "n long, cents long, out_n long, out_cents long"
RESULT = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
PARTIAL = "kind string, hour long, part int, click_id long, n long, cents long, last boolean"
PARTIAL_ARROW = pa.schema([("kind", pa.string()), ("hour", pa.int64()), ("part", pa.int32()), ("click_id", pa.int64()), ("n", pa.int64()), ("cents", pa.int64()), ("last", pa.bool_())])
FED = "click_id long, kind string, hour long, micros long, cents long, mark string"
#: A pane's own group; late rows have parts of 0 and more.
PANE = -1

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STREAM_SETTINGS = {
    PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A start is one batch: the panes that its rows make due wait for the next one's.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # A start's state is many small stores: without space put by for each, and with what changed uploaded instead of whole stores.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Panes(StatefulProcessor):
    """The processor of one start.

    batch: its number in the output. origin_ms: what was added to event times so that the watermark, which begins at
    0, begins below all of them.
    """

    def __init__(self, batch: int, origin_ms: int, grace_ms: int = GRACE_MS, close_ms: int = CLOSE_MS):
        self.batch, self.origin, self.grace, self.close_after = batch, origin_ms, grace_ms, close_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pane = handle.getValueState("pane", STATE)

    def _end(self, hour: int) -> int:
        return (hour + 1) * HOUR_MS + self.origin

    def _rows(self, key, rows: list[tuple[str, int, int]]) -> pd.DataFrame:
        return pd.DataFrame({
            "batch": np.full(len(rows), self.batch), "hour": np.full(len(rows), int(key[1])), "click_id": np.full(len(rows), -1),
            "n_rows": [r[1] for r in rows], "cents": [r[2] for r in rows], "record": [r[0] for r in rows], "kind": [key[0]] * len(rows),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if key[2] != PANE:
            for late in rows:
                yield pd.DataFrame({"batch": np.full(len(late), self.batch), "hour": late["late_hour"], "click_id": late["click_id"], "n_rows": late["n"], "cents": late["cents"], "record": "late", "kind": late["late_kind"]})
            return
        n, cents, last = 0, 0, False
        for part in rows:
            n, cents, last = n + int(part["n"].sum()), cents + int(part["cents"].sum()), last or bool(part["last"].any())
        held = self.pane.get() if self.pane.exists() else None
        if held is None and not n:
            return  # a sentinel for a pane that is forgotten, or never was
        now_n, now_cents, out_n, out_cents = held or (0, 0, None, None)
        end, out = self._end(int(key[1])), []
        if held is None:
            self.handle.registerTimer(end + self.grace)
            self.handle.registerTimer(end + self.close_after)
        now_n, now_cents = now_n + n, now_cents + cents
        if n and out_n is not None:
            out = [("retract", out_n, out_cents), ("replace", now_n, now_cents)]
            out_n, out_cents = now_n, now_cents
        elif last and out_n is None and timerValues.getCurrentWatermarkInMs() < end + self.grace:
            out = [("final", now_n, now_cents)]
            out_n, out_cents = now_n, now_cents
        self.pane.update((now_n, now_cents, out_n, out_cents))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.pane.exists():
            return
        n, cents, out_n, _ = self.pane.get()
        if out_n is None:
            yield self._rows(key, [("emit", n, cents)])
        if expiredTimerInfo.getExpiryTimeInMs() >= self._end(int(key[1])) + self.close_after:
            self.pane.clear()
        elif out_n is None:
            self.pane.update((n, cents, n, cents))

    def close(self) -> None:
        pass


def _added_up(parts: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(["kind", "hour"]).aggregate([("n", "sum"), ("cents", "sum"), ("last", "max")])
    return whole.select(["kind", "hour", "n_sum", "cents_sum", "last_max"]).rename_columns(["kind", "hour", "n", "cents", "last"])


def _partials(watermark_ms: int | None, close_ms: int, parts: int):
    """A kernel: rows of one batch -> late rows as they are, and for each pane the number and sum of the others."""

    def pane_rows(t: pa.Table) -> list[pa.RecordBatch]:
        n = t.num_rows
        columns = [t["kind"], t["hour"], pa.array(np.full(n, PANE, np.int32)), pa.nulls(n, pa.int64()), t["n"], t["cents"], t["last"], t["kind"], t["hour"]]
        return pa.Table.from_arrays(columns, schema=_wide()).to_batches()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for b in batches:
            row, sentinel = (pc.equal(b.column("mark"), k).to_numpy(zero_copy_only=False) for k in ("row", "last"))
            hour = b.column("hour").to_numpy(zero_copy_only=False)
            closed = row & (watermark_ms is not None) & ((hour.astype(np.int64) + 1) * HOUR_MS + close_ms <= (watermark_ms or 0))
            if closed.any():
                late = pa.Table.from_batches([b]).filter(pa.array(closed))
                n = late.num_rows
                key = late["click_id"].fill_null(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                columns = [pa.array([""] * n), pa.array(np.zeros(n, np.int64)), pa.array((key % np.uint64(parts)).astype(np.int32)), late["click_id"], pa.array(np.ones(n, np.int64)), late["cents"], pa.array(np.zeros(n, bool)), late["kind"], late["hour"]]
                yield from pa.Table.from_arrays(columns, schema=_wide()).to_batches()
            use = (row & ~closed) | sentinel
            if use.any():
                t = pa.Table.from_batches([b]).filter(pa.array(use))
                one = pa.table({"kind": t["kind"], "hour": t["hour"], "n": pa.array(row[use].astype(np.int64)), "cents": t["cents"], "last": pa.array(sentinel[use])})
                kept = [_added_up([*kept, one])]
                if kept[0].num_rows > MOST_PANES:
                    yield from pane_rows(kept.pop())
        for t in kept:
            yield from pane_rows(t)

    return kernel


def _wide() -> pa.Schema:
    return pa.schema([*PARTIAL_ARROW, pa.field("late_kind", pa.string()), pa.field("late_hour", pa.int64())])


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + second


def cut(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Clicks -> (click_id, kind, hour, micros, cents, mark, batch): each click once, with its batch and its event time moved to the first days since 1970.

    Rows without ts go. Of rows that share a click_id but differ, that with the least (arrived_at, ts, kind, value)
    stays, nulls first; rows without click_id count as one click. Without arrived_at a click arrived at ts. A value that
    is null or no number has 0 cents.
    """
    one = clicks.where("ts is not null").groupBy("click_id").agg(F.min(F.struct("arrived_at", "ts", "kind", "value")).alias("r")).select("click_id", "r.*")
    day = F.unix_date(F.coalesce("arrived_at", "ts").cast("date")).cast("long")
    q = F.pmod(day, F.lit(batches))
    late = F.pmod(F.crc32(F.col("click_id").cast("string")), F.lit(30)) - 23
    micros = micros_of(F.col("ts")) - (day - q) * 86_400_000_000
    cents = F.when(F.isnan("value"), 0).otherwise(F.floor(F.col("value") * 100 + 0.5))
    return one.select(
        "click_id", F.coalesce("kind", F.lit("none")).alias("kind"), F.floor(micros / 3_600_000_000).cast("long").alias("hour"), micros.alias("micros"),
        F.coalesce(cents, F.lit(0)).cast("long").alias("cents"), F.lit("row").alias("mark"), F.least(F.lit(batches - 1), q + F.greatest(F.lit(0), F.coalesce(late, F.lit(0)))).cast("int").alias("batch"),
    )


def _feed(spark: SparkSession, rows: DataFrame, batches: int) -> tuple[str, dict[int, int], int | None]:
    """Write the batches as folders: (folder, greatest micros by batch, least micros).

    Every batch also has a row that only marks it, so that an empty one is a batch too, and the last has a sentinel for
    every pane.
    """
    path = new_path(spark, "clicks")
    rows.write.partitionBy("batch").parquet(f"{path}/cut")
    written = spark.read.schema(f"{FED}, batch int").parquet(f"{path}/cut")
    # One row a batch.
    span = {r.batch: (r.least, r.most) for r in written.groupBy("batch").agg(F.min("micros").alias("least"), F.max("micros").alias("most")).collect()}
    nothing = [F.lit(None).cast("long").alias(c) for c in ("click_id",)]
    marks = spark.range(batches).select(*nothing, F.lit("").alias("kind"), F.lit(0).cast("long").alias("hour"), F.lit(None).cast("long").alias("micros"), F.lit(0).cast("long").alias("cents"), F.lit("batch").alias("mark"), F.col("id").cast("int").alias("batch"))
    sentinels = written.select("kind", "hour").distinct().select(*nothing, "kind", "hour", F.lit(None).cast("long").alias("micros"), F.lit(0).cast("long").alias("cents"), F.lit("last").alias("mark"), F.lit(batches - 1).alias("batch"))
    marks.unionByName(sentinels).write.partitionBy("batch").parquet(f"{path}/marks")
    return path, {b: most for b, (_, most) in span.items()}, min((least for least, _ in span.values()), default=0)


def panes(clicks: DataFrame, batches: int = BATCHES, grace_ms: int = GRACE_MS, close_ms: int = CLOSE_MS) -> DataFrame:
    """Clicks -> (batch, hour, click_id, n_rows, cents, record, kind): every record that the streaming query writes, over all batches.

    The query is started once a batch, always on the same checkpoint; its source, state and output are in a new folder
    under spark.checkpoint.dir, so a start may be repeated and a lost executor costs only its tasks. What the driver
    holds is one number a batch.
    """
    spark = ready(clicks.sparkSession)
    path, most, least = _feed(spark, cut(clicks, batches), batches)
    origin = DAY_MS - least // 1000
    before = {k: spark.conf.get(k, None) for k in STREAM_SETTINGS}
    watermark: int | None = None
    try:
        for k, v in STREAM_SETTINGS.items():
            spark.conf.set(k, v)
        for b in range(batches):
            _start(spark, path, b, origin, watermark, grace_ms, close_ms)
            if b in most:
                watermark = max(most[b] // 1000, watermark) if watermark is not None else most[b] // 1000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(RESULT).parquet(f"{path}/records")


def _start(spark: SparkSession, path: str, batch: int, origin_ms: int, watermark_ms: int | None, grace_ms: int, close_ms: int) -> None:
    """One start of the query, which takes one batch."""
    rows = spark.readStream.schema(FED).parquet(f"{path}/*/batch={batch}")
    moved = F.timestamp_micros(F.coalesce(F.col("micros") + origin_ms * 1000, F.lit(0)))
    # The processor doesn't get the event time: its late rows are for it to see, not for Spark to drop.
    seen = rows.withColumn("event_time", moved).withWatermark("event_time", "0 seconds").select("click_id", "kind", "hour", "cents", "mark")
    partial = seen.mapInArrow(_partials(watermark_ms, close_ms, 4 * partitions(spark)), f"{PARTIAL}, late_kind string, late_hour long")
    records = partial.groupBy("kind", "hour", "part").transformWithStateInPandas(Panes(batch, origin_ms, grace_ms, close_ms), RESULT, "Append", "EventTime")
    query = records.writeStream.format("parquet").option("path", f"{path}/records").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def op11_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clicks in 12 batches: what is published, corrected and finally written of each pane, and the late rows."""
    return panes(table(spark, sf_dir, "clicks").select("click_id", "ts", "arrived_at", "kind", "value"))


_LATE_MICROS, _DUE_MICROS = CLOSE_MS * 1000, GRACE_MS * 1000
ORACLE_SQL = f"""
WITH crc AS (  -- the table of CRC-32, from its polynomial
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
once AS (
  SELECT * FROM clicks WHERE ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY arrived_at NULLS FIRST, ts, kind NULLS FIRST, value NULLS FIRST) = 1),
hashed AS (
  SELECT once.*, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(click_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda a, s: xor(a >> 8, t[xor(a & 255, s) + 1]))) % 30 - 23, 0) AS shift,
    date_diff('day', DATE '1970-01-01', CAST(coalesce(arrived_at, ts) AS DATE)) AS d
  FROM once, crc),
timed AS (
  SELECT click_id, coalesce(kind, 'none') AS kind, CASE WHEN value IS NULL OR isnan(value) THEN 0 ELSE CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents,
    least({BATCHES - 1}, d % {BATCHES} + greatest(0, shift)) AS batch, epoch_us(ts) - (d - d % {BATCHES}) * 86400000000 AS us
  FROM hashed),
marks AS (
  SELECT b.range AS batch, (SELECT max(us) FROM timed WHERE timed.batch < b.range) AS w FROM range({BATCHES}) b),
rows AS (
  SELECT timed.*, CAST(floor(us / 3600000000.0) AS BIGINT) AS hour, w FROM timed JOIN marks USING (batch)),
sorted AS (
  SELECT *, (hour + 1) * 3600000000 AS hour_end, coalesce(w >= (hour + 1) * 3600000000 + {_LATE_MICROS}, false) AS late FROM rows),
added AS (
  SELECT kind, hour, hour_end, batch, count(*) AS n, sum(cents) AS cents FROM sorted WHERE NOT late GROUP BY ALL),
running AS (
  SELECT kind, hour, hour_end, batch, sum(n) OVER p AS n, sum(cents) OVER p AS cents FROM added WINDOW p AS (PARTITION BY kind, hour ORDER BY batch)),
published AS (
  SELECT kind, hour, (SELECT min(m.batch) FROM marks m WHERE m.batch >= f.first AND m.w >= f.hour_end + {_DUE_MICROS}) AS emitted
  FROM (SELECT kind, hour, hour_end, min(batch) AS first FROM added GROUP BY ALL) f),
totals AS (
  SELECT r.*, emitted, lag(r.n) OVER p AS old_n, lag(r.cents) OVER p AS old_cents, lead(r.batch) OVER p AS next
  FROM running r JOIN published USING (kind, hour) WINDOW p AS (PARTITION BY r.kind, r.hour ORDER BY r.batch)),
records AS (
  SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM sorted WHERE late
  UNION ALL SELECT coalesce(emitted, {BATCHES - 1}), hour, -1, n, cents, CASE WHEN emitted IS NULL THEN 'final' ELSE 'emit' END, kind FROM totals
    WHERE batch <= coalesce(emitted, {BATCHES - 1}) AND coalesce(next > emitted, next IS NULL)
  UNION ALL SELECT batch, hour, -1, old_n, old_cents, 'retract', kind FROM totals WHERE batch > emitted
  UNION ALL SELECT batch, hour, -1, n, cents, 'replace', kind FROM totals WHERE batch > emitted)
SELECT CAST(batch AS BIGINT) AS batch, hour, CAST(click_id AS BIGINT) AS click_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(cents AS BIGINT) AS cents, record, kind FROM records
"""
