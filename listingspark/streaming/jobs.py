"""Recurring work as streams: ingest, alerts, health, rate counting, digests, run states, retention.

Every stream keeps its progress in a checkpoint folder and writes one folder a batch, so a batch that is repeated after a
failure replaces what it wrote. What must be remembered without end (runs, digests, alerts) is kept in those tables and merged batch
by batch; only what ends by itself (open windows, live sources) is stream state, with a timer that ends it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.merge import insert_absent
from ..session import cut_lineage
from ..sources.tables import BatchTable, Merge, drop_expired_days

RATE_SCHEMA = "key string, window_start_ms long, expires_ms long, attempts long, over_limit long"
HEALTH_SCHEMA = "key string, last_ms long, healthy boolean, at_ms long"
HEALTHY_MINUTES = 5
#: State with timers lives in this store, which writes what a batch changed rather than all it holds.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_state_store(spark: SparkSession) -> None:
    """Set the session's state store to the one that timers need."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def run_available(writer: Any) -> StreamingQuery:
    """Process everything that has landed and stop. A service would use a processing-time trigger instead."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_stream(stream: DataFrame, table: BatchTable, merge: Merge, checkpoint: str, mode: str = "append") -> Any:
    """A writer that merges every micro-batch into a table, under the batch's number."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: table.upsert(batch, merge, n))


def keep_latest(keys: list[str]) -> Merge:
    """Merge that lets the rows of the batch replace those with the same key."""
    return lambda base, batch: batch


def ingest(payloads: DataFrame, normalize: Callable[[DataFrame], DataFrame], table: BatchTable, merge: Merge, checkpoint: str) -> Any:
    """Landed payloads to listings: each batch is normalized and merged like one scan."""
    return payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: table.upsert(normalize(batch), merge, n))


class Marks:
    """How far event time had come before each batch: one row a batch, the latest instant and how many rows were late."""

    def __init__(self, table: BatchTable):
        self.table = table

    def before(self, batch: int, delay: str) -> Column:
        """What is older than this came late to the batch; null before the first one."""
        found = self.table.rows(batch)
        latest = found.agg(F.max("latest")).first()[0] if found is not None else None
        return F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}") if latest is not None else F.lit(None).cast("timestamp")

    def note(self, rows: DataFrame, at: str, mark: Column, batch: int) -> None:
        self.table.write(rows.agg(F.lit(batch).alias("n"), F.max(at).alias("latest"), F.count_if(F.col(at) < mark).alias("late")), batch)


def alert_stream(events: DataFrame, table: BatchTable, marks: Marks, at: str, checkpoint: str, horizon: str = "30 days") -> Any:
    """One alert per key of the table, however late it comes.

    A row within the horizon is compared with the alerts of the horizon only; older rows, which a watermark would drop, are
    compared with all alerts. The marks tell how many of those each batch had.
    """

    def apply(batch: DataFrame, n: int) -> None:
        rows = cut_lineage(batch, "alerts")
        mark = marks.before(n, horizon)
        known = table.rows(n)
        fresh = rows.dropDuplicates(table.keys)
        if known is not None:
            late = F.coalesce(F.col(at) < mark, F.lit(False))
            old, new = fresh.filter(late), fresh.filter(~late)
            recent = known.filter(F.coalesce(F.col(at) >= mark, F.lit(True)))
            fresh = insert_absent(recent, new, table.keys).unionByName(insert_absent(known, old, table.keys))
        table.write(fresh, n)
        marks.note(rows, at, mark, n)

    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)


def digest_stream(events: DataFrame, table: BatchTable, marks: Marks, at: str, checkpoint: str, delay: str = "1 hour") -> Any:
    """Events per user and UTC hour, with how many of them came more than ``delay`` late; none is lost."""

    def apply(batch: DataFrame, n: int) -> None:
        rows = cut_lineage(batch, "digest")
        mark = marks.before(n, delay)
        counted = rows.groupBy("user_id", F.date_trunc("hour", at).alias("hour")).agg(F.count("*").alias("events"), F.count_if(F.col(at) < mark).alias("late"))
        table.upsert(counted, add_up(table.keys, "events", "late"), n)
        marks.note(rows, at, mark, n)

    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)


def add_up(keys: list[str], *counts: str) -> Merge:
    """Merge that adds the counts of the batch to those of the same key."""

    def merge(base: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if base is None else batch.unionByName(base)
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])

    return merge


def run_fold_stream(events: DataFrame, table: BatchTable, checkpoint: str) -> Any:
    """The latest state of every run. Runs are remembered in the table, not in the stream, so none has to be forgotten."""

    def merge(base: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if base is None else batch.unionByName(base)
        return rows.groupBy("run_id").agg(F.max("last").alias("last"), F.sum("events").alias("events"))

    def apply(batch: DataFrame, n: int) -> None:
        last = F.struct(F.col("at").alias("at"), F.col("seq").alias("seq"), F.col("status").alias("status"))
        table.upsert(batch.groupBy("run_id").agg(F.max(last).alias("last"), F.count("*").alias("events")), merge, n)

    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)


def run_states(table: BatchTable) -> DataFrame:
    return table.current().select("run_id", "last.status", F.col("last.at").alias("last_at"), "events")


def _name(key: tuple, times: int = 1) -> pd.Series:
    """The key as a column of plain strings, which any number of frames can be joined from."""
    return pd.Series([key[0]] * times, dtype=object)


class _Silence(StatefulProcessor):
    """A source is healthy from a beat on and unhealthy when none has come for a while, also if nothing else comes."""

    def __init__(self, span_ms: int, event_time: bool):
        self.span_ms, self.event_time = span_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms long, due_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        newest = max(int(frame["ms"].max()) for frame in rows)
        last = newest if held is None else max(newest, held[0])
        due = (last if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.span_ms
        if held is not None:
            self.handle.deleteTimer(held[1])
        self.handle.registerTimer(due)
        self.last.update((last, due))
        yield pd.DataFrame({"key": _name(key), "last_ms": [last], "healthy": [True], "at_ms": [newest]})

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"key": _name(key), "last_ms": [last], "healthy": [False], "at_ms": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def source_health(events: DataFrame, key: str, at: str, minutes: float = HEALTHY_MINUTES, delay: str = "1 minute", live: bool = False) -> DataFrame:
    """Verdicts on sources: one row with every batch in which a source speaks, and one when it has been silent for ``minutes``.

    Silence is told by event time, which the other sources move on, or with ``live`` by the clock, so that the verdict comes
    even when nothing arrives at all. A silent source leaves the state.
    """
    use_state_store(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"))
    if not live:
        rows = rows.withWatermark("at", delay)
    rows = rows.withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("key").transformWithStateInPandas(
        _Silence(round(minutes * 60_000), not live), HEALTH_SCHEMA, "update", "processingTime" if live else "eventTime"
    )


def latest_verdicts(merged: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Of each source the last verdict: by last beat, and of one beat the one on its silence."""
    order = F.struct("last_ms", ~F.col("healthy"), "at_ms")
    rows = batch if merged is None else batch.unionByName(merged)
    return rows.groupBy("key").agg(F.max_by(F.struct("last_ms", "healthy", "at_ms"), order).alias("v")).select("key", "v.*")


def health(beats: DataFrame, as_of: Column, minutes: int = HEALTHY_MINUTES) -> DataFrame:
    return beats.withColumn("healthy", F.col("last_at") > as_of - F.make_dt_interval(mins=F.lit(minutes)))


def _fold_instants(instants: np.ndarray, counts: np.ndarray, expires: int | None, running: int, limit: int, span_ms: int):
    """Fold sorted instants into windows. A window starts at its first event and resets at the first event
    after it expired. Works window by window on whole arrays; returns the windows and the open one."""
    windows: list[list[int]] = []
    cumulative = np.concatenate([[0], np.cumsum(counts)])
    i, n = 0, len(instants)
    while i < n:
        if expires is None or instants[i] > expires:
            expires, running = int(instants[i]) + span_ms, 0
        j = int(np.searchsorted(instants, expires, side="right"))
        added = int(cumulative[j] - cumulative[i])
        over = max(0, running + added - limit) - max(0, running - limit)
        running += added
        windows.append([expires - span_ms, expires, added, over])
        i = j
    return windows, expires, running


class _Rate(StatefulProcessor):
    """The open window of a key; a timer ends it, and with it the state."""

    def __init__(self, limit: int, span_ms: int):
        self.limit, self.span_ms = limit, span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "expires long, running long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else (None, 0)
        instants, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for frame in rows:
            more = frame["ms"].to_numpy()
            instants, place = np.unique(np.concatenate([instants, more]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, np.ones(len(more), dtype=np.int64)])).astype(np.int64)
        windows, expires, running = _fold_instants(instants, counts, held[0], held[1], self.limit, self.span_ms)
        if held[0] is not None and held[0] != expires:
            self.handle.deleteTimer(held[0] + 1)
        if held[0] != expires:
            self.handle.registerTimer(expires + 1)
        self.open.update((int(expires), int(running)))
        out = pd.DataFrame(windows, columns=["window_start_ms", "expires_ms", "attempts", "over_limit"], dtype="int64")
        out.insert(0, "key", _name(key, len(out)))
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_counter(events: DataFrame, key: str, at: str, limit: int = 10, seconds: int = 900, delay: str = "1 day") -> DataFrame:
    """Attempts per key in windows that start at the first event, with state per key.

    Each batch emits what it added to a window; the parts of a window that spans batches add up. A batch's events
    of a key are counted per millisecond and folded in time order, however they are spread over Arrow frames. Only
    the open window is kept, and no longer than until the watermark, ``delay`` behind, has passed it.
    """
    use_state_store(events.sparkSession)
    instant = F.col(at).cast("timestamp")
    rows = events.select(F.col(key).cast("string").alias("key"), instant.alias("at"), F.unix_millis(instant).alias("ms")).withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(_Rate(limit, seconds * 1000), RATE_SCHEMA, "update", "eventTime")


def rate_windows(events: DataFrame, key: str, at: str, limit: int = 10, seconds: int = 900) -> DataFrame:
    """The same counting over a whole table.

    Events of one key in one millisecond are counted together before the shuffle, so a key under
    attack costs at most one row per millisecond. Keys are then read in order, a batch of rows at a
    time, carrying only the open window.
    """
    span = seconds * 1000
    millis = F.unix_millis(F.col(at).cast("timestamp"))
    counted = events.groupBy(F.col(key).cast("string").alias("key"), millis.alias("ms")).agg(F.count("*").alias("n"))
    ordered = counted.repartition("key").sortWithinPartitions("key", "ms")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, expires, running = None, None, 0
        for frame in frames:
            rows: list[list[Any]] = []
            for name, part in frame.groupby("key", sort=False):
                if name != current:
                    current, expires, running = name, None, 0
                windows, expires, running = _fold_instants(part["ms"].to_numpy(), part["n"].to_numpy(), expires, running, limit, span)
                rows += [[name, *w] for w in windows]
            yield pd.DataFrame(rows, columns=["key", "window_start_ms", "expires_ms", "attempts", "over_limit"])

    return total_windows(ordered.mapInPandas(fold, RATE_SCHEMA))


def total_windows(parts: DataFrame) -> DataFrame:
    """Add up the parts of each window."""
    return parts.groupBy("key", "window_start_ms", "expires_ms").agg(F.sum("attempts").alias("attempts"), F.sum("over_limit").alias("over_limit"))


def purge_by_date(spark: SparkSession, table: str, day: str, at: str, cutoff: Column) -> int:
    """Retention on a table partitioned by day: expired days are dropped unread, the day of the cutoff is filtered, later ones stay."""
    first = spark.range(1).select(F.to_date(cutoff).cast("string").alias("day"), F.date_format(cutoff, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).first()
    return drop_expired_days(spark, table, day, f"{at} >= TIMESTAMP'{first.at}'", first.day)
