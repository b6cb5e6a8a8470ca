"""Streams with keyed state of a bounded size: the backlog of each scan, its state machine with deletions, sessions and their first flows.

Nothing here rewrites a table for a micro-batch. State lives in the checkpoint of the stream, from which a new run goes on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from auditlake.streaming.events import BACKLOG, STEP, TERMINAL

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The store that lists in state need, for the queries that start meanwhile."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _began(spark: SparkSession, checkpoint: str) -> bool:
    """Whether any micro-batch ever ended there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and len(files.listStatus(place)) > 0


class _Backlog(StatefulProcessor):
    """The newest n events of a key, as a list in state. Events come in any order, within a micro-batch and across them."""

    def __init__(self, n: int, key: str) -> None:
        self.n, self.key = n, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("backlog", "seq long, event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(e) for e in self.kept.get()] if self.kept.exists() else []
        kept = before
        for batch in rows:
            kept = heapq.nlargest(self.n, [*kept, *zip(batch["seq"].tolist(), batch["event"].tolist(), strict=True)])
        if kept != before:
            self.kept.put(kept)
        yield pd.DataFrame({self.key: [key[0]], "kept": [len(kept)]})


def backlog(events: DataFrame, root: str, n: int = BACKLOG, key: str = "scan_id", seq: str = "seq") -> DataFrame:
    """Run a stream of events over all that is there; the newest n of each key (a whole seq; greatest first, repeated ones count), from the
    first run with this folder on, with the columns of ``events``. A key's state holds n events and no more; it is read back
    from the checkpoint, so no micro-batch writes a table."""
    spark, own = events.sparkSession, [c for c in events.columns if c not in (key, seq)]
    slim = events.select(key, F.col(seq).cast("long").alias("seq"), F.to_json(F.struct(*own)).alias("event"))
    kinds = {f.name: f for f in events.schema.fields}
    counted = StructType([kinds[key], StructField("kept", StructType.fromDDL("n int")["n"].dataType)])
    with _state_store(spark):
        running = slim.groupBy(key).transformWithStateInPandas(_Backlog(n, key), counted, "Append", "None")
        writer = running.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
        if not _began(spark, f"{root}/checkpoint"):
            return spark.createDataFrame([], events.schema)
        state = spark.read.format("statestore").option("path", f"{root}/checkpoint").option("stateVarName", "backlog").load()
        read = F.from_json("list_element.event", StructType([kinds[c] for c in own]))
        rows = state.select(F.col(f"key.{key}").alias(key), F.col("list_element.seq").cast(kinds[seq].dataType).alias(seq), read.alias("e"))
        return rows.select(key, seq, "e.*").select(*events.columns)


class _Steps(StatefulProcessor):
    """Rows of a scan wait until the watermark has passed them and are then taken in the order of seq; of those that repeat one, the last
    that came. What follows a final status or a deletion is dropped, then and later. State is read and written once for a scan in a
    micro-batch, not once for each row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "seq long, status string, deleted boolean, at long")
        self.last = handle.getValueState("last", "status string, over boolean")
        self.timers = handle

    def _so_far(self) -> tuple[str | None, bool]:
        return tuple(self.last.get() or (None, False))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        real = [(r.seq, r.status, r.type == "deleted", r.at) for r in rows if r.type != "beat"]
        if real and not self._so_far()[1]:
            self.waiting.appendList(real)
            self.timers.registerTimer(max(at for *_, at in real))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed, before = timerValues.getCurrentWatermarkInMs(), self._so_far()
        held = [tuple(r) for r in self.waiting.get()]
        if not held:
            return iter(())
        (last, over), out = before, []
        rows = {seq: (status, deleted, at) for seq, status, deleted, at in held}
        ready = sorted(seq for seq, (*_, at) in rows.items() if at <= passed)
        for seq in ready:
            if over:
                break
            status, deleted, _ = rows.pop(seq)
            if not deleted:
                out.append(Row(scan_id=key[0], seq=seq, status=status, before=last))
                last = status
            over = deleted or status in TERMINAL
        if over or not rows:
            self.waiting.clear()
        elif len(rows) < len(held):
            self.waiting.put([(seq, *row) for seq, row in rows.items()])
        if (last, over) != before:
            self.last.update((last, over))
        return iter(out)


def streamed_steps(events: DataFrame, lag: str) -> DataFrame:
    """scan_id, seq, status, before: the rows of ``events.statuses`` from a stream (scan_id, seq, type, status, clock) whose rows come in any
    order, as long as none comes more than ``lag`` behind the latest clock. The clock of a scan doesn't fall as seq grows. Rows are given
    out once the watermark has passed them. A row of type "deleted" ends a scan; one of type "beat" only moves the clock on, where
    nothing else does. Rows without a scan are those of one scan."""
    only = events.where(F.col("type").isin("status", "deleted", "beat"))
    slim = only.select("scan_id", "seq", "type", "status", "clock", F.unix_millis("clock").alias("at")).withWatermark("clock", lag)
    return slim.groupBy("scan_id").transformWithState(_Steps(), STEP, "Append", "EventTime")


def seen_in_time(starts: DataFrame, flows: DataFrame, wanted: str, within_seconds: int, lag: str) -> DataFrame:
    """session, seen of streams of sessions (session, began) and flows (session, host, ts): one row or more for each session, seen true if a
    host that holds the text came within so many seconds of its start, those included. The join is bounded in event time, so
    sessions and flows leave the state once the watermark has passed the deadline; a session that saw none is given out then. Rows
    without a session only move the clock on."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  not null: else such rows would go before they are seen by the watermark
    began = starts.select("session", name("session").alias("key"), "began").withWatermark("began", lag)
    moves = F.col("session").isNull() | F.contains("host", F.lit(wanted))
    hits = flows.where(moves).select(F.col("session").alias("of"), name("session").alias("of_key"), "ts").withWatermark("ts", lag)
    near = F.expr(f"key = of_key AND ts >= began AND ts <= began + INTERVAL {within_seconds} SECONDS")
    both = began.join(hits, near, "leftOuter")
    return both.where(F.coalesce("session", "of").isNotNull()).select("session", F.col("of").isNotNull().alias("seen"))


def appended(stream: DataFrame, root: str) -> DataFrame:
    """Run a stream with state over all that is there into a Parquet folder; the rows written so far, from the first run on."""
    spark = stream.sparkSession
    with _state_store(spark):
        writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
