"""Queries over progress events: the events table read as a stream and run to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.plans.registry import query, read
from auditlake.sources.shared import shared_folder
from auditlake.streaming import events as E
from auditlake.streaming import stateful as S


def _progress(events: DataFrame) -> DataFrame:
    """Progress events: scan, seq, type, and what goes with the type."""
    kind = F.when(F.col("event_type").isin("view", "click"), "log").when(F.col("event_type") == "purchase", "progress").otherwise("status")
    k = F.col("event_id") % 10
    status: Column = F.when(k < 6, "running").when(k < 8, "queued").when(k == 8, "completed").otherwise("cancelled")
    return events.select(
        F.col("user_id").alias("scan_id"),
        F.col("event_id").alias("seq"),
        kind.alias("type"),
        F.when(kind == "status", status).alias("status"),
        F.when(kind == "progress", (F.col("value") % 100).cast("int")).alias("percent"),
        F.col("ts").cast("timestamp").alias("clock"),
    )


def _stream(spark, sf: str) -> DataFrame:
    schema = read(spark, sf, "events").schema
    return _progress(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def _folded(spark, stream: DataFrame, step, mode: str = "append") -> DataFrame:
    table = E.folded(stream, step, shared_folder(spark), mode)
    return spark.createDataFrame([], stream.schema) if table is None else table


_SQL = """e AS (SELECT user_id AS scan_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'log' WHEN event_type = 'purchase' THEN 'progress' ELSE 'status' END AS type,
 CASE WHEN event_type IN ('error', 'signup') THEN CASE WHEN event_id % 10 < 6 THEN 'running' WHEN event_id % 10 < 8 THEN 'queued' WHEN event_id % 10 = 8 THEN 'completed' ELSE 'cancelled' END END AS status,
 CASE WHEN event_type = 'purchase' THEN CAST(trunc(value % 100) AS INTEGER) END AS percent FROM events)"""


_BUSY = "b AS (SELECT * REPLACE (CASE WHEN scan_id % 3 = 0 THEN 0 ELSE scan_id END AS scan_id) FROM e)"


def _busy(events: DataFrame) -> DataFrame:
    """A third of all events as those of one scan, so that the limits are met."""
    return events.withColumn("scan_id", F.when(F.col("scan_id") % 3 == 0, 0).otherwise(F.col("scan_id")))


def _beaten(stream: DataFrame, root: str) -> tuple[DataFrame, Callable[[], None]]:
    """A stream beside one that is empty until the function is called, which gives it a row (type "beat") far behind all others in time."""
    spark, later = stream.sparkSession, F.lit("2100-01-01").cast("timestamp")
    beat = spark.createDataFrame([], stream.schema)
    beat.write.parquet(f"{root}/beat")
    row = spark.range(1).select(*[(later if f.dataType.typeName() == "timestamp" else F.lit("beat" if f.name == "type" else None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    beats = spark.readStream.schema(stream.schema).parquet(f"{root}/beat")
    return stream.unionByName(beats), lambda: row.write.mode("append").parquet(f"{root}/beat")


@query(f"""WITH {_SQL} SELECT scan_id, coalesce(arg_max(status, seq) FILTER (type = 'status'), '-') AS status, coalesce(arg_max(percent, seq) FILTER (type = 'progress'), -1) AS percent,
 count(*) FILTER (type = 'log') AS logs, max(seq) AS last_seq FROM e GROUP BY scan_id""")
def stream_fold_latest(spark, sf):
    latest = _folded(spark, E.latest_state(_stream(spark, sf)), E.upsert, "update")
    return latest.select("scan_id", F.coalesce("status", F.lit("-")).alias("status"), F.coalesce("percent", F.lit(-1)).alias("percent"), "logs", "last_seq")


@query(f"WITH {_SQL}, {_BUSY}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq DESC) AS k FROM b) SELECT scan_id, seq, type FROM r WHERE k <= {E.BACKLOG}")
def stream_backlog(spark, sf):
    return S.backlog(_busy(_stream(spark, sf)), shared_folder(spark)).select("scan_id", "seq", "type")


@query(f"WITH {_SQL}, {_BUSY}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq DESC) AS k FROM b WHERE type = 'log') SELECT scan_id, seq FROM r WHERE k <= {E.LOG_TAIL}")
def stream_logs_tail(spark, sf):
    logs = _busy(_stream(spark, sf)).where(F.col("type") == "log")
    return S.backlog(logs, shared_folder(spark), E.LOG_TAIL).select("scan_id", "seq")


@query(f"""WITH {_SQL}, {_BUSY}, m AS (SELECT max(seq) // 2 AS upto FROM b), r AS (SELECT b.*, row_number() OVER (PARTITION BY scan_id ORDER BY seq DESC) AS k FROM b, m WHERE seq <= upto)
SELECT scan_id, seq, 'replay' AS part FROM r WHERE k <= {E.BACKLOG} UNION ALL SELECT scan_id, seq, 'live' FROM b, m WHERE seq > upto""")
def stream_subscribe(spark, sf):
    past = _busy(_progress(read(spark, sf, "events")))
    upto = past.agg(F.floor(F.max("seq") / 2).alias("upto"))
    backlog = E.newest(past.join(F.broadcast(upto), F.col("seq") <= F.col("upto")).drop("upto"))  # one row
    live = E.appended(E.subscribe(backlog, _busy(_stream(spark, sf))), shared_folder(spark))
    parts = [rows.select("scan_id", "seq", F.lit(part).alias("part")) for rows, part in ((backlog, "replay"), (live, "live"))]
    return parts[0].unionByName(parts[1])


_SQL_STEPS = """s AS (SELECT scan_id, seq, type, status, lag(status) OVER w AS before, max(CASE WHEN type = 'deleted' OR status IN ('completed', 'failed', 'cancelled') THEN 1 ELSE 0 END)
 OVER (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_ FROM d WHERE type IN ('status', 'deleted') WINDOW w AS (PARTITION BY scan_id ORDER BY seq))
SELECT scan_id, seq, status, coalesce(before, '-') AS before, status IN ('completed', 'failed') AS done FROM s WHERE coalesce(over_, 0) = 0 AND type = 'status'"""


def _steps(spark, events: DataFrame) -> DataFrame:
    root = shared_folder(spark)
    both, beat = _beaten(events, root)
    stream = S.streamed_steps(both, "1 hour")
    S.appended(stream, root)
    beat()
    steps = S.appended(stream, root)  # goes on from the checkpoint
    return steps.select("scan_id", "seq", "status", F.coalesce("before", F.lit("-")).alias("before"), E.finished(F.col("status")).alias("done"))


@query(f"WITH {_SQL}, d AS (SELECT * FROM e), {_SQL_STEPS}")
def stream_state_machine(spark, sf):
    return _steps(spark, _stream(spark, sf))


@query(f"WITH {_SQL}, d AS (SELECT * REPLACE (CASE WHEN percent >= 90 THEN 'deleted' ELSE type END AS type) FROM e), {_SQL_STEPS}")
def stream_deletions(spark, sf):
    """Scans end with their deletion, which progress near the end stands for."""
    gone = F.when(F.col("percent") >= 90, "deleted").otherwise(F.col("type"))
    return _steps(spark, _stream(spark, sf).withColumn("type", gone))


@query(f"WITH {_SQL} SELECT scan_id, count(*) AS n FROM e WHERE scan_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY scan_id")
def stream_live_only(spark, sf):
    scans = read(spark, sf, "customer").where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("scan_id"))
    return E.appended(E.live_only(_stream(spark, sf), scans), shared_folder(spark)).groupBy("scan_id").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT user_id AS session, event_type || '.example' AS host, ts, min(ts) OVER (PARTITION BY user_id) AS began FROM events)
SELECT session, coalesce(bool_or(contains(host, 'purchase') AND epoch(date_trunc('second', ts)) - epoch(date_trunc('second', began)) <= 604800), false) AS seen FROM f GROUP BY session""")
def flow_hosts(spark, sf):
    events = read(spark, sf, "events")
    began = events.groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("began"))
    flows = events.select(F.col("user_id").alias("session"), F.concat("event_type", F.lit(".example")).alias("host"), "ts").join(began, "session")
    return E.seen_hosts(flows, "purchase", within_seconds=7 * 86400)


@query("""SELECT c_custkey AS session, coalesce(bool_or(event_type = 'purchase' AND CAST(floor(value) AS BIGINT) % 13 <= 6), false) AS seen
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey""")
def stream_flow_hosts(spark, sf):
    """Customers stand for sessions; each event is a flow that came 0 to 12 seconds after their start, as its value says."""
    root = shared_folder(spark)
    began = lambda who: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(who))
    clients = spark.readStream.schema(read(spark, sf, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    starts, beat_starts = _beaten(clients.select(F.col("c_custkey").alias("session"), began("c_custkey").alias("began")), f"{root}/starts")
    events = spark.readStream.schema(read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    after = F.make_dt_interval(secs=F.floor("value") % 13)
    flows = events.select(F.col("user_id").alias("session"), F.concat("event_type", F.lit(".example")).alias("host"), (began("user_id") + after).alias("ts"))
    flows, beat_flows = _beaten(flows, f"{root}/flows")
    stream = S.seen_in_time(starts, flows, "purchase", 6, "1 hour")
    S.appended(stream, root)
    beat_starts()
    beat_flows()
    return S.appended(stream, root).groupBy("session").agg(F.bool_or("seen").alias("seen"))
