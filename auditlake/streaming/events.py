"""Progress events of scans: backlog, latest state, log tails and the state machine, the same for batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.sources.shared import Versions

BACKLOG = 3000
LOG_TAIL = 1500
TERMINAL = ("completed", "failed", "cancelled")
#: What a client takes as the end; it goes on waiting after a cancelled scan.
CLIENT_TERMINAL = ("completed", "failed")
STEP = "scan_id long, seq long, status string, before string"


def stream_of(spark: SparkSession, folder: str, schema, files_each: int = 1) -> DataFrame:
    """Events as a stream over a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def latest_state(events: DataFrame, key: str = "scan_id", seq: str = "seq") -> DataFrame:
    """Latest status and progress and the number of logs of each scan; works on a stream in complete or update mode."""
    last = lambda kind, value: F.max_by(F.when(F.col("type") == kind, F.col(value)), F.when(F.col("type") == kind, F.col(seq)))
    return events.groupBy(key).agg(
        last("status", "status").alias("status"),
        last("progress", "percent").alias("percent"),
        F.count_if(F.col("type") == "log").alias("logs"),
        F.max(seq).alias("last_seq"),
    )


def newest(events: DataFrame, n: int = BACKLOG, key: str = "scan_id", seq: str = "seq") -> DataFrame:
    """The newest n events of each scan."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return events.withColumn("place", place).where(F.col("place") <= n).drop("place")


def log_tail(events: DataFrame, n: int = LOG_TAIL) -> DataFrame:
    return newest(events.where(F.col("type") == "log"), n)


def merge_backlog(kept: DataFrame | None, batch: DataFrame, n: int = BACKLOG) -> DataFrame:
    """Backlog after one more micro-batch; the same as of all events at once."""
    return newest(batch if kept is None else kept.unionByName(batch), n)


def statuses(events: DataFrame, key: str = "scan_id", seq: str = "seq") -> DataFrame:
    """Status events until the first that is final or the deletion of the scan (an event of type "deleted"), with the one before; what
    comes later is dropped."""
    only = events.where(F.col("type").isin("status", "deleted"))
    by_seq = Window.partitionBy(key).orderBy(seq)
    ends = F.col("status").isin(*TERMINAL) | (F.col("type") == "deleted")
    over = F.max(F.coalesce(ends, F.lit(False)).cast("int")).over(by_seq.rowsBetween(Window.unboundedPreceding, -1))
    rows = only.withColumns({"before": F.lag("status").over(by_seq), "over": F.coalesce(over, F.lit(0))})
    return rows.where("over = 0 and type = 'status'").drop("over")


def upsert(kept: DataFrame | None, changed: DataFrame, key: str = "scan_id") -> DataFrame:
    """Rows kept, but for those whose key has a newer one. Rows with a null key are replaced, too."""
    if kept is None:
        return changed
    same = kept[key].eqNullSafe(changed[key])
    return kept.join(changed.select(key), same, "left_anti").unionByName(changed)


def subscribe(backlog: DataFrame, live: DataFrame, key: str = "scan_id", seq: str = "seq") -> DataFrame:
    """Live events that the replay of the backlog has not given: put behind the backlog they leave no gap and give no event twice."""
    upto = backlog.groupBy(F.col(key).alias("of")).agg(F.max(seq).alias("upto"))
    return live.join(upto, F.col(key) == F.col("of"), "left").where(F.col("upto").isNull() | (F.col(seq) > F.col("upto"))).drop("of", "upto")


def finished(status: Column, for_client: bool = True) -> Column:
    return status.isin(*(CLIENT_TERMINAL if for_client else TERMINAL))


def live_only(events: DataFrame, scans: DataFrame, key: str = "scan_id") -> DataFrame:
    """Events of scans that still exist; a stream joined with the table of scans."""
    return events.join(scans.select(key).distinct(), key, "left_semi")


def seen_hosts(flows: DataFrame, wanted: str, within_seconds: int = 6) -> DataFrame:
    """Sessions in whose first seconds a host that contains the text was seen."""
    near = F.col("host").contains(wanted) & (F.col("ts") <= F.col("began") + F.make_dt_interval(secs=F.lit(within_seconds)))
    return flows.groupBy("session").agg(F.coalesce(F.max(near), F.lit(False)).alias("seen"))


def folded(stream: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame], root: str, mode: str = "append") -> DataFrame | None:
    """Run a stream over all that is there; ``step`` makes the next version of a table from the one before (None at first) and a micro-batch.
    Gives the last version, None if no event ever came. The version is numbered by the micro-batch, so one that runs again changes
    nothing, and a new run with the same folder goes on where the last one ended."""
    table = Versions(stream.sparkSession, f"{root}/table")

    def one(batch: DataFrame, number: int) -> None:
        table.write(step(table.read(before=number), batch), number)

    writer = stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return table.read()


def appended(stream: DataFrame, root: str) -> DataFrame:
    """Run a stream over all that is there into a Parquet folder, each row once; the rows written so far."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")
