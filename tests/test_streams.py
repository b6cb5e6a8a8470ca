from pyspark.sql import functions as F

from auditlake.sources.shared import Versions
from auditlake.streaming import events as E
from auditlake.streaming import stateful as S

SCHEMA = "scan_id long, seq long, type string, status string, percent int"


def part(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def status(scan, seq, word):
    return (scan, seq, "status", word, None)


def test_fold_goes_on_over_parts_and_runs(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    step = lambda kept, batch: E.merge_backlog(kept, batch, 2)
    part(spark, source, [status(1, 1, "queued"), status(1, 2, "running")])
    part(spark, source, [status(1, 3, "running"), status(2, 4, "queued")])
    seen = E.folded(E.stream_of(spark, source, SCHEMA), step, root)
    assert sorted((r.scan_id, r.seq) for r in seen.collect()) == [(1, 2), (1, 3), (2, 4)]
    part(spark, source, [status(1, 5, "completed"), status(None, 6, None)])
    seen = E.folded(E.stream_of(spark, source, SCHEMA), step, root)
    assert sorted((r.scan_id or 0, r.seq) for r in seen.collect()) == [(0, 6), (1, 3), (1, 5), (2, 4)]
    assert len(Versions(spark, f"{root}/table").whole()) == 2


def test_fold_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    seen = E.folded(E.stream_of(spark, f"{tmp_path}/in", SCHEMA), E.merge_backlog, f"{tmp_path}/out")
    assert seen is None or seen.count() == 0


def test_a_version_that_was_not_ended_does_not_count(spark, tmp_path):
    table = Versions(spark, f"{tmp_path}/t")
    assert table.read() is None
    table.write(spark.range(1), 0)
    (tmp_path / "t" / "v1").mkdir()
    assert table.whole() == [0] and table.read().count() == 1 and table.read(before=0) is None


CLOCKED = f"{SCHEMA}, clock timestamp"


def clocked(spark, folder, rows):
    made = spark.createDataFrame(rows, SCHEMA).withColumn("clock", F.timestamp_seconds(F.col("seq") * 60))
    made.coalesce(1).write.mode("append").parquet(folder)


def test_states_over_parts_in_any_order(spark, tmp_path):
    parts = [
        [status(1, 2, "running"), status(1, 1, "queued"), (1, 3, "log", None, None), status(None, 9, None)],
        [status(1, 5, "failed"), status(1, 4, "completed"), status(2**53 + 1, 6, "queued")],
        [status(1, 7, "running"), status(2**53 + 1, 8, "cancelled"), status(3, 2, "queued"), status(3, 6, "completed")],
        [(3, 5, "deleted", None, None), status(3, 3, "running")],
    ]
    want = [
        (1, 1, None, "queued"), (2, 1, "queued", "running"), (2, 3, None, "queued"), (3, 3, "queued", "running"), (4, 1, "running", "completed"),
        (6, 2**53 + 1, None, "queued"), (8, 2**53 + 1, "queued", "cancelled"), (9, None, None, None),
    ]
    everything = spark.createDataFrame(sum(parts, []), SCHEMA)
    assert sorted((r.seq, r.scan_id, r.before, r.status) for r in E.statuses(everything).collect()) == want
    for name, order in (("forth", parts), ("back", parts[::-1])):
        source, root = f"{tmp_path}/{name}", f"{tmp_path}/{name}-out"
        for rows in order:
            clocked(spark, source, rows)
        steps = lambda: S.appended(S.streamed_steps(E.stream_of(spark, source, CLOCKED), "1 hour"), root)
        assert steps().count() == 0  # the watermark is behind all of them
        clocked(spark, source, [(None, 100, "beat", None, None)])
        assert sorted((r.seq, r.scan_id, r.before, r.status) for r in steps().collect()) == want
        clocked(spark, source, [status(3, 101, "running"), status(4, 102, "queued"), (None, 200, "beat", None, None)])
        assert sorted(r.seq for r in steps().collect() if r.seq > 9) == [102]  # what was deleted stays so


def test_backlog_in_state(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(s, i, "log", None, i) for s in (1, None) for i in range(10)] + [(2, 0, "log", "x", None)]
    for low in (7, 3, 0):
        part(spark, source, [r for r in rows if low <= r[1] < (10 if low == 7 else 7 if low == 3 else 3)])
    stream = E.stream_of(spark, source, SCHEMA)
    got = S.backlog(stream, root, 4)
    assert got.columns == stream.columns
    want = E.newest(spark.createDataFrame(rows, SCHEMA), 4)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    part(spark, source, [(1, 20, "log", None, None), (1, 1, "log", None, None)])  # goes on from the checkpoint
    assert sorted(r.seq for r in S.backlog(E.stream_of(spark, source, SCHEMA), root, 4).collect() if r.scan_id == 1) == [7, 8, 9, 20]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none")
    assert S.backlog(E.stream_of(spark, f"{tmp_path}/none", SCHEMA), f"{tmp_path}/none-out").count() == 0


def test_sessions_and_their_first_flows(spark, tmp_path):
    begin = [(1, 0.0), (2, 0.0), (3, 50.0), (None, 90_000.0)]
    flows = [(1, "api.shop", 6.0), (2, "api.shop", 6.001), (2, "other", 1.0), (3, "api.shop", 49.0), (None, None, 90_000.0)]
    at = F.timestamp_millis(((F.col("at") + 1e9) * 1000).cast("long"))
    spark.createDataFrame(begin, "session long, at double").select("session", at.alias("began")).write.parquet(f"{tmp_path}/starts")
    spark.createDataFrame(flows, "session long, host string, at double").select("session", "host", at.alias("ts")).write.parquet(f"{tmp_path}/flows")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    stream = S.seen_in_time(read("starts", "session long, began timestamp"), read("flows", "session long, host string, ts timestamp"), "shop", 6, "1 minute")
    assert sorted((r.session, r.seen) for r in S.appended(stream, f"{tmp_path}/out").collect()) == [(1, True), (2, False), (3, False)]


def test_upsert_and_subscribe(spark):
    kept = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "scan_id long, v string")
    changed = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "scan_id long, v string")
    assert sorted((r.scan_id or 0, r.v) for r in E.upsert(kept, changed).collect()) == [(0, "y"), (1, "x"), (3, "c"), (4, "z")]
    backlog = spark.createDataFrame([status(1, 1, "queued"), status(1, 3, "running")], SCHEMA)
    live = backlog.unionByName(spark.createDataFrame([status(1, 4, "failed"), status(2, 2, "queued")], SCHEMA))
    assert sorted((r.scan_id, r.seq) for r in E.subscribe(backlog, live).collect()) == [(1, 4), (2, 2)]


def test_hosts_seen_in_time(spark):
    flows = spark.sql("SELECT * FROM VALUES (1, 'api.shop', TIMESTAMP'2024-01-01 00:00:06', TIMESTAMP'2024-01-01 00:00:00'), (2, 'api.shop', TIMESTAMP'2024-01-01 00:00:07', TIMESTAMP'2024-01-01 00:00:00'), (3, NULL, NULL, NULL) AS f(session, host, ts, began)")
    assert {r.session: r.seen for r in E.seen_hosts(flows, "shop").select("session", F.col("seen")).collect()} == {1: True, 2: False, 3: False}


def test_state_is_written_once_for_a_scan_and_not_for_each_row():
    from pyspark.sql import Row

    class Kept:
        def __init__(self):
            self.value, self.writes = [], 0

        def get(self):
            return iter(self.value)

        def put(self, rows):
            self.value, self.writes = list(rows), self.writes + 1

        def appendList(self, rows):
            self.put([*self.value, *rows])

        def clear(self):
            self.put([])

    class Last(Kept):
        def get(self):
            return self.value or None

        def update(self, value):
            self.put(value)

    steps, timers, at = S._Steps(), [], lambda ms: type("At", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    steps.waiting, steps.last, steps.timers = Kept(), Last(), type("Timers", (), {"registerTimer": lambda self, ms: timers.append(ms)})()
    row = lambda seq, status, kind="status": Row(seq=seq, type=kind, status=status, at=seq * 10)
    assert list(steps.handleInputRows((1,), iter([row(k, "running") for k in range(50, 0, -1)] + [row(99, None, "beat"), row(7, "queued")]), at(0))) == []
    assert steps.waiting.writes == 1 and timers == [500]
    first = list(steps.handleExpiredTimer((1,), at(300), None))
    assert [(r.seq, r.status, r.before) for r in first[5:8]] == [(6, "running", "running"), (7, "queued", "running"), (8, "running", "queued")]
    assert len(first) == 30 and len(steps.waiting.value) == 20 and steps.waiting.writes == 2 and steps.last.writes == 1
    steps.handleInputRows((1,), iter([row(40, None, "deleted")]), at(300))
    assert [r.seq for r in steps.handleExpiredTimer((1,), at(500), None)] == list(range(31, 40))
    assert steps.waiting.value == [] and list(steps.handleExpiredTimer((1,), at(900), None)) == []
    steps.handleInputRows((1,), iter([row(60, "running")]), at(900))
    assert steps.waiting.value == [] and len(timers) == 2
