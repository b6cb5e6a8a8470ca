"""Segmented scans against plain loops, with one key that holds most rows and so stands in every range."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import context, verdicts
from auditlake.operators.segments import Segments

SCHEMA = "k string, at long, v string, n long, said string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["a", "a", "a", "b", None]
    made = [("hot", i, rng.choice(words), rng.randrange(9), rng.choice(["(already read to the end)", "x", "x", None])) for i in range(400)]
    made += [(k, i, rng.choice(words), None if i == 3 else i, "x") for k in ("c", None, "z") for i in range(7)] + [("one", 5, "a", 1, "x")]
    rng.shuffle(made)
    return made


@pytest.fixture
def spread(spark, rows):
    """The rows as a table, in a session that keeps all ranges apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark.createDataFrame(rows, SCHEMA)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        keys.setdefault(r[0], []).append(r)
    return keys


def test_a_large_key_has_many_segments(spread):
    parts = Segments(spread, ["k"], ["at"])
    assert parts.rows.where("k = 'hot'").select("segment").distinct().count() > 3
    sums = parts.running(parts.rows, {"upto": F.col("n")})
    most = parts.running_max(parts.rows, F.col("n"), "most")
    got = {(r.k, r.at): (r.upto, r.upto_total) for r in sums.collect()}
    top = {(r.k, r.at): r.most for r in most.collect()}
    for key, own in by_key(spread.collect()).items():
        for i, r in enumerate(own):
            seen = [x.n for x in own[: i + 1] if x.n is not None]
            assert got[key, r.at][1] == sum(x.n or 0 for x in own) and (got[key, r.at][0] or 0) == sum(seen)
            assert top[key, r.at] == max(seen, default=None)


def test_stalls(spread, rows):
    got = {(r.k, r.at): (r.repeats, r.nudge) for r in verdicts.stalls(spread, "k", "at", "v", "said").collect()}
    for key, own in by_key(rows).items():
        count = 0
        for i, r in enumerate(own):
            same = (i > 0 and r[2] is not None and r[2] == own[i - 1][2]) or (r[4] or "").startswith("(already read to the end")
            count = count + 1 if same else 0
            assert got[key, r[1]] == (count, count > 0 and count % 2 == 0)
    assert len(got) == len(rows)


def test_runs(spread, rows):
    want = set()
    for key, own in by_key(rows).items():
        at = 0
        while at < len(own):
            end = at
            while end + 1 < len(own) and own[end + 1][2] == own[at][2]:
                end += 1
            if end - at >= 2:
                want.add((key, own[at][2], own[at][1], own[end][1], end - at + 1))
            at = end + 1
    assert {tuple(r) for r in verdicts.runs(spread, "k", "at", "v").collect()} == want


def test_last_context(spread, rows):
    got = {(r.k, r.at): r.context for r in verdicts.last_context(spread, "k", "at", "v").collect()}
    for key, own in by_key(rows).items():
        for i, r in enumerate(own):
            assert got[key, r[1]] == "; ".join(x[2] for x in own[max(0, i - 5) : i] if x[2] is not None)


def test_batches_and_tails(spread, rows):
    got = {(r.k, r.at) for r in context.batch_within(spread, ["k"], "at", "n", 300, 200).collect()}
    tails = {r.k: r.tail for r in context.transcript_tail(spread, "k", "at", "said", 40).collect()}
    for key, own in by_key(rows).items():
        before = 0
        for i, r in enumerate(own):
            assert ((key, r[1]) in got) == (before < 300 and i < 200)
            before += r[3] or 0
        assert tails[key] == "\n".join(r[4] for r in own if r[4] is not None)[-40:] or any(r[4] is None for r in own)
    assert context.batch_within(spread.limit(0), ["k"], "at", "n", 300, 200).count() == 0


def test_a_tail_begins_with_the_line_feed_behind_a_turn(spark):
    rows = [("k", 1, "aaa"), ("k", 2, None), ("k", 3, "bb"), ("k", 3, "ba"), ("k", None, "c"), ("k", 4, ""), ("q", 1, None)]
    turns = spark.createDataFrame(rows, "k string, at int, said string")
    for most in range(1, 15):
        found = {r.k: r.tail for r in context.transcript_tail(turns, "k", "at", "said", most).collect()}
        assert found == {"k": "aaa\nba\nbb\n\nc"[-most:], "q": None}
