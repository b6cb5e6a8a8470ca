"""SimHash: fingerprints by Spark's own hash, groups by brute force, the index, hot buckets and odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import simhash
from auditlake.llm.common import table

SCHEMA = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"


def groups(codes, most=3):
    """Smallest place reachable by links, for each code, by brute force."""
    codes = np.array(codes, np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= most
    least = np.arange(len(codes))
    while True:
        new = np.array([least[row].min() for row in near])
        if (new == least).all():
            return least.tolist()
        least = new


def test_fingerprints_equal_a_plain_count(spark):
    """Words by a regular expression, hashes by Spark's function, bits counted one by one."""
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    held = docs.withColumn("w", words).where(F.size("w").between(1, 300))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)))
    hashes = held.select("doc_id", F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " "))).alias("h")).collect()
    mine = {r.doc_id: r.code & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    assert len(hashes) > 50
    for r in hashes:
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))
        assert mine[r.doc_id] == want


def test_odd_texts():
    one = simhash.fingerprint
    assert one(None) == one("") == one(" \n\t ") == 0
    assert one("Ab  CD\x0bé") == one("ab cd é") != one("ab cd É")
    assert one("a b") == one("A  b\n") != one("b a")
    assert one("x " * 200_000) == one("x x x") and one("\x1c a") != one("a")


@pytest.mark.parametrize("n", [0, 1, 2, 17, 700])
def test_index_finds_all_pairs(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 1 + n // 20, dtype=np.uint64)
    flipped = [np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64) for _ in range(2)]
    codes = np.unique(centres[rng.integers(0, len(centres), n)] ^ flipped[0] ^ flipped[1])
    index = simhash.GrayIndex(codes)
    got = {(int(index.codes[a]), int(index.codes[b])) for i, j in index.pairs(queries=100) for a, b in zip(i, j, strict=True) if a != b}
    want = {frozenset((int(a), int(b))) for k, a in enumerate(codes) for b in codes[:k] if int(a ^ b).bit_count() <= 3}
    assert {frozenset(p) for p in got} == want and len(got) == len(want)
    shared = 0xFFFF << 48
    some = {frozenset((int(codes[a]), int(codes[b]))) for a, b in zip(*simhash.joining_links(codes, shared), strict=True)}
    assert all((min(p) ^ max(p)) & shared == 0 for p in some)


def _coded(spark, codes):
    return spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "code long")


@pytest.mark.parametrize("block", [8, 1024])
def test_links_join_what_brute_force_joins(spark, block):
    """Random codes, clusters around some, and a dense cluster whose codes differ in the lowest bits only, which no division takes apart."""
    rng = random.Random(block)
    codes = {rng.getrandbits(64) for _ in range(300)}
    for c in list(codes)[:60]:
        for _ in range(5):
            codes.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    dense = rng.getrandbits(64)
    codes |= {dense ^ rng.getrandbits(9) for _ in range(120)} | {dense ^ 1 << 63, dense ^ 7 << 20, dense ^ 15 << 40}
    codes = sorted(codes)
    place = {int(np.uint64(c).astype(np.int64)): i for i, c in enumerate(codes)}
    edges = [(place[r.a], place[r.b]) for r in simhash.links(_coded(spark, codes), block=block, task_rows=64).collect()]
    least, before = list(range(len(codes))), None
    while least != before:
        before = list(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert least == groups(codes)


def test_near_copies_equal_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    got = {r.doc_id: r for r in simhash.near_copies(docs).collect()}
    rows = sorted((r.doc_id, simhash.fingerprint(r.text)) for r in docs.collect())
    least = groups([c for _, c in rows])
    assert len(got) == len(rows) and any(i != g for i, g in enumerate(least))
    for (doc_id, code), g in zip(rows, least, strict=True):
        assert re.fullmatch("[0-9a-f]{16}", got[doc_id].fingerprint) and int(got[doc_id].fingerprint, 16) == code
        assert got[doc_id].component_id == rows[g][0]


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (None, " "), (7, "one two three four"), (7, "one two three four"), (None, "ONE two three four"), (None, "alone here"), (9, "w " * 50_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash")).withColumn("code", F.lit(1))
    out = simhash.near_copies(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted((str(r.doc_id), str(r.component_id), r.fingerprint == "0" * 16) for r in out.collect())
    assert got == sorted([("5", "3", True), ("3", "3", True), ("None", "3", True), *[("7", "7", False)] * 2, ("None", "7", False), ("None", "None", False), ("9", "9", False)])
    assert simhash.near_copies(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="three"):
        simhash.links(docs.select(F.col("code").cast("long")), most=4)
