"""SimHash near-dedup: fingerprints of whole texts and a Gray-order hierarchical index in which those that differ in few bits are found."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut_table, drop_table, table
from auditlake.llm.near_copies import components

WORDS = 3
SEED = 42
#: Bits in which fingerprints that link may differ.
MOST_BITS = 3
#: Children of a node of the index, and codes below one of its lowest nodes.
FAN = 16
#: Rows of one bucket that are searched together, and rows of a task, about.
BLOCK = 1024
TASK_ROWS = 4096
#: Shares in which the rows of a bucket are dealt while buckets are counted.
SHARES = 16
#: Times a bucket that is too large is divided by a further part of the fingerprint.
DIVISIONS = 2
#: Fingerprints of more copies than one row in so many are looked up in a table of their own, which has at most so many rows.
HOT_SETS = 1000
_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """A bit is set where over half of the 64-bit hashes of the text's 3-word shingles, repeats included, have it set; 0 without words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    inside = np.concatenate(([False], ~_SPACE[np.frombuffer(raw, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return 0
    starts, ends = edges[::2], edges[1::2]
    words = len(starts)
    joined, said = raw[starts[0] : ends[-1]], starts - starts[0]
    if int((starts[1:] - ends[:-1]).max(initial=1)) > 1 or any(c in joined for c in b"\t\n\x0b\x0c\r"):
        joined = b" ".join(joined.split())
        said = np.concatenate(([0], np.cumsum(ends - starts + 1)[:-1]))
    n = max(1, words - WORDS + 1)
    lasts = (said + (ends - starts))[min(WORDS, words) - 1 :].tolist()
    firsts = said[:n].tolist()
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, _AT_ONCE):
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(firsts[at : at + _AT_ONCE], lasts[at : at + _AT_ONCE], strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch["text"]], _U)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "code": found.view(np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, code (the fingerprint as a long) of every row of ``docs``."""
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # text, as pandas would make ids floats where some are missing
    return named.mapInPandas(_fingerprints, "doc_id string, code long").withColumn("doc_id", F.col("doc_id").cast("long"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(shift)
    return rank


class GrayIndex:
    """Codes sorted by Gray rank, under nodes of FAN children each.

    A node holds the bits that all codes below it share (a mask and their values), less those that its parent holds already. So
    the differences that a search counts on its way down add up, each shared pattern is compared once for all codes below it, and
    a group whose sum passes the bound is left whole. ``fixed`` are bits in which no difference is allowed: there one difference
    counts as too many.
    """

    def __init__(self, codes: np.ndarray, fixed: int = 0) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fixed = codes[self.order], _U(fixed)
        levels = [(np.full(len(codes), ~_U(0)), self.codes)]
        while len(levels[-1][0]) > 1:
            mask, value = levels[-1]
            starts = np.arange(0, len(mask), FAN)
            first = np.repeat(value[starts], np.diff(np.append(starts, len(mask))))
            shared = np.bitwise_and.reduceat(mask & ~(value ^ first), starts)
            levels.append((shared, value[starts] & shared))
        for i in range(len(levels) - 1):  # what the parent holds is factored out
            mask, value = levels[i]
            rest = mask & ~np.repeat(levels[i + 1][0], FAN)[: len(mask)]
            levels[i] = rest, value & rest
        self.levels = levels[::-1]

    def pairs(self, most: int = MOST_BITS, queries: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j), i before j in Gray order, of codes that differ in at most so many bits."""
        for low in range(0, len(self.codes), queries):
            who = np.arange(low, min(low + queries, len(self.codes)))
            node = np.zeros(len(who), np.int64)
            apart = np.zeros(len(who), np.int64)
            for depth, (mask, value) in enumerate(self.levels):
                if depth:
                    children = node[:, None] * FAN + np.arange(FAN)
                    who, apart, node = np.repeat(who, FAN), np.repeat(apart, FAN), children.ravel()
                    span = FAN ** (len(self.levels) - 1 - depth)
                    there = (node < len(mask)) & (node * span + span - 1 > who)  # a pair is found from its first code
                    who, apart, node = who[there], apart[there], node[there]
                differ = (self.codes[who] ^ value[node]) & mask[node]
                apart = apart + np.bitwise_count(differ) + np.where(differ & self.fixed, most + 1, 0)
                near = apart <= most
                who, apart, node = who[near], apart[near], node[near]
            yield who, node


def joining_links(codes: np.ndarray, fixed: int = 0, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes and of others that they are joined with: as many as join all that links within the bound join, one a code at most."""
    index = GrayIndex(codes, fixed)
    group = np.arange(len(codes))
    for i, j in index.pairs(most):
        while len(i):
            a, b = group[i], group[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
            while (group != group[group]).any():
                group = group[group]
    joined = np.flatnonzero(group != np.arange(len(codes)))
    return index.order[joined], index.order[group[joined]]


def _key_width(division: int) -> int:
    """Bits that a bucket's codes have in common: a quarter of 64, then a quarter of what is left, and so on."""
    width = 0
    for _ in range(division + 1):
        width += (64 - width) // 4
    return width


def _dealt(codes: DataFrame, division: int) -> DataFrame:
    """The rows of ``codes`` (own, way, code) four times, by a further part of the code: of two codes within three bits one part of the
    four is equal. ``code`` is turned so that the bits that make the bucket come first; ``way`` tells how, ``own`` is the code as it was."""
    done = _key_width(division - 1)
    left = 64 - done
    low = F.lit((1 << left) - 1 if left < 64 else -1).cast("long")
    rest, head = F.col("code").bitwiseAND(low), F.col("code").bitwiseAND(F.bitwise_not(low))

    def turned(by: int) -> Column:
        return head.bitwiseOR(F.shiftleft(rest, by).bitwiseAND(low)).bitwiseOR(F.shiftrightunsigned(rest, left - by)) if by else F.col("code")

    ways = F.array(*[F.struct((F.col("way") * 4 + k).alias("way"), turned(k * (left // 4)).alias("code")) for k in range(4)])
    bucket = F.shiftrightunsigned("code", 64 - _key_width(division)).alias("bucket")
    rows = codes.select("own", F.explode(ways).alias("turned")).select("own", "turned.*")
    return rows.select("own", "way", "code", bucket, F.pmod(F.xxhash64("own"), F.lit(SHARES)).alias("share"))


def _searched(rows: DataFrame, by: list[Column | str], division: int, most: int) -> DataFrame:
    """a, b: links among the rows that are equal by ``by`` (their way among it) and, of these, in one bucket."""
    width = _key_width(division)
    fixed = ((1 << width) - 1) << (64 - width)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        a, b = joining_links(own["code"].to_numpy().view(_U), fixed, most)
        names = own["own"].to_numpy()
        return pd.DataFrame({"a": names[a], "b": names[b]})

    return rows.groupBy(*by).applyInPandas(run, "a long, b long").distinct()


def links(codes: DataFrame, most: int = MOST_BITS, block: int = BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """a, b of distinct ``codes`` (code), enough to join all that links of at most ``most`` differing bits (three at most) join.

    Each code goes to four buckets, by a quarter of its bits. Buckets are searched several in a task, which has one index of its codes in
    Gray order. A bucket of more than ``block`` codes is divided by a quarter of its other bits, twice at most; codes that meet in
    large buckets even then differ in 27 bits only, and are compared in pairs of blocks. Of large buckets with the same codes one is
    followed up.
    """
    if most > 3:
        raise ValueError("codes are dealt by quarters: links may have three differing bits at most")
    rows, found, old = codes.select(F.col("code").alias("own"), F.lit(0).alias("way"), "code"), [], []
    for division in range(DIVISIONS + 1):
        dealt = cut_table(_dealt(rows, division))
        sizes = dealt.groupBy("way", "bucket").agg(F.count("*").alias("n"), F.min("own").alias("least"), F.bit_xor(F.xxhash64("own")).alias("all"))
        large = cut_table(sizes.where(F.col("n") > block))
        shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
        at = ["way", "bucket", "share"]
        small = dealt.join(large.select("way", "bucket", shares), at, "left_anti")
        tasks = max(1, small.count() // (4 ** (division + 1) * task_rows))
        task = F.pmod(F.xxhash64("bucket"), F.lit(tasks)).alias("task")
        found.append(cut_table(_searched(small, ["way", task], division, most)))
        old += [dealt, large]
        if not large.limit(1).count():
            break
        once = large.groupBy("n", "least", "all").agg(F.min(F.struct("way", "bucket")).alias("one")).select("one.*", "n")
        rows = dealt.join(once.select("*", shares), at)
    else:
        parts = rows.withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
        blocks = parts.select("*", F.pmod(F.xxhash64("own"), F.col("parts")).cast("int").alias("part"))
        blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        pair = [F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")]
        found.append(cut_table(_searched(blocks, ["way", "bucket", *pair], DIVISIONS, most)))
    every = cut_table(reduce(DataFrame.unionByName, found).distinct())
    drop_table(*found, *old)
    return every


def near_copies(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of ``docs`` (doc_id, text; other columns are left out).

    Two documents link if their fingerprints differ in at most ``most`` bits; component_id is the smallest doc_id reachable. A text without
    words, or none, has fingerprint zero and links like any other. Equal fingerprints are one code, which is joined once. Repeated rows
    get equal results; a null id is no component_id unless all of its group are null. Without rows the result has none.
    """
    printed = cut_table(fingerprints(docs))
    codes = cut_table(printed.groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    linked = links(codes.select("code"), most)
    grouped = components(linked)
    drop_table(linked)
    named = codes.join(grouped.withColumnRenamed("key", "code"), "code", "left").withColumn("component", F.coalesce("component", "code"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    result = cut_table(named.join(least, "component").select("code", "copies", "component_id"))
    drop_table(grouped, codes)
    many = max(1, printed.count() // HOT_SETS)
    hot = F.broadcast(result.where(F.col("copies") > many).drop("copies"))
    others = printed.join(hot.select("code"), "code", "left_anti").join(result.where(F.col("copies") <= many).drop("copies"), "code")
    both = printed.join(hot, "code").unionByName(others)
    return both.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; see ``near_copies``."""
    return near_copies(table(spark, sf_dir, "documents"))
