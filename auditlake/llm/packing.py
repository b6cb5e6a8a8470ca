"""Best-fit packing of tokenized documents by hierarchical residual packing."""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import cut, table

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Pieces packed together in a task, and bins at most half full that come together in a round; both bound memory.
BLOCK = 65_536
GROUP = 128
#: Bins lacking no more than so many tokens are done.
SLACK = 4

_LONG_SPACE = re.compile(r"\s{2000}")

PLACED = "doc_id string, piece int, start long, length long, ids_crc32 long, bin long, offset long"
MERGED = "bin long, parent long, shift long, fill long"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _encoders(json_path: str, ranks_path: str):
    """The tokenizer, and a faster reader of the same vocabulary that gives the same ids for text without special tokens."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    return exact, fast, special


def token_ids(text: str, json_path: str, ranks_path: str) -> list[int]:
    """Ids of the whole text as the tokenizer gives them with add_special_tokens=False. The faster reader recurses over white space, so
    texts with a long run of it go to the tokenizer itself."""
    exact, fast, special = _encoders(json_path, ranks_path)
    if any(s in text for s in special) or _LONG_SPACE.search(text):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item (sizes from 1 to capacity).

    Open bins wait by the room they have; the tightest that holds an item is the lowest set bit from its size on.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    waiting: list[deque[int]] = [deque() for _ in range(capacity + 1)]
    rooms, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = waiting[room].popleft()
            if not waiting[room]:
                rooms &= ~(1 << room)
            offsets[i] = capacity - room
        else:
            room, chosen = capacity, count
            count += 1
        bins[i] = chosen
        if room > size:
            waiting[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins, offsets


def _pack_partition(capacity: int, end_id: int, json_path: str, ranks_path: str, block: int):
    def placed(rows: list[tuple], first_bin: int) -> tuple[pd.DataFrame, int]:
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        bins, offsets = best_fit(out["length"].to_numpy(np.int64), capacity)
        out["bin"], out["offset"] = bins + first_bin, offsets
        return out, first_bin + int(bins.max()) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_bin = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.asarray([*token_ids(text or "", json_path, ranks_path), end_id], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    if len(rows) == block:
                        out, next_bin = placed(rows, next_bin)
                        rows = []
                        yield out
        if rows:
            yield placed(rows, next_bin)[0]

    return run


def _merge(capacity: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("bin", kind="stable", ignore_index=True)
        bins, shifts = best_fit(items["fill"].to_numpy(np.int64), capacity)
        grouped = items.assign(parent=bins, shift=shifts)
        by_bin = grouped.groupby("parent")
        grouped["fill"] = by_bin["fill"].transform("sum")
        grouped["parent"] = by_bin["bin"].transform("min")
        return grouped[["bin", "parent", "shift", "fill"]]

    return run


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    json_path: str | None = None,
    ranks_path: str | None = None,
    block: int = BLOCK,
    group: int = GROUP,
    slack: int = SLACK,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of ``docs``.

    A document is its text's ids (null: none) and ``end_id``; one of more than ``capacity`` is cut into pieces of just that
    many, of which the first may be shorter. Each partition tokenizes its documents and packs their pieces best-fit decreasing,
    a block at a time. Bins lacking at most ``slack`` tokens are done; the others are items of further rounds. After best-fit packing,
    no two bins of a block are at most half full, and two that are fuller never fit together: so a round deals the bins at most
    half full into groups of about ``group``, with them the fuller ones that have room for the least of these (of each fill as
    many as the group can use), and packs each group best-fit. One half-full bin is left of a group at most, so the rounds form a
    tree; they end when one group has held all that is left. Repeated rows are packed each on its own; a null id stays
    null; no rows give no rows. Other columns of ``docs`` are left out.
    """
    json_path = json_path or vocabulary_path(f"{VOCABULARY}.json")
    ranks_path = ranks_path or vocabulary_path(f"{VOCABULARY}.tiktoken")
    # Ids travel as text: among nulls pandas would make them floating-point numbers.
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = texts.mapInPandas(_pack_partition(capacity, end_id, json_path, ranks_path, block), PLACED)
    placed = cut(placed.withColumn("doc_id", F.col("doc_id").cast("long")))
    under = F.col("fill") < capacity - slack
    movable = F.col("fill") <= capacity // 2
    bins = cut(placed.groupBy("bin").agg(F.sum("length").alias("fill")).where(under))
    moved, turn = None, 0
    while True:
        few = bins.where(movable).agg(F.count("*").alias("n"), F.min("fill").alias("least")).first()
        if not few["n"]:
            break
        turn += 1
        groups = ceil(few["n"] / group)
        dealt = bins.where(movable | (F.col("fill") <= capacity - few["least"])).withColumn("g", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups)))
        place = F.row_number().over(Window.partitionBy("g", "fill").orderBy("bin"))
        useful = few["n"] if groups == 1 else 4 * group
        receivers = dealt.where(~movable).withColumn("place", place).where(F.col("place") <= useful).drop("place")
        merged = cut(dealt.where(movable).unionByName(receivers).groupBy("g").applyInPandas(_merge(capacity), MERGED))
        step = merged.select(F.col("bin").alias("from"), "parent", "shift")
        if moved is None:
            moved = step
        else:
            then = step.select(F.col("from").alias("then"), F.col("parent").alias("to"), F.col("shift").alias("more"))
            moved = moved.join(then, F.col("parent") == F.col("then"), "full").select(
                F.coalesce("from", "then").alias("from"), F.coalesce("to", "parent").alias("parent"), (F.coalesce("shift", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("shift")
            )
        if groups == 1:
            break
        after = merged.groupBy(F.col("parent").alias("bin")).agg(F.first("fill").alias("fill"))
        bins = cut(bins.join(merged.select("bin"), "bin", "left_anti").unionByName(after).where(under))
    if moved is None:
        return placed.withColumnRenamed("bin", "sequence_id")
    return placed.join(moved, F.col("bin") == F.col("from"), "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("parent", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; see ``pack``."""
    return pack(table(spark, sf_dir, "documents"))
