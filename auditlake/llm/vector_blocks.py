"""Rows of vectors packed into blocks, and a query set against all blocks."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vectors(rows: DataFrame, component=lambda x: x) -> DataFrame:
    """vec_id, v (array<double>), dim, norm, of rows that take part: no null, empty or non-finite vector or component."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = rows.select("vec_id", "embedding").where(x.isNotNull() & (F.size(x) > 0) & finite & F.col("vec_id").isNotNull())
    v = good.select("vec_id", F.transform(x, lambda c: component(c.cast("double"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    return v.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def packed(rows: DataFrame, keys: list[str], size: int, more: tuple[str, ...] = ()) -> DataFrame:
    """keys, part, ids, vs (flat), norms and the columns ``more``: a row for about ``size`` vectors with equal keys. Which of its
    keys' blocks a vector goes to follows from its id, and how many there are from a count, so no key makes a large block."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("parts"))
    same = reduce(lambda a, b: a & b, (F.col(f"r.{k}") == F.col(f"c.{k}") for k in keys))
    dealt = rows.alias("r").join(counts.alias("c"), same).select("r.*", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"))
    block = dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct("vec_id", "v", "norm", *more)).alias("all"))
    pick = lambda c: F.transform("all", lambda r: r[c])
    return block.select(
        *keys,
        "part",
        pick("vec_id").alias("ids"),
        F.flatten(pick("v")).alias("vs"),
        pick("norm").alias("norms"),
        *[pick(c).alias(c) for c in more],
    )


def against(queries: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Each block of queries beside each block of vectors of the same dim. Blocks are dealt to slots, and a block of queries is
    sent to every slot, so the work is spread over as many tasks as there are blocks, whatever the keys are."""
    slots = max(1, n_blocks)
    slot = F.pmod(F.xxhash64(*[F.col(k) for k in blocks.columns if k in ("dim", "bucket", "part")]), F.lit(slots))
    there = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("q_slot"))
    here = blocks.withColumn("slot", slot)
    return here.join(there, (F.col("slot") == F.col("q_slot")) & (F.col("dim") == F.col("q_dim")))


def matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= floor)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def ranked(found: DataFrame, k: int, score: Column) -> DataFrame:
    """query_id, rank, vec_id, score of the k best found for each query; partial aggregation isn't needed, as blocks send k."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
