"""Exact top-k inner-product search by norm buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut, table
from auditlake.llm.vector_blocks import against, best_rows, matrix, packed, ranked, vectors

K = 5
#: Buckets for each doubling of length, and vectors of a block.
BUCKETS_PER_DOUBLING = 4
BLOCK = 2048
QUERY_BLOCK = 512
SEED_BLOCKS = 2
#: From this local cosine threshold on, coordinates prune better than lengths; so many coordinates are looked at.
COORDINATE_FROM = 0.45
FOCUS = 4
#: From here on doubles skip whole numbers; the greatest score that is told apart from others.
DOUBLE = float(1 << 53)
LONG = (1 << 63) - 1


def _whole_scores(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size, without rounding, held within what a long can say."""
    own = [int(x) for x in q]
    return np.array([min(max(sum(int(x) * y for x, y in zip(row, own, strict=True)), -LONG), LONG) for row in rows], np.int64)


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, thresholds: np.ndarray, rows: np.ndarray, ids: np.ndarray, norms: np.ndarray, k: int, whole: bool = False
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of at most k rows of one bucket that may be among the query's best.

    theta is a score that k rows of other blocks reach already. A row of length l needs a cosine of theta / (|q| l), and the
    bucket's longest row sets the least cosine t of all. t > 1 skips the bucket. A high t bounds each coordinate of a unit row
    (t q_f +- sqrt((1 - t^2)(1 - q_f^2)) on the far sides), and the largest coordinates of the query choose the
    rows; a low t leaves the rows that are long enough. What is left is verified with whole products. With ``whole``, components are
    whole numbers, and products that doubles can't hold are made of Python's numbers.
    """
    order = np.argsort(-norms, kind="stable")
    rows, ids, norms = rows[order], ids[order], norms[order]
    unit = rows / np.where(norms > 0, norms, 1)[:, None]
    columns = np.ascontiguousarray(unit.T)
    for q, query_id, theta in zip(queries, query_ids, thresholds, strict=True):
        length = float(np.sqrt(q @ q))
        chosen = np.flatnonzero(ids != query_id)
        if length > 0 and theta > 0:
            t = theta / (length * norms[0]) * (1 - 1e-9) if norms[0] > 0 else 2.0
            if t > 1:
                continue
            if t >= COORDINATE_FROM:
                keep = ids != query_id
                q_unit = q / length
                for f in np.argsort(-np.abs(q_unit))[:FOCUS]:
                    width = np.sqrt((1 - t * t) * (1 - q_unit[f] * q_unit[f])) + 1e-9
                    if q_unit[f] >= 0:
                        high = 1.0 if q_unit[f] >= t else t * q_unit[f] + width
                        keep &= (columns[f] >= t * q_unit[f] - width) & (columns[f] <= high)
                    else:
                        low = -1.0 if q_unit[f] <= -t else t * q_unit[f] - width
                        keep &= (columns[f] <= t * q_unit[f] + width) & (columns[f] >= low)
                chosen = np.flatnonzero(keep)
            else:
                enough = int(np.searchsorted(-norms, -theta / length * (1 - 1e-9), side="right"))
                chosen = chosen[chosen < enough]
        scores = rows[chosen] @ q
        large = whole and not length * norms[0] < DOUBLE
        if theta > -np.inf:
            reach = scores >= (theta - abs(theta) * 1e-9 - length * norms[0] * 1e-12 if large else theta)
            chosen, scores = chosen[reach], scores[reach]
        if large:
            scores = _whole_scores(rows[chosen], q)
        best = best_rows(scores, ids[chosen], k)
        if len(best):
            yield int(query_id), ids[chosen[best]], scores[best]


def _search(k: int, whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, query_ids = np.asarray(row.ids, np.int64), np.asarray(row.q_ids, np.int64)
                found = search_block(
                    matrix(row.q_vs, len(query_ids)),
                    query_ids,
                    np.asarray(row.q_theta, np.float64),
                    matrix(row.vs, len(ids)),
                    ids,
                    np.asarray(row.norms, np.float64),
                    k,
                    whole,
                )
                for query_id, vec_ids, scores in found:
                    yield pd.DataFrame({"query_id": query_id, "vec_id": vec_ids, "score": scores.astype(np.int64) if whole else scores})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, whole: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score (double; long if ``whole``): the k rows with the highest inner products for each query, exactly.

    ``rows`` and ``queries`` come from ``vectors``. A row with the query's vec_id is no candidate; ties go to the smaller vec_id;
    only vectors of equal length in components are compared; repeated rows count each. Rows are packed into blocks by
    their length, and the blocks with the longest rows give each query a first threshold; then every block is searched with it,
    most of a skewed bucket being skipped. No rows or no queries give no result. If all components are whole numbers (``whole``),
    scores are exact at any size; those beyond a long count as the greatest or least long, and so tie.
    """
    found_schema = f"query_id long, vec_id long, score {'long' if whole else 'double'}"
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * BUCKETS_PER_DOUBLING)).otherwise(F.lit(-(1 << 20)))
    blocks = cut(packed(rows.withColumn("bucket", bucket), ["dim", "bucket"], BLOCK))
    shapes = blocks.select("dim", "bucket", "part", F.array_max("norms").alias("longest"))
    n_blocks = shapes.count()
    seeds = shapes.orderBy(F.desc("longest"), "dim", "bucket", "part").limit(SEED_BLOCKS).drop("longest")
    unbounded = packed(queries.withColumn("theta", F.lit(float("-inf"))), ["dim"], QUERY_BLOCK, ("theta",))
    first = against(unbounded, blocks.join(seeds, ["dim", "bucket", "part"]), SEED_BLOCKS).mapInPandas(_search(k, whole), found_schema)
    kth = ranked(first, k, F.col("score")).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("theta"))
    known = queries.join(kth, F.col("vec_id") == F.col("of"), "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    known = packed(known.drop("of"), ["dim"], QUERY_BLOCK, ("theta",))
    found = against(known, blocks, n_blocks).mapInPandas(_search(k, whole), found_schema)
    return ranked(found, k, F.col("score"))


def whole_component(x):
    """floor(256 * x) as a double: Spark's own floor makes a long, which large components don't fit in; they are whole anyway."""
    return F.when(F.abs(x) < float(1 << 50), F.floor(x * 256).cast("double")).otherwise(x * 256)


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Rows of ``embeddings`` whose id is divisible by 50 against all; see ``vectors`` and ``top_k``."""
    rows = vectors(table(spark, sf_dir, "embeddings"), whole_component)
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), whole=True)


def exact_topk_sql(embeddings: str = "embeddings") -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM {embeddings}
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= {K}"""
