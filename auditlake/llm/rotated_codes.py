"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut, table
from auditlake.llm.vector_blocks import against, best_rows, matrix, packed, ranked, vectors

K = 20
BLOCK = 8192
QUERY_BLOCK = 512
QUERY_BITS = 4
#: Width of the bounds in standard deviations of the estimate; wider finds more and reranks more.
EPSILON = 1.9
_FOUND = "query_id long, vec_id long, score double"


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 17) -> np.ndarray:
    """A random orthogonal matrix from dim components to the next multiple of 64."""
    wide = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes (a bit for each rotated component) and each unit row's product with its code's unit vector."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    turned = (rows / norms[:, None]) @ rotation(rows.shape[1])
    return _pack(turned > 0), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, same in batch.groupby("dim"):
            codes, fit = encode(np.stack(same["v"].to_list()))
            yield same.assign(code=list(codes.view(np.int64)), fit=fit)


def build_index(rows: DataFrame) -> DataFrame:
    """``rows`` (from ``vectors``; zero vectors have no direction and take no part) with code (array<long>) and fit, the correction
    scalar. Every row is indexed by itself: nothing is fitted, and new rows can be added."""
    return rows.where("norm > 0").mapInPandas(
        _index, "vec_id long, v array<double>, dim int, norm double, code array<long>, fit double"
    )


def search_block(
    queries: np.ndarray,
    query_ids: np.ndarray,
    rows: np.ndarray,
    ids: np.ndarray,
    norms: np.ndarray,
    codes: np.ndarray,
    fit: np.ndarray,
    k: int,
    epsilon: float = EPSILON,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, exact scores) of the k best rows whose bounds allow it.

    With b a row's code and o its unit vector, <b, q> / fit estimates <o, q> for a unit query, within
    epsilon sqrt((1 - fit^2) / fit^2 / (D - 1)) nearly always. The query's rotated components are rounded to 4 bits, so
    that <b, q> is a sum of four population counts. The k-th highest lower bound is a threshold, and rows whose upper bound
    reaches it are reranked with exact products.
    """
    turned = queries @ rotation(rows.shape[1])
    wide = turned.shape[1]
    ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
    error = epsilon * np.sqrt(np.maximum(1 - fit * fit, 0) / (fit * fit) / max(1, wide - 1)) * norms
    factor = norms / fit / np.sqrt(wide)
    for q, t, query_id in zip(queries, turned, query_ids, strict=True):
        length = float(np.sqrt(t @ t))
        low = float(t.min())
        step = (float(t.max()) - low) / ((1 << QUERY_BITS) - 1) or 1.0
        levels = np.rint((t - low) / step).astype(np.uint8)
        planes = _pack(np.stack([(levels >> j) & 1 for j in range(QUERY_BITS)]).astype(bool))
        counts = np.zeros(len(ids))
        for j in range(QUERY_BITS):
            counts += np.bitwise_count(codes & planes[j]).sum(axis=1) * float(1 << j)
        estimate = (2 * (low * ones + step * counts) - float(levels.sum() * step + low * wide)) * factor
        slack = error * length
        mine = ids != query_id
        lower = np.where(mine, estimate - slack, -np.inf)
        floor = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) > k else -np.inf
        chosen = np.flatnonzero(mine & (estimate + slack >= floor))
        scores = (rows[chosen] * q).sum(axis=1)
        best = best_rows(scores, ids[chosen], k)
        yield int(query_id), ids[chosen[best]], scores[best]


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, query_ids = np.asarray(row.ids, np.int64), np.asarray(row.q_ids, np.int64)
                found = search_block(
                    matrix(row.q_vs, len(query_ids)),
                    query_ids,
                    matrix(row.vs, len(ids)),
                    ids,
                    np.asarray(row.norms, np.float64),
                    np.stack([np.asarray(c, np.int64) for c in row.code]).view(np.uint64),
                    np.asarray(row.fit, np.float64),
                    k,
                )
                out = [pd.DataFrame({"query_id": q, "vec_id": v, "score": s}) for q, v, s in found]
                yield pd.concat(out, ignore_index=True)

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score (double, the exact inner product): nearly always the k best rows of each query.

    ``index`` comes from ``build_index`` and ``queries`` from ``vectors``. A row with the query's vec_id is no candidate; ties go to
    the smaller vec_id; only vectors of equal length in components are compared. Zero queries take no part. Every code is looked
    at, in blocks; each block sends k rows a query. No rows or no queries give no result.
    """
    blocks = cut(packed(index, ["dim"], BLOCK, ("code", "fit")))
    asked = packed(queries.where("norm > 0"), ["dim"], QUERY_BLOCK)
    found = against(asked, blocks, blocks.count()).mapInPandas(_search(k), _FOUND)
    return ranked(found, k, F.col("score"))


def op4_rotated_codes(spark, sf_dir: str) -> DataFrame:
    """Rows of ``embeddings`` whose id is divisible by 20 against all; see ``nearest``."""
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return nearest(build_index(rows), rows.where(F.col("vec_id") % 20 == 0))
