"""Embedding whitening: the covariance of exactly centred rows as a Gramian of RowMatrix, a local eigendecomposition of it, and a
projection of every row."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut_table, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries are held within plus or minus so much, so that each is a whole double and sums of them are exact.
MOST = 1 << 50
#: A component whose share of the trace is at most this has no variance but what rounding makes.
NO_VARIANCE = 1e-12
_LONG = 1 << 63


class Fit(NamedTuple):
    """What a whitening needs: rows, sums by dimension, and by component the unit vector, the eigenvalue and its share of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    shares: np.ndarray

    def has_variance(self) -> np.ndarray:
        return self.shares > NO_VARIANCE


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x (array<long>): floor(64 * c) + 1000000 of each entry c as a double, of the rows whose vector is not null, not empty
    and has neither null nor non-finite entries."""
    c = F.col("embedding")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = rows.select("vec_id", "embedding").where(c.isNotNull() & (F.size(c) > 0) & finite)
    held = lambda e: F.greatest(F.least(e.cast("double") * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))
    return good.select("vec_id", F.transform(c, lambda e: F.floor(held(e)).cast("long") + SHIFT).alias("x"))


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding: as longs where these suffice, else as Python's numbers of any size."""
    if n * (2 * MOST + SHIFT) < _LONG or 2 * n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < _LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares by row; none where they pass a long."""
    most = int(np.abs(centred).max(initial=0))
    if centred.dtype != object and centred.shape[1] * most * most < _LONG:
        return [int(d) for d in (centred * centred).sum(axis=1)]
    exact = (centred.astype(object) ** 2).sum(axis=1)
    return [int(d) if d < _LONG else None for d in exact]


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in x])


def _covariance(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """The Gramian of a column of centred rows (array<double>), divided by n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def _centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                centred = (_exact(_matrix(batch["x"]), n, sums) / n).astype(np.float64)
                yield pd.DataFrame({"centred": list(centred)})

    return rows.select("x").mapInPandas(run, "centred array<double>")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Learn from all ``rows`` (x: arrays of one length); None if there are none. What comes to the driver are the sums and the
    covariance, whose size follows from the vectors' length."""
    at = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = at.orderBy("at").collect()
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    values, vectors = np.linalg.eigh(_covariance(_centred(rows, n, sums), "centred", n))
    falling = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[falling], 0.0), vectors[:, falling]
    total = values.sum()
    shares = values / total if total > 0 else np.zeros_like(values)
    return Fit(n, sums, vectors[:, :components], values[:components], shares[:components])


def whitened_rows(rows: DataFrame, model: Fit) -> DataFrame:
    """vec_id, deviation, whitened (array<double>) of every row of ``rows``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((model.n, model.sums, model.axes / np.sqrt(np.where(model.has_variance(), model.variances, np.inf))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, axes = sent.value
        for batch in batches:
            if len(batch):
                centred = _exact(_matrix(batch["x"]), n, sums)
                yield pd.DataFrame(
                    {
                        "vec_id": batch["vec_id"],
                        "deviation": pd.array(_deviations(centred), dtype="Int64"),
                        "whitened": list((centred / n).astype(np.float64) @ axes),
                    }
                )

    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x")
    out = named.mapInPandas(run, "vec_id string, deviation long, whitened array<double>")
    return out.withColumn("vec_id", F.col("vec_id").cast(rows.schema["vec_id"].dataType))


def identity_error(whitened: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, over the components that have variance."""
    kept = int(model.has_variance().sum())
    if not kept:
        return 0.0
    entries = whitened.select(F.posexplode(F.slice("whitened", 1, kept)).alias("at", "w"))
    means = [r["m"] for r in entries.groupBy("at").agg(F.avg("w").alias("m")).orderBy("at").collect()]
    mean = F.array(*[F.lit(m) for m in means])
    centred = whitened.select(F.zip_with(F.slice("whitened", 1, kept), mean, lambda w, m: w - m).alias("centred"))
    return float(np.abs(_covariance(centred, "centred", model.n) - np.eye(kept)).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row of ``rows`` (vec_id, embedding; other columns
    are left out) and each of its first components.

    Vectors that are null, empty, or hold a null or non-finite entry take no part. Vectors of each length are a fit list of their own,
    with its own n, covariance and identity_error; lengths are looped over by the driver. A repeated vec_id, or none, is a row like others.
    Entries beyond 2 ** 50 after scaling count as that number. A deviation that passes a long is null. A component without variance, as
    where all rows are equal or are fewer than dimensions, has whitened 0 and is left out of identity_error. Without rows the
    result has none.
    """
    vectors = whole_vectors(rows)
    lengths = [r["dim"] for r in vectors.select(F.size("x").alias("dim")).distinct().orderBy("dim").collect()]
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    result = rows.sparkSession.createDataFrame([], schema)
    for dim in lengths:
        own = vectors.where(F.size("x") == dim) if len(lengths) > 1 else vectors
        model = fit(own, components)
        done = cut_table(whitened_rows(own, model))
        error = identity_error(done, model)
        shares = F.array(*[F.lit(float(s)) for s in model.shares])
        each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        part = each.select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(shares, F.col("at") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
        result = part if len(lengths) == 1 else result.unionByName(part)
    return result


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` on its first 32 components; see ``whiten``."""
    return whiten(table(spark, sf_dir, "embeddings"))
