"""Whitening against plain numpy in whole numbers, and odd rows."""

import numpy as np
import pytest

from auditlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, data, more=()):
    return spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(data)] + list(more), SCHEMA).repartition(3)


def plain(data, k):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in data]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    deviation = [sum(c * c for c in v) for v in centred]
    exact = np.array(centred, object)
    covariance = (exact.T.dot(exact)).astype(np.float64) / float(n) ** 3
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return deviation, (exact.astype(np.float64) / n) @ vectors / np.sqrt(values), values / np.trace(covariance)


@pytest.mark.parametrize("dim", [40, 5])
def test_equals_plain_numpy(spark, dim):
    rng = np.random.default_rng(dim)
    data = (rng.standard_normal((300, dim)) * rng.uniform(0.2, 3, dim)).astype(np.float32)
    data[10:30] = data[10]
    k = min(dim, whitening.COMPONENTS)
    got = whitening.whiten(frame(spark, data, [(900, None, 1), (901, [None, 1.0], 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] * dim, 1), (904, [], 1)]))
    rows = got.toPandas().sort_values(["vec_id", "component"])
    assert len(rows) == 300 * k and set(rows.n) == {300}
    deviation, whitened, shares = plain(data, k)
    assert rows.deviation.to_list() == np.repeat(np.array(deviation, object), k).tolist()
    mine = rows.whitened.to_numpy().reshape(300, k)
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.allclose(mine, whitened * signs, atol=1e-9)
    assert np.allclose(rows.explained.to_numpy().reshape(300, k), shares, rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9


def test_rows_without_variance_and_odd_rows(spark):
    same = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3, [(None, [1.0, 2.0], 1), (0, [1.0, 2.0], 1)])).collect()
    assert len(same) == 10 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, 0.0, 0.0, 0.0)}
    assert sorted(str(r.vec_id) for r in same if r.component == 1) == ["0", "0", "1", "2", "None"]
    few = whitening.whiten(frame(spark, [[1.0, 2.0, 3.0], [2.0, 0.0, 1.0]])).collect()
    assert {r.component: round(r.explained, 12) for r in few} == {1: 1.0, 2: 0.0, 3: 0.0} and max(r.identity_error for r in few) < 1e-9
    large = whitening.whiten(frame(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])).collect()
    assert len(large) == 6 and any(r.deviation is None for r in large) and all(np.isfinite(r.whitened) for r in large)
    two = whitening.whiten(frame(spark, [[0.0], [1.0]], [(7, [1.0, 2.0], 1), (8, [2.0, 2.0], 1), (9, [0.5, 0.0], 1)])).collect()
    assert {(r.vec_id, r.n) for r in two} == {(0, 2), (1, 2), (7, 3), (8, 3), (9, 3)}
    none = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_many_rows_stay_exact():
    x, sums = np.array([[1 << 50, 5]]), [3, 1 << 40]
    n = 1 << 30
    centred = whitening._exact(x, n, sums)
    assert centred.tolist() == [[(1 << 80) - 3, 5 * n - (1 << 40)]] and whitening._deviations(centred) == [None]
    assert whitening._deviations(np.array([[3, 4]])) == [25]
