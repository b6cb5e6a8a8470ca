import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import exact_topk, rotated_codes
from auditlake.llm.vector_blocks import vectors


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((700, 48)) * rng.uniform(0.2, 2, (700, 1))).astype(np.float32)
    data[100:140] = data[100]  # one vector many times
    data[5] = 0
    return data


def frame(spark, data):
    bad = [(900, None), (901, [None, 1.0]), (902, [float("nan")] * 48), (903, [float("inf")] * 48), (904, []), (905, [1.0, 2.0])]
    all_rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + bad
    return spark.createDataFrame(all_rows, "vec_id long, embedding array<float>")


def test_exact(spark, rows):
    data = vectors(frame(spark, rows), lambda x: F.floor(x * 256).cast("double"))
    got = exact_topk.top_k(data, data.where("vec_id % 50 = 0")).collect()
    whole = np.floor(rows.astype(np.float64) * 256)
    want = []
    for q in range(0, 700, 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:5]
        want += [(q, r + 1, i, scores[i]) for r, i in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_few_rows_and_none(spark, rows):
    data = vectors(frame(spark, rows[:3]))
    assert exact_topk.top_k(data, data.where("vec_id = 0")).count() == 2
    none = data.where("vec_id < 0")
    assert exact_topk.top_k(none, none).count() == 0
    assert rotated_codes.nearest(rotated_codes.build_index(none), none).count() == 0


def test_codes_recall_and_scores(spark, rows):
    data = vectors(frame(spark, rows))
    got = rotated_codes.nearest(rotated_codes.build_index(data), data.where("vec_id % 20 = 0")).collect()
    exact, hits, total = rows.astype(np.float64), 0, 0
    for q in range(0, 700, 20):
        mine = [r for r in got if r.query_id == q]
        scores = exact @ exact[q]
        best = [i for i in np.lexsort((np.arange(700), -scores)) if i not in (q, 5)][:20]
        hits, total = hits + len({r.vec_id for r in mine} & set(best)), total + 20
        assert all(abs(r.score - scores[r.vec_id]) < 1e-9 for r in mine) and [r.rank for r in sorted(mine, key=lambda r: r.rank)] == list(range(1, 21))
    assert hits / total >= 0.9


def test_exact_scores_of_any_size(spark):
    """Components whose products doubles can't hold, next to small ones; scores beyond a long tie."""
    rng = np.random.default_rng(8)
    data = rng.integers(-9, 9, (60, 4)).astype(np.float64)
    data[10:20] *= 2.0**40
    data[20:30] = data[20:30] * 2.0**26 + rng.integers(-3, 3, (10, 4)) * 2.0**20
    data[30] = [3e38, -3e38, 1e30, 0]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    whole = vectors(rows, exact_topk.whole_component)
    got = [tuple(r) for r in exact_topk.top_k(whole, whole, whole=True).collect()]
    x = [[int(float(np.float32(c)) * 256) for c in v] for v in data]
    want = []
    for q in range(60):
        scores = sorted((-min(max(sum(a * b for a, b in zip(x[q], x[c], strict=True)), -exact_topk.LONG), exact_topk.LONG), c) for c in range(60) if c != q)
        want += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:5], 1)]
    assert sorted(got) == sorted(want)


def test_repeated_ids_are_rows_like_others(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 1.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    whole = vectors(rows, exact_topk.whole_component)
    found = [tuple(r)[1:] for r in exact_topk.top_k(whole, whole.where("vec_id = 7"), whole=True).collect()]
    assert found == [(1, 0, 65536), (2, 0, 0), (3, 5, 0), (4, 5, 0)]
