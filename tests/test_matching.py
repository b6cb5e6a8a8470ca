"""Patterns out of a table against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import matching


@pytest.mark.parametrize("most", [matching.MOST_CHARS, 1])
def test_equals_containment(spark, most):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    patterns = {word(rng.randrange(1, 14)) for _ in range(300)} | {"abcabcabcabc", "a"}
    texts = [word(rng.randrange(0, 60)) for _ in range(80)] + ["", None, "abc" * 50, "zzz"]
    rows = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "id long, text string").withColumn("pattern", F.lit("clash"))
    table = spark.createDataFrame([(p,) for p in patterns] + [("",), (None,), ("a",)], "pattern string")
    got = matching.contained(rows, "text", table, most=most)
    assert got.columns == [*rows.columns, "found"]
    want = sorted((str(t), sorted((p for p in patterns if t and p in t), key=str.encode)) for t in texts)
    assert sorted((str(r.text), r.found) for r in got.collect()) == want


def test_ten_thousand_indicators(spark):
    rng = random.Random(3)
    patterns = [("".join(rng.choice("abcdef") for _ in range(6)), rng.randrange(1, 9)) for _ in range(10_000)]
    weights = {}
    for p, w in patterns:
        weights[p] = max(w, weights.get(p, 0))
    texts = [(i, "".join(rng.choice("abcdef") for _ in range(400))) for i in range(60)] + [(60, None)]
    out = matching.table_score(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", spark.createDataFrame(patterns, "pattern string, weight int")).collect()
    assert len(out) == 61
    for r in out:
        found = [w for p, w in weights.items() if p in (dict(texts)[r.id] or "")]
        assert (r.hits, r.score) == (len(found), sum(found)) and abs(r.confidence - min(1, sum(found) / sum(weights.values()))) < 1e-12
    none = matching.table_score(spark.createDataFrame(texts, "id long, text string"), ["id"], "text", spark.createDataFrame([], "pattern string, weight int"))
    assert {(r.hits, r.score, r.confidence) for r in none.collect()} == {(0, 0, 0.0)}
