from auditlake.llm.common import drawn, likely_among
from pyspark.sql import functions as F


def test_likely_rows_hold_all_wanted(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit("x").alias("what"))
    wanted = rows.where("id % 50 = 7 or id is null")
    kept = likely_among(rows, wanted, ["id"])
    assert kept.columns == rows.columns
    assert kept.where("id % 50 = 7 or id is null").count() == wanted.count() and kept.count() < 1.01 * wanted.count()
    assert likely_among(rows, wanted.limit(0), ["id"]).count() == 0 and likely_among(rows, wanted, ["id"], bits=0).count() == 20_000


def test_drawn_at_small_rates(spark):
    rows = spark.range(100_000)
    assert 700 < rows.where(drawn(F.xxhash64("id"), 0.01)).count() < 1300 and rows.where(drawn(F.xxhash64("id"), 1.0)).count() == 100_000
    assert rows.where(drawn(F.xxhash64("id"), 1e-12)).count() == 0
