"""Roll-ups, rankings and projections of findings and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import severity as S
from auditlake.sources.shared import shared_folder

PLAIN_TITLE = "Security Issue"


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """Rows with their number from 1 within the keys. They are dealt by ranges of keys and order and written to the shared folder; each range is
    numbered by itself, after the rows of its keys in the ranges before. So no task sorts all rows of a key, however many it has
    (rows that are equal in the whole order stay together)."""
    spark, root = rows.sparkSession, shared_folder(rows.sparkSession)
    spread = rows.repartitionByRange(*keys, *order) if keys or order else rows
    spread.withColumn("range_no", F.spark_partition_id()).write.parquet(root)
    fixed = spark.read.parquet(root)
    counts = fixed.groupBy("range_no", *keys).agg(F.count("*").alias("range_n"))
    earlier = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    starts = counts.select(F.col("range_no").alias("of_range"), *[F.col(k).alias(f"of_{k}") for k in keys], F.coalesce(F.sum("range_n").over(earlier), F.lit(0)).alias("range_start"))
    near = F.row_number().over(Window.partitionBy("range_no", *keys).orderBy(*order))
    same = F.col("range_no") == F.col("of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    found = fixed.withColumn("range_place", near).join(starts, same).withColumn(name, F.col("range_start") + F.col("range_place"))
    return found.select(*rows.columns, name)


def bucket_counts(findings: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """keys and a count for each bucket (none: 0); one pass, combined before the shuffle."""
    bucket = S.bucket(F.col(severity))
    return findings.groupBy(*keys).agg(*[F.count_if(bucket == b).alias(b) for b in S.BUCKETS])


def severity_rollup(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the count of each bucket, their total and the security score."""
    counts = bucket_counts(findings, keys)
    total = sum((F.col(b) for b in S.BUCKETS), F.lit(0))
    return counts.withColumn("total", total.cast("long")).withColumn("score", S.security_score({b: F.col(b) for b in S.BUCKETS}))


def score_variants(findings: DataFrame, keys: list[str], analysed: Column) -> DataFrame:
    """The three scores that reports give: they weigh findings differently, and one is 0 where nothing was analysed."""
    counts = {b: F.col(b) for b in S.BUCKETS}
    return bucket_counts(findings, keys).select(
        *keys,
        S.security_score(counts, S.POINTS_JSON, analysed).alias("json_score"),
        S.security_score(counts, S.POINTS_DYNAMIC).alias("dynamic_score"),
        S.security_score(counts, S.POINTS_HTML).alias("html_score"),
    )


def severity_shares(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, n and its share of the keys' findings in whole percent, halves to even."""
    counted = findings.groupBy(*keys, S.bucket(F.col("severity")).alias("bucket")).agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy())
    return counted.withColumn("percent", F.bround(share, 0))


def by_title(findings: DataFrame) -> DataFrame:
    """Title (blank: the plain one), count and worst severity; place orders them by severity, count, title."""
    title = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", PLAIN_TITLE).otherwise(F.col("title"))
    grouped = findings.groupBy(title.alias("title")).agg(F.count("*").alias("n"), F.min(S.rank(F.col("severity"))).alias("rank"))
    placed = numbered(grouped, [], ["rank", F.desc("n"), F.lower("title"), "title"])
    name = F.element_at(F.array(*[F.lit(b) for b in S.BUCKETS]), F.col("rank") + 1)
    return placed.select("title", "n", name.alias("severity"), "place")


def finding_ids(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Ids F1, F2, ... in the given order within the keys."""
    return numbered(findings, keys, order, "number").withColumn("finding_id", F.concat(F.lit("F"), F.col("number").cast("string"))).drop("number")


def flattened(findings: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, bucket, item, place of each finding: worst bucket first, by item within it; place counts through."""
    rows = findings.select(*keys, S.bucket(F.col("severity")).alias("bucket"), F.col(item).alias("item"), S.rank(F.col("severity")).alias("worse"))
    return numbered(rows, keys, ["worse", "item"]).drop("worse")


def with_severity(findings: DataFrame, wanted: str | None) -> DataFrame:
    """Findings of one severity in any spelling; None or all: every one."""
    if wanted is None or wanted.strip().lower() == "all":
        return findings
    return findings.where(S.bucket(F.col("severity")) == S.bucket(F.lit(wanted)))


def dashboard_totals(scans: DataFrame) -> DataFrame:
    """One row: scans, completed ones, and sums of their counts (null: 0)."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("vulnerabilities", "critical", "high", "medium", "low")]
    return scans.agg(F.count("*").alias("scans"), F.count_if(F.col("status") == "completed").alias("completed"), *sums)


def scan_search(scans: DataFrame, status: str | None, text: str, columns: list[str]) -> DataFrame:
    """Scans of a status (None: any) that have the text in one of the columns, whatever the case."""
    wanted = F.lit(text.strip().lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted)
    found = scans.where(hit)
    return found if status is None else found.where(F.col("status") == status)


def newest_first(scans: DataFrame, n: int | None = None) -> DataFrame:
    """Scans with an id, newest first; those without a date come last."""
    ordered = scans.where(F.col("id").isNotNull()).orderBy(F.desc_nulls_last("created_at"), "id")
    return ordered if n is None else ordered.limit(n)


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "High").when(confidence >= 0.5, "Medium").when(confidence >= 0.3, "Low").otherwise("Very Low")


def top_per_key(rows: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """The n rows of a key with the highest value, ties by order; place from 1."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def capped_set(rows: DataFrame, keys: list[str], value: str, order: str, n: int) -> DataFrame:
    """The first n distinct values of the keys in order of first appearance, as one array. Distinct values are combined before the
    shuffle and capped by a window, so no large list is ever gathered."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("first"))
    seen = first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("first", value))).where(F.col("n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("n", value)))
    return seen.groupBy(*keys).agg(F.transform(listed, lambda s: s[value]).alias(f"{value}s"))
