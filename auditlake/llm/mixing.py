"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import count_words, cut_table, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents that are ranked together in a task, about.
CHUNK_ROWS = 50_000


def _same_source(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: each source's words in the mix.

    Sources by code point, null last, weigh ``weights`` in turn and divide ``share`` times all words; a target stops at
    ``most`` times its source's size and the excess is divided anew by weight. That has a closed form: sources fill up in the
    order of cap/weight, so one pass of running sums over the list of sources (not documents) finds the level at which the
    rest share by weight. Without words all targets are 0. The sources' list, a row each, is sorted in one task.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, from_here = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    named = named.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(from_here),
    )
    # The level is that of the first source that stays under its cap when all before it are full.
    full = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.min(F.when(~full, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return named.select("source", "source_size", target.alias("target"))


def _size_class() -> Column:
    """Number of digits and the two leading digits of the size, as one integer."""
    digits = F.length(F.col("size").cast("string"))
    return (digits * 100 + F.substring(F.col("size").cast("string"), 1, 2).cast("int")).cast("int")


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    chunk_rows: int = CHUNK_ROWS,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken and any further columns of ``docs`` (by default just the key).

    ``docs`` has doc_id, source and size, and may have mark, a string that tells documents apart (by default, the id). Every document
    of a source expects target/source_size copies. Documents stand in a fixed order (size class, md5 of the mark, size, id);
    expected copies are summed along it, a random offset per source (from ``seed`` and the source's name, so reruns agree) is
    added, and a document is emitted once per integer crossed. As neighbours are of like size, words taken come near the target.

    The order is never sorted in one task: ranks are counted in chunks of (source, size class, first digits of the md5), with as many
    digits as keep the largest near ``chunk_rows``, and a chunk's start comes from running sums over the chunk counts. The order
    and so the result don't depend on the chunks. Repeated rows are documents of their own; null and empty texts have size 0 and are
    taken for 0 words; null ids need a mark to be dealt out; no rows give none.
    """
    mark = F.coalesce(F.col("mark" if "mark" in docs.columns else "doc_id").cast("string"), F.lit(""))
    keyed = docs.withColumns({"size_class": _size_class(), "mark": F.md5(mark.cast("binary"))})
    largest = keyed.groupBy("source", "size_class").count().agg(F.max("count")).first()[0] or 1
    keyed = keyed.withColumn("salt", F.left("mark", F.lit(max(0, ceil(log(largest / chunk_rows, 16))))))
    chunk = ["source", "size_class", "salt"]
    counts = keyed.groupBy(*chunk).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    starts = counts.select(
        *[F.col(c).alias(f"of_{c}") for c in chunk],
        (F.sum("n").over(Window.partitionBy("source").orderBy("size_class", "salt")) - F.col("n")).alias("start"),
    )
    targets = source_targets(counts, weights, share, most).withColumnRenamed("source", "to_source")
    starts = starts.join(targets, _same_source("of_source", "to_source"))
    ranked = keyed.withColumn("place", F.row_number().over(Window.partitionBy(*chunk).orderBy("mark", "size", "doc_id")))
    ranked = ranked.join(
        starts,
        _same_source("source", "of_source") & (F.col("size_class") == F.col("of_size_class")) & (F.col("salt") == F.col("of_salt")),
    )
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).cast("binary"))
    offset = F.conv(F.substring(name, 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("start") + F.col("place")).cast("double")
    crossed = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    copies = F.least(crossed, F.ceil(rate)).cast("long")
    return (
        ranked.withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("size_class", "mark", "salt", "place", "start", "of_source", "of_size_class", "of_salt", "to_source")
    )


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), mark (the id; without one, the text's hash)."""
    return docs.select("doc_id", "source", count_words("text").alias("size"), _mark())


def _mark() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).alias("mark")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, a row for each copy taken."""
    own = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in own])
    taken = mix(docs.select("doc_id", "source", count_words("text").alias("size"), _mark(), row.alias("row")))
    copies = taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; see ``mix``. Repeated ids are documents of their own."""
    sizes = cut_table(sizes_of(table(spark, sf_dir, "documents")))  # words are counted once, not for each use of the sizes
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(documents: str = "documents") -> str:
    """DuckDB SQL for op9_mixing; the same order, offset and closed form."""
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(text) AS hash FROM {documents}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight
  FROM d GROUP BY source
), c AS (SELECT *, source_size * 2.0 AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), m AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap > level * weight
), t AS (
  SELECT source, source_size, least(cap, coalesce(m.level * weight, cap)) AS target,
         CAST('0x' || substr(md5('mix:' || coalesce('=' || source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM c, m
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY length(d.size::VARCHAR) * 100 + CAST(substr(d.size::VARCHAR, 1, 2) AS INTEGER),
              md5(coalesce(d.doc_id::VARCHAR, d.hash, '')), d.size, d.doc_id) AS DOUBLE) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rank * rate + shift) - floor((rank - 1) * rate + shift), ceil(rate)) AS BIGINT) * size AS taken
FROM r"""
