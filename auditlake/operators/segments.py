"""Ordered scans of keys of any size: ranges of rows are scanned by themselves, and what they carry on is combined over the short list of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.sources.shared import shared_folder


class Segments:
    """Rows dealt by ranges of keys and order and written to the shared folder, so that a range is the same whenever it is read. A segment is what a
    range holds of a key: a key with a third of all rows has as many segments as ranges, each scanned by a task of its own. Rows equal in
    keys and order stand in one range, in no set order. Rows with null keys are those of one key.

    The columns ``segment`` and ``of`` (the keys) stand beside the rows until ``plain``.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str | Column]) -> None:
        self.columns, spark = rows.columns, rows.sparkSession
        root = shared_folder(spark)
        spread = rows.repartitionByRange(*keys, *order).select("*", F.spark_partition_id().alias("segment"), F.struct(*keys).alias("of"))
        spread.write.parquet(root)
        self.rows = spark.read.schema(spread.schema).parquet(root)
        self.order = order
        self.near = Window.partitionBy("segment", "of").orderBy(*order)
        self.segments = Window.partitionBy("of").orderBy("segment")  # a row for each segment of a key
        self.earlier = self.segments.rowsBetween(Window.unboundedPreceding, -1)

    def _carried(self, rows: DataFrame, summaries: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        """``rows`` with the columns ``carried``, each a window over the segments' ``summaries``."""
        short = rows.groupBy("segment", "of").agg(*[c.alias(n) for n, c in summaries.items()])
        return rows.join(short.select("segment", "of", *[c.alias(n) for n, c in carried.items()]), ["segment", "of"])

    def _last(self, column: Column) -> Column:
        return F.max_by(F.struct(column.alias("v")), F.struct(*self.order))

    def previous(self, rows: DataFrame, column: Column, name: str) -> DataFrame:
        """The column of the row before, and ``name``_first: whether there is none."""
        local = F.lag(F.struct(column.alias("v"))).over(self.near)
        both = self._carried(rows, {"s__last": self._last(column)}, {"s__before": F.lag("s__last").over(self.segments)})
        found = both.withColumn("s__seen", F.coalesce(local, F.col("s__before")))
        return found.withColumns({name: F.col("s__seen.v"), f"{name}_first": F.col("s__seen").isNull()}).drop("s__seen", "s__before")

    def running(self, rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """Sums over the rows up to each, and ``name``_total: over all rows of the key."""
        whole = Window.partitionBy("of")
        summaries = {f"s__{n}": F.sum(c) for n, c in sums.items()}
        carried = {f"c__{n}": F.coalesce(F.sum(f"s__{n}").over(self.earlier), F.lit(0)) for n in sums} | {f"{n}_total": F.sum(f"s__{n}").over(whole) for n in sums}
        both = self._carried(rows, summaries, carried)
        upto = self.near.rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumns({n: F.sum(c).over(upto) + F.col(f"c__{n}") for n, c in sums.items()}).drop(*[f"c__{n}" for n in sums])

    def running_max(self, rows: DataFrame, column: Column, name: str) -> DataFrame:
        """The greatest so far; null until there is one."""
        both = self._carried(rows, {"s__max": F.max(column)}, {"c__max": F.max("s__max").over(self.earlier)})
        local = F.max(column).over(self.near.rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn(name, F.greatest(local, F.col("c__max"))).drop("c__max")

    def since_reset(self, rows: DataFrame, counted: Column, name: str) -> DataFrame:
        """How many rows in a row, up to each, are counted: a row that isn't starts anew from 0."""
        upto = self.near.rowsBetween(Window.unboundedPreceding, 0)
        n = rows.withColumn("s__sum", F.sum(counted.cast("long")).over(upto))
        n = n.withColumn("s__reset", F.max(F.when(~counted, F.col("s__sum"))).over(upto)).withColumn("s__run", F.col("s__sum") - F.coalesce("s__reset", F.lit(0)))
        short = n.groupBy("segment", "of").agg(self._last(F.col("s__run")).alias("end"), F.max(F.col("s__reset").isNotNull().cast("int")).alias("resets"))
        short = short.withColumn("stretch", F.sum("resets").over(self.segments))
        run = F.sum("end.v").over(Window.partitionBy("of", "stretch").orderBy("segment"))
        short = short.withColumn("run", run).select("segment", "of", F.coalesce(F.lag("run").over(self.segments), F.lit(0)).alias("c__run"))
        both = n.join(short, ["segment", "of"])
        return both.withColumn(name, F.col("s__run") + F.when(F.col("s__reset").isNull(), F.col("c__run")).otherwise(0)).drop("s__sum", "s__reset", "s__run", "c__run")

    def before(self, rows: DataFrame, column: Column, n: int, name: str) -> DataFrame:
        """The n values before each row, in order, as an array. A segment carries its last n on."""
        back = Window.partitionBy("segment", "of").orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in self.order])
        tails = rows.select("segment", "of", F.row_number().over(back).alias("back"), F.struct(column.alias("v")).alias("s")).where(F.col("back") <= n)
        tails = tails.groupBy("segment", "of").agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "s"))).alias("tail"))
        few = F.flatten(F.collect_list("tail").over(self.segments.rowsBetween(-n, -1)))
        tails = tails.select("segment", "of", F.transform(few, lambda t: t["s"]).alias("c__tail"))
        local = F.collect_list(F.struct(column.alias("v"))).over(self.near.rowsBetween(-n, -1))
        joined = F.concat("c__tail", local)
        last = F.slice(joined, F.greatest(F.size(joined) - n, F.lit(0)) + 1, n)
        return rows.join(tails, ["segment", "of"]).withColumn(name, F.transform(last, lambda s: s["v"])).drop("c__tail")

    def plain(self, rows: DataFrame) -> DataFrame:
        return rows.drop("segment", "of")
