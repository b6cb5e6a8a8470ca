"""Many literal patterns in texts: an automaton made from the rows of a table, or, where that would be too large to send, a join of substrings."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from auditlake.sources.shared import shared_folder

#: Characters of all patterns together up to which they are sent to every task; their automaton takes some hundred bytes for each.
MOST_CHARS = 4 << 20
#: Characters at the start of a pattern that it is looked up by in the join.
ANCHOR = 8


class _Automaton:
    """The patterns as they are sent; a worker builds their automaton once, when the first batch comes."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns, self.built = patterns, None

    def __getstate__(self) -> list[str]:
        return self.patterns

    def __setstate__(self, patterns: list[str]) -> None:
        self.__init__(patterns)

    def found(self, text: str | None) -> list[str]:
        if text is None or not self.patterns:
            return []
        if self.built is None:
            self.built = ahocorasick.Automaton()
            for p in self.patterns:
                self.built.add_word(p, p)
            self.built.make_automaton()
        return sorted({p for _, p in self.built.iter(text)}, key=lambda p: p.encode("utf-8", "surrogatepass"))


def _by_automaton(texts: DataFrame, text: str, patterns: list[str], name: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(_Automaton(patterns))

    @F.pandas_udf(ArrayType(StringType()))
    def found(said: pd.Series) -> pd.Series:
        return said.map(sent.value.found)

    return texts.withColumn(name, found(F.col(text)))


def _by_join(texts: DataFrame, text: str, patterns: DataFrame, longest: int, name: str) -> DataFrame:
    """Every place of a text, with as many characters as the longest pattern has, meets the patterns that start as it does. Texts are written
    with a number first, which they are put together by again."""
    spark, root = texts.sparkSession, shared_folder(texts.sparkSession)
    texts.withColumn("text__no", F.monotonically_increasing_id()).write.parquet(root)
    numbered = spark.read.parquet(root)
    lengths = F.least(F.length("pattern"), F.lit(ANCHOR))
    anchored = patterns.select("pattern", lengths.alias("n"), F.left("pattern", lengths).alias("anchor"))
    sizes = [r["n"] for r in anchored.select("n").distinct().collect()]  # eight at most
    places = numbered.where(F.length(text) > 0).select("text__no", text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("at"))
    pieces = places.select("text__no", F.substring(F.col(text), F.col("at"), F.lit(longest)).alias("piece")).distinct()
    keyed = pieces.select("text__no", "piece", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    keyed = keyed.where(F.length("piece") >= F.col("n")).withColumn("anchor", F.left("piece", F.col("n")))
    hits = keyed.join(anchored, ["n", "anchor"]).where(F.startswith("piece", F.col("pattern"))).select("text__no", "pattern").distinct()
    listed = hits.groupBy("text__no").agg(F.array_sort(F.collect_list("pattern")).alias(name))
    none = F.array().cast("array<string>")
    return numbered.join(listed, "text__no", "left").select(*texts.columns, F.coalesce(name, none).alias(name))


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern", name: str = "found", most: int = MOST_CHARS) -> DataFrame:
    """``texts`` with an array of the distinct patterns (rows of a table) that their text contains, in order of code points.

    Every text is read once, however many the patterns are. Their number and size are looked at before they are sent: up to ``most``
    characters they become an automaton in each worker, beyond that texts and patterns are joined by substrings. Null and
    empty patterns are in no text, null texts contain none.
    """
    known = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("chars"), F.max(F.length("pattern")).alias("longest")).first()
    if size["chars"] > most:
        return _by_join(texts, text, known, size["longest"], name)
    return _by_automaton(texts, text, [r["pattern"] for r in known.collect()], name)


def table_hits(entries: DataFrame, app: str, entry: str, indicators: DataFrame) -> DataFrame:
    """app, ord, framework, n (distinct patterns) of every framework of a table of indicators (ord, framework, pattern) found in the entries."""
    each = contained(entries.select(app, entry).distinct(), entry, indicators).select(app, F.explode("found").alias("pattern")).distinct()
    return each.join(indicators.select("ord", "framework", "pattern").distinct(), "pattern").groupBy(app, "ord", "framework").agg(F.count("*").alias("n"))


def table_score(texts: DataFrame, keys: list[str], text: str, indicators: DataFrame) -> DataFrame:
    """keys, hits, score (sum of the weights of the patterns that a text contains) and confidence (its share of all weights) for a table of
    indicators (pattern, weight), of which each pattern counts once, with its greatest weight. The keys name a text."""
    weights = indicators.where("pattern <> ''").groupBy("pattern").agg(F.max("weight").alias("weight"))
    total = weights.agg(F.sum("weight").alias("total"))
    each = contained(texts.select(*keys, text), text, weights).select(*keys, F.explode_outer("found").alias("pattern"))
    scored = each.join(weights, "pattern", "left").groupBy(*keys).agg(F.count("pattern").alias("hits"), F.coalesce(F.sum("weight"), F.lit(0)).alias("score"))
    share: Column = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("score") / F.col("total"))).otherwise(0.0)
    return scored.crossJoin(F.broadcast(total)).select(*keys, "hits", "score", share.alias("confidence"))  # one row
