"""Source lines: search, context of findings, snippets, pages of long files, transcripts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import bundled_path
from auditlake.operators.segments import Segments

AROUND = 4
MOST_MATCHES = 60
PAGE_CHARS = 12_000


def split_lines(text: Column) -> Column:
    """Array of a text's lines, whatever ends them; one character is split at faster than an expression."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no (from 1), line of every file."""
    return files.select(path, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("at", "line")).select(path, (F.col("at") + 1).alias("line_no"), "line")


def usable_pattern(pattern: str) -> str:
    """The pattern, or its literal characters if it is no valid expression."""
    try:
        re.compile(pattern)
        return f"(?i){pattern}"
    except re.error:
        return "(?i)" + re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", pattern)


def grep(files: DataFrame, pattern: str, path: str = "path", scoped: bool = False) -> DataFrame:
    """path, line_no and the first 200 characters of trimmed lines that match, whatever the case. Bundled paths are left out before
    any line is split unless the search is scoped."""
    own = files if scoped else files.where(~bundled_path(F.col(path).cast("string")))
    found = lines(own, path).where(F.col("line").rlike(usable_pattern(pattern)))
    return found.select(path, "line_no", F.left(F.trim("line"), F.lit(200)).alias("line"))


def first_matches(found: DataFrame, path: str = "path", n: int = MOST_MATCHES) -> DataFrame:
    """The first matches by path and line; behind them, once there are n, a row without a path that says so."""
    first = found.orderBy(path, "line_no").limit(n)
    listed = F.array_sort(F.collect_list(F.struct(path, "line_no", "line")))  # n rows at most
    kinds = {f.name: f.dataType for f in found.schema.fields}
    stop = F.struct(F.lit(None).cast(kinds[path]).alias(path), F.lit(None).cast(kinds["line_no"]).alias("line_no"), F.lit(f"... (stopped at {n} matches)").alias("line"))
    whole = first.agg(listed.alias("found"))
    return whole.select(F.inline(F.when(F.size("found") >= n, F.concat("found", F.array(stop))).otherwise(F.col("found"))))


def context(files: DataFrame, spans: DataFrame, key: str, around: int = AROUND) -> DataFrame:
    """Lines around each span (key, s, e): start, end and the lines, clamped to the file; swapped ends are put right. A file meets all its
    spans at once, and is split once."""
    asked = spans.groupBy(key).agg(F.collect_list(F.struct(*spans.columns)).alias("spans"))  # a few numbers for each finding of a file
    pair = asked.join(files.select(key, F.split("text", r"\r\n|\n|\r").alias("all")), key)

    def near(span: Column) -> Column:
        n, low, high = F.size("all"), F.least(span["s"], span["e"]), F.greatest(span["s"], span["e"])
        start = F.greatest(F.lit(1), F.least(low, n) - around)
        end = F.greatest(start, F.least(n, high + around))
        return F.struct(*[span[c].alias(c) for c in spans.columns], start.alias("start_line"), end.alias("end_line"), F.slice("all", start, end - start + 1).alias("lines"))

    return pair.select(F.inline(F.transform("spans", near)))


def anchor(snippet: Column) -> Column:
    """The snippet's first line of six characters or more that is more than a brace, else its first line."""
    own = F.transform(F.split(snippet, r"\r\n|\n|\r"), lambda x: F.trim(x))
    good = F.filter(own, lambda x: (F.length(x) >= 6) & ~x.isin("{", "}", "};", "});"))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.try_element_at(own, F.lit(1)))


def locate(files: DataFrame, snippets: DataFrame, key: str) -> DataFrame:
    """First line of a file that contains the snippet's anchor, and the last line of its span; snippets are (key, snippet). A file meets all
    its snippets at once; only files that have any are split."""
    pair = snippets.select(key, "snippet", anchor(F.col("snippet")).alias("anchor"), F.size(F.split("snippet", r"\r\n|\n|\r")).alias("height")).distinct()
    asked = pair.groupBy(key).agg(F.collect_list(F.struct("snippet", "anchor", "height")).alias("asked"))
    both = asked.join(files.select(key, F.split("text", r"\r\n|\n|\r").alias("all")), key)
    first = lambda a: F.array_position(F.transform("all", lambda line: F.contains(line, a["anchor"])), True).cast("int")
    found = both.select(key, F.inline(F.transform("asked", lambda a: F.struct(a["snippet"].alias("snippet"), first(a).alias("first_line"), a["height"].alias("height")))))
    found = found.where("first_line > 0").groupBy(key, "snippet").agg(F.min("first_line").alias("first_line"), F.max("height").alias("height"))
    return found.select(key, "snippet", "first_line", (F.col("first_line") + F.col("height") - 1).alias("last_line"))


def highlighted(numbered: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Lines with a flag whether they stand in the key's span."""
    return numbered.join(spans, key, "left").withColumn("highlight", F.coalesce(F.col("line_no").between(F.col("s"), F.col("e")), F.lit(False))).drop("s", "e")


def pages(files: DataFrame, key: str, most: int = PAGE_CHARS) -> DataFrame:
    """key, page (from 1), first_line, last_line: whole lines while they fit in ``most`` characters, a line feed each; a page has one
    line at least. Where a page begins depends on all before it, so a file is folded in order; files are independent. Only the lengths
    of lines reach Python, those of a hundred files at once."""

    @F.udf("array<int>", useArrow=False)
    def first_lines(sizes: list[int]) -> list[int]:
        firsts, used = [1], 0
        for n, size in enumerate(sizes, 1):
            if used and used + size + 1 > most:
                firsts.append(n)
                used = 0
            used += size + 1
        return firsts

    sizes = F.transform(split_lines(F.coalesce("text", F.lit(""))), lambda line: F.length(line))
    folded = files.select(key, sizes.alias("sizes")).select(key, F.size("sizes").alias("n"), first_lines("sizes").alias("firsts"))
    ends = F.concat(F.transform(F.slice("firsts", F.lit(2), F.size("firsts")), lambda first: first - 1), F.array("n"))
    page = F.arrays_zip(F.sequence(F.lit(1), F.size("firsts")).alias("page"), F.col("firsts").alias("first_line"), ends.alias("last_line"))
    return folded.select(key, F.inline(page))


def batch_within(rows: DataFrame, keys: list[str], order: str, size: str, most: int, count: int) -> DataFrame:
    """Rows in order until their sizes have reached ``most`` (the one that crosses it stays) or there are ``count``."""
    parts = Segments(rows, keys, [order])
    found = parts.running(parts.rows, {"upto__size": F.col(size), "upto__rows": F.lit(1)})
    before = F.col("upto__size") - F.coalesce(F.col(size), F.lit(0))
    kept = found.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("place", F.col("upto__rows"))
    return parts.plain(kept.where((F.col("before") < most) & (F.col("place") <= count))).drop("upto__size", "upto__rows", "upto__size_total", "upto__rows_total")


def transcript_tail(turns: DataFrame, key: str, order: str, text: str, most: int) -> DataFrame:
    """The last ``most`` characters of a key's turns, a line feed between them; null if none has a text. Turns without a text are none; those
    of one place stand by text, those without a place last. A turn that ends further from the end than that is dropped before the
    turns are gathered, so what is gathered is bounded; one whose line feed alone is within it stays."""
    slim = turns.select(key, F.col(order).isNull().alias("unplaced"), order, text)
    parts = Segments(slim, [key], ["unplaced", order, text])
    found = parts.running(parts.rows, {"upto": F.coalesce(F.length(text) + 1, F.lit(0))})
    near = F.when(F.col(text).isNotNull() & (F.col("upto_total") - F.col("upto") <= most), F.struct("unplaced", order, text))
    listed = F.array_sort(F.collect_list(near))
    joined = found.groupBy(key).agg(F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda s: s[text]), "\n")).alias("joined"))
    return joined.select(key, F.right("joined", F.lit(most)).alias("tail"))
