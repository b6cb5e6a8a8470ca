"""Line dedup by a deletion-neighbourhood join (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import SPACE, cut_table, drop_table, likely_among, table

#: Shorter lines (of so few characters in the form that is compared) go only if an earlier line is equal: there, one character
#: tells numbers, letters of a list and marks apart.
LEAST_CHARS = 16
#: Characters of which each is left out in turn; a longer stretch is narrowed down by FAN first.
STRETCH = 24
FAN = 8
#: Lines that make up more than one in so many are looked up in a table of their own, which has at most so many rows.
HOT_LINES = 1000
#: A line that holds none of these has single spaces only.
FOLDED = ("  ", "\t", "\n", "\x0b", "\f", "\r")
_LINE = ["h1", "h2"]


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _normal(line: Column) -> Column:
    """The words of the line with one space between; lines are equal in this form if their words are. Most need no folding."""
    bare = _bare(line)
    folded = F.regexp_replace(bare, f"[{SPACE}]{{2,}}|[\\x09-\\x0D]", " ")
    return F.when(reduce(lambda a, b: a | b, (F.contains(bare, F.lit(c)) for c in FOLDED)), folded).otherwise(bare)


def _docs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: the two first name a document even if ids repeat or are null."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _same_document() -> Column:
    return F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, text_hash, line_no, h1, h2 (hashes that name the line), n (characters), halves of the lines that aren't blank."""
    split = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    lines = docs.select("doc_id", "text_hash", split).where(_bare(F.col("line")) != "")
    lines = lines.select("doc_id", "text_hash", "line_no", _normal(F.col("line")).alias("normal"))
    lines = lines.withColumn("n", F.length("normal"))
    return lines.select(
        "doc_id", "text_hash", "line_no", F.xxhash64("normal").alias("h1"), F.hash("normal").alias("h2"), "n", _halves(least_chars).alias("halves")
    )


def _halves(least_chars: int) -> Column:
    """Keys of which two lines within one edit share one: for s, the characters of the shorter line, its first s/2 or its last
    s - s/2 are in both. A line's partner has as many characters, one less or one more, so s is n - 1 or n."""
    keys = []
    for s in (F.col("n") - 1, F.col("n")):
        h = F.floor(s / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), s, F.left("normal", h)), F.xxhash64(F.lit("last"), s, F.right("normal", s - h))]
    return F.when(F.col("n") >= least_chars, F.array(*keys))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another row has, too."""
    return rows.join(rows.groupBy(key).count().where("count > 1").select(key), key, "left_semi")


def _stretches(halves: DataFrame) -> DataFrame:
    """h1, h2, s, p, q: a partner of the line agrees with it in the first p and the last q characters, s being the shorter's length."""
    s = F.col("n") - 1 + F.floor(F.col("half") / 2).cast("int")
    h = F.floor(s / 2).cast("int")
    first = F.col("half") % 2 == 0
    return halves.select(*_LINE, s.alias("s"), F.when(first, h).otherwise(0).alias("p"), F.when(first, 0).otherwise(s - h).alias("q"))


def _narrowed(wide: DataFrame, texts: DataFrame) -> DataFrame:
    """Stretches, each cut into FAN: those of which the line agrees with another in all but one part."""
    m = F.col("s") - F.col("p") - F.col("q")
    cuts = [F.floor(m * j / FAN).cast("int") for j in range(FAN + 1)]
    parts = F.array(*[F.struct((F.col("p") + a).alias("p"), (F.col("q") + m - b).alias("q")) for a, b in zip(cuts, cuts[1:], strict=False)])
    each = wide.select(*_LINE, "s", F.explode(parts).alias("part")).select(*_LINE, "s", "part.*")
    keyed = each.join(texts, _LINE).select(*_LINE, "s", "p", "q", F.xxhash64("s", "p", "q", F.left("normal", F.col("p")), F.right("normal", F.col("q"))).alias("key"))
    return _shared(keyed, "key").drop("key").distinct()


def _variants(stretches: DataFrame, texts: DataFrame) -> DataFrame:
    """line (at, h1, h2), role, v, w: each line whole and with each character of the stretch left out, hashed.

    Lines of equal length that differ in character i share the variant without i (role 0, i is part of the key); a line of one
    character more shares, without it (role 2), the whole of the other (role 1).
    """
    n, same = F.length("normal"), F.length("normal") == F.col("s")

    def row(role: int, i: Column, said: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(role > 0), i, said).alias("v"), F.hash(F.lit(role > 0), i, said).alias("w"))

    places = F.sequence(F.col("p"), n - F.col("q") - 1)
    without = lambda i: F.concat(F.left("normal", i), F.right("normal", n - i - 1))
    equal = F.concat(F.transform(places, lambda i: row(0, i, without(i))), F.array(row(1, F.lit(-1), F.col("normal"))))
    longer = F.transform(places, lambda i: row(2, F.lit(-1), without(i)))
    rows = stretches.join(texts, _LINE).select(F.struct("at", *_LINE).alias("line"), F.explode(F.when(same, equal).otherwise(longer)).alias("r"))
    return rows.select("line", "r.*").distinct()


def _earlier_partners(variants: DataFrame) -> DataFrame:
    """line, partner: the earliest line that shares a variant, where it is earlier. Of the lines that share one without a character at
    one place any two are one edit apart, so the earliest of them is all that counts."""
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("line")))
    best = variants.groupBy("v", "w").agg(least(0).alias("equal"), least(1).alias("whole"), least(2).alias("longer"), F.count("*").alias("n"))
    found = variants.join(best.where("n > 1").drop("n"), ["v", "w"])
    partner = F.when(F.col("role") == 0, F.col("equal")).when(F.col("role") == 1, F.col("longer")).otherwise(F.col("whole"))
    return found.select("line", partner.alias("partner")).where(F.col("partner.at") < F.col("line.at")).distinct()


def _near(first: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines ``first`` that have an earlier line within one edit."""
    halves = first.select("first", "n", *_LINE, F.posexplode("halves").alias("half", "key"))
    halves = cut_table(_shared(halves, "key").select("first", "n", *_LINE, "half"))
    at = halves.select("first.*", *_LINE).distinct()
    wanted = at.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line_no", *_LINE)).alias("wanted"))
    with_text = likely_among(docs, wanted, ["doc_id", "text_hash"]).alias("a").join(wanted.alias("b"), _same_document()).select("a.*", "wanted").dropDuplicates(["doc_id", "text_hash"])
    lines = with_text.select("doc_id", "text_hash", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("x"))
    place = F.struct("doc_id", "text_hash", "x.line_no").alias("at")
    texts = cut_table(lines.select("x.h1", "x.h2", place, _normal(F.element_at("lines", F.col("x.line_no") + 1)).alias("normal")))

    left = cut_table(_stretches(halves).distinct())
    drop_table(halves)
    wide = F.col("s") - F.col("p") - F.col("q") > STRETCH
    found, old = left.where(~wide), [left]
    while left.where(wide).limit(1).count():  # once for usual lines; a stretch of a million characters takes six rounds
        left = cut_table(_narrowed(left.where(wide), texts))
        found, old = found.unionByName(left.where(~wide)), [*old, left]
    variants = cut_table(_variants(found, texts))
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("normal").alias("normal_a"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("normal").alias("normal_b"))
    pairs = _earlier_partners(variants)
    pairs = pairs.join(a, (F.col("line.h1") == F.col("a1")) & (F.col("line.h2") == F.col("a2")))
    pairs = pairs.join(b, (F.col("partner.h1") == F.col("b1")) & (F.col("partner.h2") == F.col("b2")))
    near = cut_table(pairs.where(F.levenshtein("normal_a", "normal_b", 1) >= 0).select("line.h1", "line.h2").distinct())
    drop_table(texts, variants, *old)
    return near


def removed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, removed (sorted line numbers from 0) of the documents that lose lines."""
    docs = _docs(docs)
    lines = cut_table(_lines(docs, least_chars))
    first = lines.select(F.struct("doc_id", "text_hash", "line_no").alias("at"), *_LINE, "n", "halves").groupBy(*_LINE)
    first = cut_table(first.agg(F.min("at").alias("first"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("halves").alias("halves")))
    near = _near(first, docs)
    fate = first.join(near.withColumn("near", F.lit(True)), _LINE, "left").where("times > 1 or near")
    fate = cut_table(fate.select(*_LINE, "first", "times", F.coalesce("near", F.lit(False)).alias("near")))
    many = max(1, lines.count() // HOT_LINES)
    hot = F.broadcast(fate.where(F.col("times") > many))
    at = lines.select(F.struct("doc_id", "text_hash", "line_no").alias("at"), *_LINE)
    gone = at.join(hot, _LINE).unionByName(at.join(fate.where(F.col("times") <= many), _LINE))
    gone = gone.where(F.col("near") | ~F.col("at").eqNullSafe(F.col("first")))
    removed = cut_table(gone.groupBy("at.doc_id", "at.text_hash").agg(F.array_sort(F.collect_set("at.line_no")).alias("removed")))
    drop_table(lines, first, near, fate)
    return removed


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with text lacking its repeated lines, and n_lines, n_removed (long).

    Lines end at a line feed and are compared by their words, with one space between. Of equal lines the earliest stays, in the order
    of doc_id and then of place; so does, of lines of ``least_chars`` characters or more that are one edit (insertion, deletion or
    substitution of a character) apart, the earlier: a line goes if any earlier line of the corpus, itself kept or not, is that
    near. Blank lines stay. Null text: n_lines 0, text null. Rows with equal id and text are one document and keep the same lines; a
    null id comes before all others. Other columns of ``docs`` are kept unless they are named n_lines or n_removed, which are
    replaced.

    Before any variant is made, lines are kept that share their first or last half with another: with one edit, one half is whole. The
    other half is narrowed down in the same way to a few characters, of which variants are made. So most lines make none, and
    a long line as few as a short one. No pair within a group is ever made.
    """
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    removed = removed_lines(docs, least_chars)
    both = keyed.alias("a").join(removed.alias("b"), _same_document(), "left").select("own", "text", "removed")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    text = F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n")
    return both.withColumn("lines", lines).select(
        "own.*",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(text).alias("text"),
        F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; see ``dedup_lines``."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def line_dedup_sql(documents: str = "documents", least_chars: int = LEAST_CHARS) -> str:
    """DuckDB SQL for op10_line_dedup, with every variant of every line."""
    return f"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (
    SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {documents}
  )
), w AS (
  SELECT doc_id, line_no, line, array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ' ') AS normal FROM l
), f AS (
  SELECT normal, min((doc_id, line_no)) AS first FROM w WHERE normal <> '' GROUP BY normal
), v AS (
  SELECT first, length(normal) AS n, i, hash(left(normal, i - 1) || substr(normal, i + 1)) AS rest
  FROM (SELECT *, unnest(range(1, length(normal) + 1)) AS i FROM f WHERE length(normal) >= {least_chars})
), whole AS (SELECT first, hash(normal) AS rest FROM f WHERE length(normal) >= {least_chars}
), one AS (
  SELECT v.first FROM v JOIN (SELECT n, i, rest, min(first) AS best FROM v GROUP BY ALL) b
    ON v.n = b.n AND v.i = b.i AND v.rest = b.rest WHERE b.best < v.first
  UNION SELECT v.first FROM v JOIN whole f ON v.rest = f.rest WHERE f.first < v.first
  UNION SELECT f.first FROM v JOIN whole f ON v.rest = f.rest WHERE v.first < f.first
), k AS (
  SELECT w.doc_id, w.line_no, w.line,
         w.normal <> '' AND ((w.doc_id, w.line_no) <> f.first OR one.first IS NOT NULL) AS gone
  FROM w LEFT JOIN f USING (normal) LEFT JOIN one ON one.first = f.first
)
SELECT d.doc_id, CAST(coalesce(x.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.gone, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(x.kept, '') END AS text
FROM {documents} d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS gone,
         string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(gone, false)) AS kept
  FROM k GROUP BY doc_id
) x ON x.doc_id = d.doc_id"""
