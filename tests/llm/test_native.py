"""Mixing and line dedup: against their SQL, and the cases that tables bring."""

import os
import random

from pyspark.sql import functions as F

from auditlake.llm import line_dedup, mixing
from tests.compare import same_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, source string"
LONG = "one two three four five six seven eight nine ten eleven twelve"


def test_mixing_equals_sql(spark):
    same_rows(mixing.op9_mixing(spark, FOLDER), mixing.mixing_sql(), FOLDER)


def test_line_dedup_equals_sql(spark):
    same_rows(line_dedup.op10_line_dedup(spark, FOLDER), line_dedup.line_dedup_sql(), FOLDER)


def test_mixing_odd_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (4, "a " * 5000, None), (None, "q w e", "y")]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(mixing.sizes_of(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
    target = {r.source: r.target for r in out}
    assert abs(sum(target.values()) - 1.5 * 5007) < 1e-6 and all(t <= 2 * s for t, s in ((r.target, r.source_size) for r in out))
    again = mixing.mix(mixing.sizes_of(docs.orderBy(F.desc("doc_id")))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix(mixing.sizes_of(docs.limit(0))).count() == 0


def test_mixing_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, 8)], f"{DOCS}, size int, copy int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and {r["size"] for r in out.collect()} <= {7}


def test_targets_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20.0 and abs(sum(got.values()) - 1530.0) < 1e-9 and got[None] == 20.0


def test_near_lines(spark):
    texts = [
        f"{LONG}\nshort line\n\n  ",
        f"{LONG.replace('six', 'siX')}\nshort  line",  # substitution; equal but for white space
        f"{LONG}s",  # insertion at the end
        LONG[1:],  # deletion at the start
        LONG.replace("two", "tw0").replace("nine", "n1ne"),  # two edits
        "short lines",  # near, but too short for that
        LONG.replace("four five", "fourfive"),  # words joined
        LONG.replace("seven", "eleven"),  # another word in a template
        f"{'a b c d ' * 4000}\n{'x' * 16}\n{'y' * 16}",
        f"{'a b c d ' * 4000}e\n{'x' * 15}z",  # a very long line, and one just long enough
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOCS)
    out = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert out[0] == (4, 0, texts[0])
    assert out[1] == (2, 2, "") and out[2][1] == out[3][1] == out[6][1] == 1
    assert out[4][1] == out[5][1] == out[7][1] == out[8][1] == 0 and out[9] == (2, 1, f"{'a b c d ' * 4000}e")


def test_near_lines_equal_brute_force(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abc ") for _ in range(rng.randrange(14, 60))) for _ in range(20)]
    for line in lines[:20] * 6:
        i = rng.randrange(len(line))
        lines.append(rng.choice([line, line[:i] + "z" + line[i + 1 :], line[:i] + line[i + 1 :], line[:i] + "z" + line[i:], line[:i] + "zz" + line[i:]]))
    rng.shuffle(lines)

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    said = [" ".join(x.split()) for x in lines]
    near = lambda a, b: a == b or (min(len(a), len(b)) >= line_dedup.LEAST_CHARS and abs(len(a) - len(b)) < 2 and apart(a, b) < 2)
    gone = {i for i, x in enumerate(said) if x and any(near(x, y) for y in said[:i])}
    docs = spark.createDataFrame([(i, x, "s") for i, x in enumerate(lines)], DOCS).repartition(3)
    assert {r.doc_id for r in line_dedup.dedup_lines(docs).where("n_removed > 0").collect()} == gone


def test_mixing_does_not_depend_on_chunks(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, "w " * (i % 40), f"s{i % 3}") for i in range(300)], DOCS)
    sizes = mixing.sizes_of(docs)
    few, many = (sorted(map(str, mixing.mix(sizes, chunk_rows=n).collect())) for n in (1000, 1))
    assert few == many


def test_line_dedup_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (2, "a b\na b", "x"), (2, "a b\na b", "x"), (None, "a b", None), (3, "w " * 30000, "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("clash")).withColumn("removed", F.lit(1))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "source", "removed", "text", "n_lines", "n_removed"]
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in out.collect())
    assert got == [("1", 0, 0), ("1", 1, 0), ("2", 2, 2), ("2", 2, 2), ("3", 1, 0), ("None", 1, 0)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_texts_whose_short_hashes_meet_keep_their_own_lines(spark):
    """Two rows without id, told apart by the text alone, of which one loses a line that the other has no copy of."""
    text = lambda i: F.concat(F.lit("own first line of document "), i.cast("string"), F.lit("\nmore of it"))
    made = spark.range(150_000).select(text(F.col("id")).alias("text"))
    meet = made.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("texts")).where(F.size("texts") > 1)
    first, second = meet.orderBy("h").first()["texts"][:2]
    rows = [(None, first, "s"), (None, second, "s"), (None, first.split("\n")[0] + "\nanother end", "s")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS))
    kept = [line for r in out.collect() for line in r.text.split("\n")]
    for line in (first.split("\n")[0], second.split("\n")[0], "another end", "more of it"):
        assert line in kept
    assert kept.count("more of it") == 1
