import re

import pytest
from pyspark.sql import functions as F

from auditlake.functions import severity as S
from auditlake.functions import text as T


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string").select("i", column(F.col("v")).alias("out"))
    return [r["out"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("vector", "score", "band"),
    [
        ("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8, "Critical"),
        ("AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0, "Critical"),
        ("AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 7.8, "High"),
        ("AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N", 6.2, "Medium"),
        ("CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1, "Medium"),
        ("A:N/AV:N/AC:H/PR:L/UI:N/S:U/C:L/I:N", 3.1, "Low"),
        ("av:p/ac:h/pr:h/ui:n/s:u/c:l/i:n/a:n/E:P", 1.6, "Low"),
        ("AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0, "Informational"),
        ("AV:N/AC:L", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_cvss(spark, vector, score, band):
    rows = S.with_cvss_score(spark.createDataFrame([(vector,)], "vector string"))
    assert tuple(rows.select("score", S.cvss_band(F.col("score"))).first()) == (score, band)


def test_a_vector_is_read_once(spark):
    rows = S.with_cvss_score(spark.createDataFrame([("AV:N",)], "vector string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1


def test_last_valid_metric_wins(spark):
    assert values(spark, lambda v: S.cvss_metric(v, "AC"), ["AC:L/AC:H/AC:X", "ac : l / C:N", "XAC:L", None]) == ["H", "L", None, None]


def test_words(spark):
    assert values(spark, S.word_severity, ["critical!", "Info", "weird", "", None]) == ["Critical", "Informational", "Medium", "Medium", "Medium"]
    assert values(spark, S.bucket, [" High ", "Informational", None]) == ["high", "info", "info"]


def test_spans_and_durations(spark):
    spans = values(spark, T.line_span, ["8", "6-7", "lines 9 to 6", "application tag"])
    assert [s and (s["s"], s["e"]) for s in spans] == [(8, 8), (6, 7), (6, 9), None]
    assert values(spark, lambda v: T.duration(v.cast("double")), ["-1", "0.25", "59.5", "3661"]) == ["0s", "250.0ms", "59.5s", "1h 1m 1s"]


def test_scores(spark):
    counts = dict(zip(S.BUCKETS, (F.lit(n) for n in (1, 2, 0, 0, 1)), strict=True))
    row = spark.range(1).select(
        S.security_score(counts, S.POINTS_JSON, F.lit(True)).alias("json"),
        S.security_score(counts, S.POINTS_JSON, F.lit(False)).alias("none"),
        S.security_score(counts, S.POINTS_HTML).alias("html"),
    )
    assert tuple(row.first()) == (59.5, 0.0, 55.0)


def test_paths_and_text(spark):
    assert values(spark, T.source_path, ["La/b/Foo$Bar;"]) == ["sources/a/b/Foo.java"]
    assert values(spark, T.normal_path, ["..foo", "./a/b", "a\\b"]) == ["foo", "a/b", "a/b"]
    assert values(spark, T.without_thinking, ["<think>x</think> a", "draft </think> b", "c"]) == ["a", "b", "c"]
    assert values(spark, T.safe_file_name, ['a<b>.txt ', "...", None]) == ["a_b_.txt", "unknown", "unknown"]
    assert values(spark, T.html_escaped, ["<a & 'b'>", None]) == ["&lt;a &amp; &#x27;b&#x27;&gt;", ""]
    assert values(spark, T.user_defined, ["abc_x", "main", " ", "app_name", "12", "deadbeef00"]) == [False, False, False, True, False, False]
    assert values(spark, T.bundled_path, ["res/values-de/a.xml", "sources/androidx/A.java", "res/values/strings.xml"]) == [True, True, False]


def test_all_scores_by_formula(spark):
    """Every combination against the specification's formula written out again, in the usual order and turned round."""
    from itertools import product

    def formula(av, ac, pr, ui, s, c, i, a):
        w = S.CVSS_WEIGHTS
        iss = 1 - (1 - w["C"][c]) * (1 - w["I"][i]) * (1 - w["A"][a])
        impact = 6.42 * iss if s == "U" else 7.52 * (iss - 0.029) - 3.25 * (iss - 0.02) ** 15
        reach = 8.22 * w["AV"][av] * w["AC"][ac] * ({"N": 0.85, "L": 0.62, "H": 0.27} if s == "U" else {"N": 0.85, "L": 0.68, "H": 0.5})[pr] * w["UI"][ui]
        total = 0 if impact <= 0 else min(10, impact + reach) if s == "U" else min(10, 1.08 * (impact + reach))
        return -(-round(total * 100000) // 10000) / 10

    every = list(product("NALP", "LH", "NLH", "NR", "UC", "NLH", "NLH", "NLH"))
    metrics = [[f"{m}:{v}" for m, v in zip(("AV", "AC", "PR", "UI", "S", "C", "I", "A"), c, strict=True)] for c in every]
    rows = [(i, "/".join(m)) for i, m in enumerate(metrics)] + [(i, "AV:X/ " + " / ".join(m[::-1]).lower()) for i, m in enumerate(metrics)]
    scored = S.with_cvss_score(spark.createDataFrame(rows, "i int, vector string")).collect()
    assert len(scored) == 2 * 2592 and all(r.score == formula(*every[r.i]) for r in scored)


def test_titles_need_the_start_alone(spark):
    words = "word " * 200
    said = [None, " ", "One. Two.", f"{words}. End.", "a" * 79 + ". b", "a" * 80 + ". b", "x\n\n" * 300, " " * 500 + "Late start. Then", "y" * 395 + " " * 300 + "z. w", "Short.", " no. dot"]

    def title(text):
        folded = re.sub(r"[ \t\n\x0b\f\r]+", " ", text or "").strip(" ")
        first = re.match(r"(.*?[.!?])\s", folded)
        head = first[1] if first else folded
        return "Security Issue" if not folded else head if len(head) <= 80 else head[:77].rstrip() + "..."

    assert values(spark, T.derived_title, said) == [title(t) for t in said]


def test_halves_are_even_once_scaled(spark):
    assert values(spark, lambda v: T.duration(v.cast("double")), ["0.25545", "-0.0", "0.00035", "2.25"]) == ["255.4ms", "-0.0ms", "0.4ms", "2.2s"]
    assert values(spark, lambda v: T.client_size(v.cast("long")), ["1126", "1152", None]) == ["1.1 KB", "1.1 KB", "—"]
