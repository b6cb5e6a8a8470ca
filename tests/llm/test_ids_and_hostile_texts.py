"""Ids beside null ids, and texts made to take long or to end a task."""

import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from auditlake.llm import html_extract, language_id, near_copies, packing, secrets, toxicity
from auditlake.llm.html_blocks import leaf_blocks

BIG = (1 << 53) + 1


def frame(spark):
    return spark.createDataFrame([(BIG, "some words here"), (None, "other words there")], "doc_id long, text string").coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=str)


def test_ids_stay(spark):
    docs, want = frame(spark), [BIG, None]
    assert ids(secrets.secret_digest(docs)) == want
    assert ids(packing.pack(docs)) == want
    assert ids(near_copies.near_copies(docs)) == want
    assert ids(near_copies.first_copies(docs)) == want
    assert ids(language_id.identify(docs, language_id.Model([], None, None, None))) == want
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert ids(html_extract.extract(pages, html_extract.new_labeller()), "page_id") == want


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 1_000_000, "a" + "\t " * 500_000 + "b", "x" * 1_000_000, "word " * 200_000])
def test_long_texts_are_tokenized(text):
    json_path, ranks_path = packing.vocabulary_path("byte_bpe_50k.json"), packing.vocabulary_path("byte_bpe_50k.tiktoken")
    exact, _, _ = packing._encoders(json_path, ranks_path)
    assert packing.token_ids(text, json_path, ranks_path) == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["-----BEGIN PRIVATE KEY-----\n" * 40_000, "eyJ" * 400_000, "eyJaaaaaaaaaa." * 80_000, "token " * 200_000, "xoxb-123456789-" * 60_000, "token=" + "[" * 10])
def test_secret_scan_takes_time_in_proportion(text):
    began = time.perf_counter()
    secrets.find_secrets(text)
    assert time.perf_counter() - began < 5


def test_unbounded_middles_equal_plain_patterns():
    jwt = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
    key = re.compile(r"-----BEGIN (?:[A-Z]{1,32} )?PRIVATE KEY-----[\sA-Za-z0-9+/=:,-]*?-----END (?:[A-Z]{1,32} )?PRIVATE KEY-----")
    rng = random.Random(2)
    parts = ["eyJ", "eyJabcdefgh", ".", "a" * 16, "!", "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "QUJD\n", " ", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 20)))
        runs, free, found = secrets._Runs(text), 0, []
        for m in re.finditer("eyJ", text):
            if m.start() >= free and (end := runs.jwt(m.start())):
                found.append((m.start(), end))
                free = end
        assert found == [m.span() for m in jwt.finditer(text)]
        assert [s[:2] for s in secrets.find_secrets(text) if s[2] == "private_key"] == [m.span() for m in key.finditer(text)]


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_unclosed_controls_lose_no_text():
    assert texts("<datalist><option value=x></datalist><article><p>main text") == ["main text"]
    assert texts("<button>Go<article><p>main text</p></article>") == ["main text"]
    assert texts("<form><select><option>a<option>b</select><button>Go</button></form><p>x <math><mi>y</mi></math> <svg>z</svg></p>") == ["x y z"]
    assert texts("<object><p>inside</p></object><noscript>no</noscript><template><p>t</p></template>") == ["inside", "no"]
    assert texts("<p>a</p><script>b<p>c") == ["a"]
    began = time.perf_counter()
    for page in ("<button>" * 100_000, "<option>a" * 100_000 + "</option>", "<script></script>" * 100_000, "<select><p>" * 100_000):
        leaf_blocks(page)
    assert time.perf_counter() - began < 20


def split_of(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_query_on_rows(spark, tmp_path):
    rng = random.Random(3)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(40))
    rows = [(i, text("aeioulmn" if i % 2 else "xkzqtbdg"), "aa" if i % 2 else "bb", "s") for i in range(120)]
    rows += [(7, "123", "aa", "s"), (None, text("aeioulmn"), None, "s"), (7, None, "bb", "s"), (8, "", None, None)]
    schema = "doc_id long, text string, lang string, lang_pred string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = language_id.op6_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r.held_out == (r.doc_id is not None and split_of(r.doc_id)) for r in out)
    wanted = {i: lang for i, t, lang, _ in rows[:120]}
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert held and sum(r.lang_pred == wanted[r.doc_id] for r in held) >= 0.95 * len(held)
    assert sum(r.lang_pred == "und" and r.score == 0 for r in out) == 3 and all(0 <= r.score <= 1 for r in out)
    for name, kept in (("empty", "false"), ("one", "lang = 'aa'"), ("none", "lang is null")):
        spark.createDataFrame(rows, schema).where(kept).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        some = language_id.op6_language_id(spark, f"{tmp_path}/{name}").collect()
        assert {r.lang_pred for r in some} <= ({"aa", "und"} if name == "one" else {"und"})


def test_toxicity_query_on_rows(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(30))
    rows = [(i, f"{text()} awful" if i % 2 else text()) for i in range(400)] + [(1, text())] * 50 + [(None, None), (500, "")]
    labels = [(i, 1, i % 2) for i in range(400)] + [(1, 1, 0), (2, 0, None), (None, 0, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.9 * len(held)
    for kept in ("false", "toxic = 0"):
        machine = toxicity.fit(docs, marks.where(kept))
        assert {r.toxicity > 0 for r in toxicity.score_toxicity(docs, machine).collect()} == {True}


def test_pages_take_time_in_proportion_to_their_length():
    """Tags without an end, quotes without a partner, deep and unclosed elements, stray end tags, declarations."""
    import time

    began = time.perf_counter()
    for page in (
        "<a " * 60_000, '<a b="' * 40_000, "<a b='x\" " * 40_000, "<!" * 80_000, "<!-" * 80_000, "<div>x" * 60_000, "<b>" * 40_000 + "<div>x</div>" * 20_000,
        "<div>" * 40_000 + "</p>x" * 40_000, "<li><ul>" + "<div>" * 30_000 + "<li>x" * 30_000, "<p>x" * 60_000, '<a b=" >' * 40_000, "<select><a " * 20_000,
    ):
        leaf_blocks(page)
    assert time.perf_counter() - began < 60
    deep = leaf_blocks("<div class='a b'>x" * 5000)
    assert len(deep) == 5000 and max(len(b.path) for b in deep) <= 96 and deep[-1].path[-3:] == ("div", ".a", ".b")


def test_no_markup_comes_out_as_text():
    pages = {
        '<p title="x>Second part</p><p class="y">Third</p>': ["Second part", "Third"],
        '<img alt="a"b">Two': ["Two"],
        "<p data-x='it's'>Four</p>": ["Four"],
        '<p title="a > b < c" id=z>Five</p>': ["Five"],
        '<a href="/q?a=1&b=2"\n>Six</a> <i x=y=z>seven': ["Six seven"],
        "a < b <p Eight": ["a < b"],
        "<p>Nine<span class=": ["Nine"],
        '<input value=">" disabled>Ten': ["Ten"],
        "<p\n>Eleven</p\n>": ["Eleven"],
    }
    for page, want in pages.items():
        assert [b.text for b in leaf_blocks(page)] == want


def test_a_large_page_is_not_padded_against_small_ones():
    import tracemalloc

    from auditlake.llm import html_extract

    model = html_extract.new_labeller(1)
    pages = [leaf_blocks("<p>some words</p>" * 20_000)] + [leaf_blocks("<p>few words</p>")] * 255
    tracemalloc.start()
    found = html_extract.label(model, pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(f) for f in found[:2]] == [20_000, 1] and peak < 400 << 20
