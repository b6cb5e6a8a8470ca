"""Marked lines, symbol listings and merged settings."""

import html
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.operators import highlight, payloads, symbols


def plain(said):
    return html.unescape(re.sub(r"</?span[^>]*>", "", said))


def classes(said):
    return re.findall(r'class="tok-(\w+)">([^<]*)<', said)


def test_marks():
    said, state = highlight.marked_line('@Override public int f(long x) { return "a\\"b" + 0x1F; } // done', "p", "code")
    assert state == "p" and classes(said) == [
        ("fn", "@Override"), ("kw", "public"), ("kw", "int"), ("fn", "f"), ("op", "("), ("kw", "long"), ("op", ")"), ("op", "{"), ("kw", "return"),
        ("str", "&quot;a\\&quot;b&quot;"), ("op", "+"), ("num", "0x1F"), ("op", ";"), ("op", "}"), ("cm", "// done"),
    ]
    assert highlight.marked_line("a */ int", "c", "code") == ('<span class="tok-cm">a */</span> <span class="tok-kw">int</span>', "p")
    assert highlight.marked_line('x = """{ /*', "p", "code")[1] == "t" and highlight.marked_line("/* a", "p", "code")[1] == "c"
    assert classes(highlight.marked_line('<a b="c>" d=', "p", "markup")[0]) == [("kw", "&lt;a"), ("fn", "b"), ("op", "="), ("str", "&quot;c&gt;&quot;"), ("fn", "d"), ("op", "=")]
    assert highlight.marked_line("<b>", "p", None) == ("&lt;b&gt;", "p")


@pytest.mark.parametrize("kind", ["code", "markup", None])
def test_nothing_is_lost_and_maps_compose(kind):
    rng = random.Random(str(kind))
    bits = ["/*", "*/", '"""', '"', "'", "//", "<!--", "-->", "<a", ">", " ", "int", "x1", "&", "=", "é", "\\", "0.5", "/"]
    own = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)]
    for line in own:
        for state in highlight.STATES:
            assert plain(highlight.marked_line(line, state, kind)[0]) == line
    for cut in (0, 7, 399):
        first, second = highlight.state_map(own[:cut], kind), highlight.state_map(own[cut:], kind)
        both = "".join(second[highlight.STATES.index(s)] for s in first)
        assert both == highlight.state_map(own, kind)


def test_files_in_segments(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        long = "int a;\n/* one\n" + "\n".join(f"line {i} <" for i in range(300)) + "\n*/ int b;\n\n"
        files = [("a/L.java", long), ("b.txt", "int <x>\n"), ("c.kt", ""), ("d.xml", "<a\nb='c'\n/>"), ("e", None)]
        got = highlight.highlighted_lines(spark.createDataFrame(files, "path string, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = {(r.path, r.line_no): r.html for r in got}
    for path, text in files[:-1]:
        state, kind = "p", highlight.KINDS.get(path.rpartition(".")[2])
        for i, line in enumerate(text.split("\n"), 1):
            said, state = highlight.marked_line(line, state, kind)
            assert by.pop((path, i)) == said
    assert not by


def test_large_files_in_pieces_and_small_ones_where_they_were_read(spark, monkeypatch):
    monkeypatch.setattr(highlight, "WHOLE_BYTES", 40)
    monkeypatch.setattr(highlight, "PIECE_LINES", 3)
    rng = random.Random(5)
    bits = ["/*", "*/", '"""', "x1 = 5;", "<!--", "-->", "<a b=", ">", "\r", "\r\n", "\n", "\n", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(120))) for _ in range(12)] + ["", None, "é" * 41]
    files = [(f"f{i}.{('java', 'xml', 'txt')[i % 3]}", text) for i, text in enumerate(texts)] + [(None, "/* a\n" * 20)]
    got = {(r.path, r.line_no): r.html for r in highlight.highlighted_lines(spark.createDataFrame(files, "path string, text string")).collect()}
    want = {}
    for path, text in files:
        state, kind = "p", highlight.KINDS.get(str(path).rpartition(".")[2])
        for i, line in enumerate(re.split(r"\r\n|\n|\r", text) if text is not None else [], 1):
            want[path, i], state = highlight.marked_line(line, state, kind)
    assert got == want
    monkeypatch.undo()
    plan = highlight.highlighted_lines(spark.createDataFrame([], "path string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan  # no call of Python for each file


def test_symbols(spark):
    text = """junk
a/libx.so:     file format elf64-x86-64

DYNAMIC SYMBOL TABLE:
0000000000000000      DF *UND*\t0000000000000000 (GLIBC_2.2.5) system
0000000000001139 g    DF .text\t000000000000000b  Base        Java_p_q_My_1Class_go
b/liby.so:     file format elf32-i386
00001139 g    DO .data\t00000004 plain""".split("\n")
    rows = [("f", i, line) for i, line in enumerate(text)] + [("g", 0, text[5]), (None, 0, text[4])]
    got = sorted(str((r.file, r.library, r.kind, r.symbol, r.version, r["class"], r.method, r.unsafe)) for r in symbols.symbols(spark.createDataFrame(rows, "file string, line_no long, line string")).collect())
    assert got == sorted(map(str, [
        ("f", "a/libx.so", "imported", "system", "GLIBC_2.2.5", None, None, True),
        ("f", "a/libx.so", "exported", "Java_p_q_My_1Class_go", "Base", "p.q.My_Class", "go", False),
        ("f", "b/liby.so", "exported", "plain", None, None, None, False),
        ("g", None, "exported", "Java_p_q_My_1Class_go", "Base", "p.q.My_Class", "go", False),
        (None, None, "imported", "system", "GLIBC_2.2.5", None, None, True),
    ]))


def test_settings_are_merged_as_documents(spark):
    defaults = {"a": 1, "b": {"c": [1], "d": {"e": None}}, "f": {}}
    overrides = ['{"a": null, "g": 1.5}', '{"b": {"d": {"e": "x", "h": {}}, "i": true}}', '{"b": 3, "f": {"j": [{"k": 1}]}}', "[1]", "broken", None, "{}", '{"a": {"l": 1}}']
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(overrides)], "id int, o string")

    def deep(base, over):
        out = dict(base)
        for k, v in over.items():
            out[k] = deep(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
        return out

    for r in rows.select("o", payloads.merged(defaults, F.col("o")).alias("m")).collect():
        over = json.loads(r.o) if r.o and r.o != "broken" else {}
        assert json.loads(r.m) == deep(defaults, over if isinstance(over, dict) else {})
