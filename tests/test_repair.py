"""JSON with faults: what is kept, what is put right, and time in proportion to the text."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.operators import payloads
from auditlake.operators.repair import containers

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=12), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=6), v, max_size=4), max_leaves=12)


@settings(deadline=None, max_examples=300)
@given(st.dictionaries(st.text(max_size=6), st.text(alphabet='ab,:{}[] \\\n"é', max_size=12).filter(lambda t: '"' not in t), max_size=4))
def test_well_formed_objects_are_kept(value):
    assert containers(json.dumps(value)) == [value] and containers(json.dumps(value, ensure_ascii=False, indent=1)) == [value]


@settings(deadline=None, max_examples=300)
@given(VALUES, st.text(max_size=8))
def test_anything_gives_something_without_failing(value, tail):
    text = json.dumps(value)
    for cut in range(0, len(text), 3):
        json.dumps(containers(text[:cut] + tail + text[cut:]))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[{"title": "SQL: injection in login, unsafe", "severity": low,}]', [{"title": "SQL: injection in login, unsafe", "severity": "low"}]),
        ('[{"description": "key: value, more", "severity": "low",}]', [{"description": "key: value, more", "severity": "low"}]),
        ('{"findings": [{"title": "{a} [b],} \\"q\\"", "line": 76-80 (x)', [{"title": '{a} [b],} "q"', "line": "76-80 (x)"}]),
        ('Sure.\n{title: "a" "file": "b", "n": 7, "ok": True}', [{"title": "a", "file": "b", "n": 7, "ok": True}]),
        ('[{"a": "it said "no" to it"}, {"a": "b"]', [{"a": 'it said "no" to it'}, {"a": "b"}]),
        ('{"a": "x", "a": "y",, "b": }', [{"a": "x"}]),
        ('note {"t": "cut off in the mid', [{"t": "cut off in the mid"}]),
        ("[1, 2] and nothing", []),
        ("{} {", [{}]),
    ],
)
def test_faults(text, want):
    assert [json.loads(f) for f in payloads.findings_in(text)] == want


def test_hostile_text_takes_time_in_proportion():
    began = time.perf_counter()
    for text in ("[" * 100_000, '{"a":' * 100_000, '{"a": [' * 50_000 + '"x"', '"' * 200_000 + "{", '["' + '"x"' * 100_000, "[ ] " * 100_000, '{"' * 100_000, "{a " * 100_000, "```a\n" * 50_000, "[1]{" * 50_000, "\\" * 200_001 + '{"'):
        payloads.findings_in(text)
        payloads.object_spans(text)
    assert time.perf_counter() - began < 20
    assert payloads.findings_in("[" * 100_000) == [] and payloads.findings_in('{"a":' * 100_000) == []


def test_objects_are_spans():
    deep = "{" * 8000 + "}" * 8000
    assert len(payloads.object_spans(deep)) == 8000 and payloads.object_spans(deep, 1) == [(0, 16000)]
    assert payloads.object_spans('{ "x {" {a} {b}') == [(8, 11), (12, 15)] and payloads.object_spans('{ "x {" {a} {b}', 1) == [(8, 11)]
    assert payloads.object_spans('{"a": {}} {', 1) == [(0, 9)] and payloads.object_spans(None) == []


def test_ladder_ends_with_patterns(spark):
    replies = [(1, "vulnerability_type: SQL\nfile: A.java\nseverity: low"), (2, '[{"title": "a: b, c", "severity": low,}]'), (3, None), (4, "[" * 100_000), (5, "plain"), (6, '[{"title": "t"}]'), (None, '{"title": "n"}')]
    found = payloads.parsed_findings(spark.createDataFrame(replies, "id long, reply string"), ["id"], "reply").collect()
    got = {(r.id, r.title, r.vulnerability_type, r.severity, r.file) for r in found}
    assert got == {(1, None, "SQL", "low", "A.java"), (2, "a: b, c", None, "low", None), (6, "t", None, None, None), (None, "n", None, None, None)} and len(found) == 4
