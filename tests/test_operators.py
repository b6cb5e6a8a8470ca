import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators import context, graph, indicators, payloads, projects, reports, rollups, rules, verdicts
from auditlake.sources import files
from auditlake.streaming import events


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.apk", "w") as z:
        z.writestr("classes.dex", b"x")
        z.writestr("lib/arm64-v8a/libflutter.so", b"yy")
    (tmp_path / "broken.apk").write_bytes(b"no zip")
    entries = files.archive_entries(spark, f"{tmp_path}/*.apk")
    assert sorted((r.entry, r.size) for r in entries.collect()) == [("classes.dex", 1), ("lib/arm64-v8a/libflutter.so", 2)]
    found = indicators.with_confidence(indicators.framework_hits(entries, "path", "entry")).collect()
    assert [(r.framework, round(r.confidence, 2)) for r in found] == [("Flutter", 0.85)]


def test_suppression_and_ties(spark):
    rows = [("a", 0, "Flutter", 0.8), ("a", 11, "Native (C/C++)", 0.9), ("b", 11, "Native (C/C++)", 0.9), ("b", 4, "Unity", 0.9)]
    found = spark.createDataFrame(rows, "app string, ord int, framework string, confidence double")
    kept = indicators.suppressed(found, "app")
    assert sorted((r.app, r.framework) for r in kept.collect()) == [("a", "Flutter"), ("b", "Native (C/C++)"), ("b", "Unity")]
    assert {r.app: r.framework for r in indicators.primary(kept, "app").collect()} == {"a": "Flutter", "b": "Unity"}


def test_tree_and_store(spark, tmp_path):
    (tmp_path / "src" / "x").mkdir(parents=True)
    (tmp_path / "src" / "x" / "A.java").write_text("class A {}")
    (tmp_path / "src" / "x" / "b.txt").write_text("no")
    assert [r.text for r in files.source_tree(spark, f"{tmp_path}/src").collect()] == ["class A {}"]
    for name, body in (("1", '{"id": "1", "status": "completed"}'), ("2", "{broken"), ("3", '{"status": "failed"}')):
        (tmp_path / "store" / name).mkdir(parents=True)
        (tmp_path / "store" / name / "meta.json").write_text(body)
    scans = files.scan_store(spark, f"{tmp_path}/store")
    assert [r.id for r in scans.collect()] == ["1"]
    files.write_scans(scans, f"{tmp_path}/out")
    assert files.without_scan(scans, "1").count() == 0


def test_captured_listings(spark):
    lines = spark.createDataFrame([("List of devices",), ("emulator-5554\tdevice",), ("usb\toffline",), ("package:b",), ("package:a ",)], "l string")
    assert [tuple(r) for r in files.tab_devices(lines, "l").collect()] == [("emulator-5554", "device")]
    assert [r.package for r in files.package_names(lines, "l").collect()] == ["a", "b"]


def test_context_and_pages(spark):
    text = "\n".join(f"line {i}" for i in range(1, 21))
    source = spark.createDataFrame([("a", text)], "path string, text string")
    spans = spark.createDataFrame([("a", 9, 6), ("a", 50, 50)], "path string, s int, e int")
    found = {r.s: (r.start_line, r.end_line, len(r.lines)) for r in context.context(source, spans, "path").collect()}
    assert found == {9: (2, 13, 12), 50: (16, 20, 5)}
    pages = context.pages(source, "path", 20).orderBy("page").collect()
    assert (pages[0].first_line, pages[0].last_line, pages[-1].last_line) == (1, 2, 20)
    assert context.usable_pattern("a(") == "(?i)a\\("


def test_payloads():
    finding = {"title": "t", "file": "f"}
    assert [json.loads(f) for f in payloads.findings_in(json.dumps([finding]))] == [finding]
    assert [json.loads(f) for f in payloads.findings_in(json.dumps({"results": [finding]}))] == [finding]
    assert [json.loads(f) for f in payloads.findings_in("x\n```json\n[{\"title\": \"t\", \"file\": \"f\"}]\n```")] == [finding]
    broken = payloads.findings_in('[{"title": "t", "line": 76-80 (x), "severity": low,}]')
    assert json.loads(broken[0]) == {"title": "t", "line": "76-80 (x)", "severity": "low"}
    assert payloads.findings_in("nothing") == [] and payloads.findings_in(None) == []
    assert payloads.balanced_objects('a {"b": "}", "c": {"d": 1}} {e') == ['{"b": "}", "c": {"d": 1}}', '{"d": 1}']


@pytest.mark.parametrize("value", [[], [{"a": 1}], {"findings": [{"x": "y, z: w"}]}])
def test_well_formed_json_is_kept(value):
    found = [json.loads(f) for f in payloads.findings_in(json.dumps(value))]
    assert found == (value if isinstance(value, list) else value["findings"])


def test_components(spark):
    xml = '<a><activity android:name=".A"><intent-filter><action android:name="x.GO"/></intent-filter></activity><service android:name=".S" android:exported="false"/>'
    rows = rules.components(spark.createDataFrame([("a", xml), ("b", None)], "app string, xml string"), "app")
    reach = rows.select("name", rules.is_exported(F.col("exported"), F.col("has_filter")).alias("r")).collect()
    assert sorted(map(tuple, reach)) == [(".A", True), (".S", False)]


def test_verdicts(spark):
    findings = spark.createDataFrame([("s", "F1"), ("s", "F2")], "scan string, finding_id string")
    schema = "scan string, step int, finding_id string, finding_ids array<string>, status string, evidence string, reason string"
    actions = [("s", 1, None, ["F1", "F2"], "verified", "e", None), ("s", 2, "F2", None, "not_verified", None, "r"), ("s", 3, "F9", None, "verified", "e", None), ("s", 4, "F1", None, "bad", None, None)]
    judged = verdicts.judged(findings, verdicts.recorded(spark.createDataFrame(actions, schema), findings))
    assert {r.finding_id: (r.status, r.evidence, r.reason) for r in judged.collect()} == {"F1": ("verified", "e", None), "F2": ("not_verified", None, "r")}


def test_capped_set_and_graph(spark):
    rows = spark.createDataFrame([("k", v, i) for i, v in enumerate("baacbd")], "k string, v string, ord int")
    assert rollups.capped_set(rows, ["k"], "v", "ord", 3).first()["vs"] == ["b", "a", "c"]
    call = spark.createDataFrame([("A$1", "x->execSQL y"), ("A", "Landroid/util/Log;->d")], "cls string, call string")
    assert sorted(map(tuple, graph.signals(call, "cls", "call").collect())) == [("A", "logging", 1), ("A", "sql", 1)]


def test_backlog_of_batches_equals_that_of_all(spark):
    rows = [(s, i, "log") for s in (1, 2) for i in range(10)]
    everything = spark.createDataFrame(rows, "scan_id int, seq int, type string")
    kept = None
    for low in range(0, 10, 3):
        kept = events.merge_backlog(kept, everything.where((F.col("seq") >= low) & (F.col("seq") < low + 3)), 4)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, events.newest(everything, 4).collect()))


def test_salvage_and_patterns(spark):
    replies = [(1, '{"v": [{"title": "a \\"q\\" \\u00e9", "line": 76-80 (x), "file": "B.java"}, {"title": "no place"}]}'), (2, None), (3, ""), (4, 'say " {"title": "t", "severity": bad}')]
    found = payloads.salvaged(spark.createDataFrame(replies, "id long, reply string"), ["id"], "reply").collect()
    assert [(r.id, r.title, r.file, r.line) for r in found] == [(1, 'a "q" é', "B.java", "76-80 (x)")]
    blocks = spark.createDataFrame([(1, "x {vulnerability_type: SQL, file: A.java} [file: B.java]"), (2, None)], "id long, reply string")
    assert [(r.vulnerability_type, r.file, r.severity) for r in payloads.block_findings(blocks, ["id"], "reply").collect()] == [("SQL", "A.java", None)]


def test_actions(spark):
    replies = ['{"action": "Read", "path": "p"}', "[]", '{"findings": [1]}', '{"action": "report", "vulnerabilities": []}', "so: {\"action\": \"grep\"} {", "", None, "{", "7"]
    rows = spark.createDataFrame(list(enumerate(replies)), "id long, reply string")
    found = {r.id: (r.action, r.path, r.findings) for r in payloads.actions(rows, ["id"], "reply").collect()}
    assert found == {0: ("read", "p", None), 1: ("report", None, "[]"), 2: ("report", None, "[1]"), 3: ("report", None, "[]"), 4: ("grep", None, None)}


def test_saved_scans(spark):
    store = spark.createDataFrame([("1", "a", None, {"json": True}), ("2", "b", "2024", None)], "id string, status string, created_at string, reports map<string,boolean>")
    changed = spark.createDataFrame([("2", "x", "2024", None), ("2", "y", "2025", {"html": False}), ("9", "z", "2025", None), (None, "n", None, None)], store.schema)
    assert sorted((r.id, r.status) for r in files.saved_scans(store, changed).collect()) == [("1", "a"), ("2", "y")]


def test_numbered(spark):
    rows = spark.createDataFrame([(None, 3), (None, None), (1, 2), (1, 2), (1, 1)], "k long, v long")
    found = sorted((r.k or 0, r.place, r.v or 0) for r in rollups.numbered(rows, ["k"], ["v"]).collect())
    assert found == [(0, 1, 0), (0, 2, 3), (1, 1, 1), (1, 2, 2), (1, 3, 2)]
    assert sorted(r.place for r in rollups.numbered(spark.range(1000).toDF("v"), [], ["v"]).where("place = v + 1").collect()) == list(range(1, 1001))
    assert rollups.numbered(rows.limit(0), ["k"], ["v"]).count() == 0


def test_apps_with_equal_names_never_meet(spark):
    two = lambda rows, schema: spark.createDataFrame(rows, f"app string, {schema}")
    classes = two([("a", "X", "Base", "X.java"), ("b", "X", None, "X.java"), (None, "X", "None", "n.java"), ("b", "Y", None, "Y.java")], "cls string, extends string, file string")
    roles, loaders = two([("a", "X", "activity")], "cls string, role string"), two([("b", "X")], "cls string")
    refs = two([("a", "Y", 0, "X"), ("b", "Y", 0, "X")], "cls string, ord long, ref string")
    calls = two([("b", "X$1", "z->execSQL"), (None, "X", "Landroid/util/Log;->d")], "cls string, call string")
    got = {(r.app, r.cls): (r.extends, r.role, r.flagged, r.refs) for r in graph.code_graph(classes, roles, refs, calls, loaders, ("app",)).collect()}
    assert got == {
        ("a", "X"): ("Base", "activity", False, None),
        ("b", "X"): (None, "native-bridge", True, None),
        ("b", "Y"): (None, "class", True, "X"),
        (None, "X"): ("None", "class", True, None),
    }
    nodes = two([("a", "Na", 1, "com/x/A.java"), ("b", "Nb", 0, "com/x/A.java"), ("b", "Nc", 1, "com/y/A.java")], "node string, ord int, node_file string")
    files = two([("a", "./sources/com/x/A.java:7"), ("b", "com\\y\\A.java"), ("b", "q/A.java:3-4"), ("c", "com/x/A.java"), ("a", " "), ("a", None)], "file string")
    found = {(r.app, r.file): (r.node, r.tier) for r in graph.node_of_file(files, nodes, ("app",)).collect()}
    assert found == {("a", "./sources/com/x/A.java:7"): ("Na", 0), ("b", "com\\y\\A.java"): ("Nc", 0), ("b", "q/A.java:3-4"): ("Nb", 1)}
    paths = two([("a", "sources/S.java"), ("b", "resources/S.java"), ("a", "S.txt")], "path string")
    wanted = two([("a", 1, "/S.java"), ("b", 2, "S.java"), ("b", 3, "S.txt"), (None, 4, "S.java")], "id int, file string")
    assert {r.id: r.path for r in graph.resolved_paths(wanted, paths, ["id"], ("app",)).collect()} == {1: "sources/S.java", 2: "resources/S.java"}
    assert sorted(tuple(r) for r in graph.unread(paths, paths.where("app = 'a'"), "path", ("app",)).collect()) == [("b", "resources/S.java")]


def test_archives_of_any_kind(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "plain a.apk", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("AndroidManifest.xml", "<manifest é/>")
        z.writestr("x/big.txt", "y" * 100_000)
        with z.open(zipfile.ZipInfo("huge"), "w", force_zip64=True) as entry:
            entry.write(b"z")
    whole = (tmp_path / "plain a.apk").read_bytes()
    (tmp_path / "cut.apk").write_bytes(whole[:-40])
    (tmp_path / "none.apk").write_bytes(b"")
    (tmp_path / "torn.apk").write_bytes(whole[:200] + b"?" * 40 + whole[240:])
    with zipfile.ZipFile(tmp_path / "empty.apk", "w"):
        pass
    found = files.archive_entries(spark, f"{tmp_path}/*.apk").where("path like '%plain%' or path like '%empty%' or path like '%cut%' or path like '%none%'")
    assert sorted((r.entry, r.size) for r in found.collect()) == [("AndroidManifest.xml", len("<manifest é/>".encode())), ("huge", 1), ("x/big.txt", 100_000)]
    texts = files.archive_texts(spark, f"{tmp_path}/*.apk", r"Manifest\.xml$").where("path like '%plain%'").collect()
    assert [(r.entry, r.text) for r in texts] == [("AndroidManifest.xml", "<manifest é/>")]
    assert files.archive_texts(spark, f"{tmp_path}/plain*.apk", "big", most=10).count() == 0


def test_reports_know_their_formats(spark):
    with pytest.raises(ValueError, match="pdf"):
        reports.report("pdf", spark.range(1), spark.range(1), "id", "t", "c", "o")
    rows = spark.createDataFrame([(1, None, "SQL", None, 5, None), (2, "t", None, "HIGH", None, 9)], "id int, title string, vulnerability_type string, severity string, line_number int, line_end int")
    got = [(r.id, r.bucket, r.title, r.severity, r.line, r.line_end, r.file, r.cvss_score) for r in reports.entries(rows, ["id"]).orderBy("id").collect()]
    assert got == [(1, "info", "SQL", "info", 5, 5, "", None), (2, "high", "t", "HIGH", 0, 9, "", None)]


def test_a_blob_ends_with_the_space_before_a_path(spark):
    rows = [("p", "bbb"), ("p", "aaa"), ("p", "ccc"), ("q", None), ("q", "a"), ("r", None)]
    found = lambda most: {r.project: r.blob for r in projects.content_blob(spark.createDataFrame(rows, "project string, path string"), "project", most).collect()}
    for most in range(1, 13):
        assert found(most) == {"p": "aaa bbb ccc"[:most], "q": "a", "r": None}


def test_pages_are_folded_from_lengths_alone(spark):
    def plain(text, most):
        rows, first, used, own = [], 1, 0, re.split(r"\r\n|\n|\r", text or "")
        for n, line in enumerate(own, 1):
            if used and used + len(line) + 1 > most:
                rows.append((first, n - 1))
                first, used = n, 0
            used += len(line) + 1
        return [(k, *r) for k, r in enumerate([*rows, (first, len(own))], 1)]

    texts = [None, "", "\n", "a" * 50, "é𝄞\r\n" * 40, "a\rb\n\nc" * 9 + "x" * 30, *["\n".join("y" * (i * k % 23) for i in range(60)) for k in range(1, 9)]]
    files = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    for most in (1, 20, 64):
        found = context.pages(files, "path", most)
        assert "first_lines(sizes" in found._jdf.queryExecution().optimizedPlan().toString()  # no text reaches Python
        got = sorted(tuple(r) for r in found.select("path", "page", "first_line", "last_line").collect())
        assert got == sorted((i, *page) for i, text in enumerate(texts) for page in plain(text, most))
