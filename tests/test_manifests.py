"""The manifest reader: names, places, broken and hostile text."""

import time

from pyspark.sql import functions as F

from auditlake.operators import manifests, rules

HEAD = f'<manifest xmlns:a="{manifests.ANDROID}" package="p.q"'


def test_places_decide():
    xml = f"""﻿\n{HEAD} a:versionCode="7" versionCode="8"><!-- <application/> --><uses-sdk a:minSdkVersion="21"/><uses-sdk a:minSdkVersion="1"/>
<activity a:name="outside"/><application a:label='A "b" &lt;c&gt;'><activity a:name=".M" exported="true"><layout><intent-filter/></layout><intent-filter><action a:name="x"/>
<deep><action a:name="no"/></deep></intent-filter></activity><meta><service a:name="nested"/></meta><service/></application><application><activity a:name="second"/></application></manifest>"""
    parsed, package, code, name, least, target, label, found = manifests.manifest_of(xml)
    assert (parsed, package, code, name, least, target, label) == (True, "p.q", "7", None, "21", None, 'A "b" <c>')
    assert [(c["kind"], c["name"], c["exported"]) for c in found] == [("activity", ".M", None), ("service", None, None)]
    assert [f["actions"] for f in found[0]["filters"]] == [["x"]]


def test_broken_text_gives_its_components():
    xml = """<a><!-- <activity android:name="hidden"/> --><activity-alias android:name="alias"/><activity android:name='A>B' android:exported = "true"
><intent-filter><action android:name="go"/></intent-filter></activity><action android:name="loose"/><service android:name="S"/><intent-filter/><receiver"""
    parsed, *_, found = manifests.manifest_of(xml)
    assert not parsed and [(c["kind"], c["name"], c["exported"], c["filters"]) for c in found] == [
        ("activity", "A>B", "true", [{"actions": ["go"], "categories": [], "schemes": []}]),
        ("service", "S", None, []),
    ]
    assert manifests.manifest_of(None)[0] is False and manifests.manifest_of("")[-1] == []
    assert manifests.manifest_of("<a>\ud800</a>")[0] is False


def test_time_in_proportion_to_the_text():
    began = time.perf_counter()
    for hostile in ("<activity " * 100_000, "<activity a='" * 50_000, "<a>" * 200_000, "<!--" * 100_000, f"{HEAD}>" + "<x>" * 200_000, '<activity "' * 50_000):
        assert manifests.manifest_of(hostile)[0] is False
    assert time.perf_counter() - began < 10


def test_columns(spark):
    rows = [(1, f'{HEAD} a:versionCode=" 12 " ><application><provider a:name=".P"/></application></manifest>'), (None, "<manifest android:name=\"MyActivity\""), (2, None), (3, "plain android:name=\"xActivity\"")]
    files = spark.createDataFrame(rows, "id long, xml string")
    read = manifests.manifests(files, ["id", "xml"])
    info = {r.id: r for r in manifests.app_info(read, ["id"]).collect()}
    assert len(info) == 4 and info[1].version_code == 12 and info[1].providers == [".P"] and info[1].activities == []
    assert {r.id: r.total for r in manifests.component_counts(manifests.app_info(read, ["id"]), ["id"]).collect()} == {1: 1, None: 0, 2: 0, 3: 0}
    assert [(r.id, r.name, r.exported) for r in manifests.activity_details(read, ["id"], F.col("xml")).collect()] == [(None, "MyActivity", "unknown")]
    assert manifests.manifests(files.limit(0), ["id"]).count() == 0


def test_names_are_resolved_within_their_app(spark):
    refs = spark.createDataFrame([("a", "@string/n"), ("b", "@string/n"), (None, "@string/n"), ("c", "@string/n"), ("a", "plain")], "app string, ref string")
    values = spark.createDataFrame([("a", "n", 2, "late"), ("a", "n", 1, "A"), ("b", "n", 1, "B"), (None, "n", 1, "none")], "app string, name string, ord int, value string")
    got = sorted((str(r.app), r.ref, r.resolved) for r in rules.resolved(refs, values, "app").collect())
    assert got == [("None", "@string/n", "none"), ("a", "@string/n", "A"), ("a", "plain", "plain"), ("b", "@string/n", "B"), ("c", "@string/n", "@string/n")]
