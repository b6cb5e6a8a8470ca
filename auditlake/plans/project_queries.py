"""Queries over project folders: hosts stand for projects, a path made from each page for a file."""

from __future__ import annotations

import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.operators import projects as P
from auditlake.plans.registry import query, read
from auditlake.plans.texts import PATHS_SQL, paths
from auditlake.sources import files as SF
from auditlake.sources.shared import shared_folder

_PATHS = sorted({(f"x{s[1:]}" if s.startswith("*") else s) for _, _, s, _, _ in P.SIGNS}) + ["README.md", "src/main/java/a/B.java", "res/values/s.xml"]
_TEXTS = ['{"react-native": 1}', "com.badlogicgames.gdx", "kotlin-android", "Xamarin", ""]


def files(spark, sf: str) -> DataFrame:
    k = F.col("page_id")
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.pmod(k * 5 + F.length("url"), F.lit(len(_PATHS))) + 1).cast("int"))
    text = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (k % len(_TEXTS) + 1).cast("int"))
    return read(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("project"), path.alias("path"), text.alias("text"))


_SQL = f"""p AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS project, [{", ".join(f"'{p}'" for p in _PATHS)}][CAST((page_id * 5 + length(url)) % {len(_PATHS)} + 1 AS INTEGER)] AS path,
 [{", ".join(f"'{t}'" for t in _TEXTS)}][CAST(page_id % {len(_TEXTS)} + 1 AS INTEGER)] AS text FROM pages)"""
_ORDER = {name: k for k, name in enumerate(P.BASE)}
_SQL_SIGNS = "s(k, ord, framework, base, most, needed, sign, weight, needs) AS (VALUES " + ", ".join(
    f"({i}, {_ORDER[f]}, '{f}', {P.BASE[f][0]}::DOUBLE, {P.BASE[f][1]}::DOUBLE, {str(needed).lower()}, '{s}', {w}::DOUBLE, {repr(t) if t else 'NULL'})" for i, (f, needed, s, w, t) in enumerate(P.SIGNS)
) + ")"


@query(f"""WITH {_SQL}, {_SQL_SIGNS}, h AS (SELECT DISTINCT project, s.* FROM p JOIN s ON CASE WHEN sign[1] = '*' THEN ends_with(path, sign[2:]) ELSE path = sign OR starts_with(path, sign || '/') END
 AND (needs IS NULL OR contains(text, needs))) SELECT project, CAST(ord AS INTEGER) AS ord, framework, CAST(count(*) AS BIGINT) AS signs, round_even(least(max(most), max(base) + sum(weight)), 6) AS confidence
 FROM h GROUP BY project, ord, framework HAVING bool_or(needed)""")
def project_detect(spark, sf):
    found = P.project_hits(files(spark, sf))
    return found.withColumns({"signs": F.col("signs").cast("long"), "confidence": F.bround("confidence", 6)})


@query(f"""WITH {_SQL} SELECT project, count(*) FILTER (path LIKE '%.java') AS java, count(*) FILTER (path LIKE '%.kt') AS kotlin, count(*) FILTER (path LIKE '%.dart') AS dart, count(*) FILTER (path LIKE '%.js') AS script,
 count(*) FILTER (path LIKE '%.so') AS native_libs, count(*) FILTER (path LIKE '%.xml') AS layouts, count(*) AS files, bool_or(regexp_extract(path, '([^/]*)$', 1) IN ('pubspec.yaml', 'package.json', 'build.gradle', 'CMakeLists.txt')) AS has_build_file
 FROM p GROUP BY project""")
def project_structure(spark, sf):
    return P.structure(files(spark, sf))


@query(f"WITH {_SQL} SELECT project, left(string_agg(path, ' ' ORDER BY path), 500) AS blob FROM p GROUP BY project")
def project_blob(spark, sf):
    return P.content_blob(files(spark, sf).select("project", "path"), "project", 500)


@query("""SELECT page_id, round_even(CASE WHEN w > 0 AND c > 0 THEN least(0.98::DOUBLE, 0.85::DOUBLE + (w + c) * 0.02::DOUBLE) WHEN w + c > 0 THEN least(0.9::DOUBLE, 0.6::DOUBLE + (w + c) * 0.1::DOUBLE) ELSE 0 END, 6) AS confidence
 FROM (SELECT page_id, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS w, CAST(len(regexp_extract_all(html, '<h[23]')) AS BIGINT) % 3 AS c FROM pages)""")
def cordova_package(spark, sf):
    """A page's scripts stand for web files, its headings for classes."""
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return read(spark, sf, "pages").select("page_id", F.bround(F.coalesce(P.cordova_confidence(count("<script"), count("<h[23]") % 3), F.lit(0.0)), 6).alias("confidence"))


@query("""WITH x AS (SELECT doc_id, CASE WHEN length(text) > 0 THEN 40 ELSE 0 END + CASE WHEN contains(text, '?') THEN 30 ELSE 0 END + CASE WHEN contains(lower(text), 'license') THEN 30 ELSE 0 END AS percent FROM documents)
SELECT doc_id, percent, CASE WHEN percent >= 80 THEN 'complete' WHEN percent >= 50 THEN 'partial' ELSE 'minimal' END AS level FROM x""")
def input_completeness(spark, sf):
    """Texts as sources, their questions as manifests, their licences as build files."""
    percent, level = P.completeness(F.col("text"), F.regexp_extract("text", r"\?", 0), F.regexp_extract("text", "(?i)license", 0))
    return read(spark, sf, "documents").select("doc_id", percent.alias("percent"), level.alias("level"))


@query("""WITH c AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'adb -s ' || user_id || ' shell dumpsys ' WHEN 'click' THEN 'adb shell rm ' WHEN 'purchase' THEN 'LOGCAT ' WHEN 'error' THEN 'shell ' ELSE '  adb shell am ' END || props AS c FROM events)
SELECT event_id, regexp_matches(trim(c), '^(adb -s \\d+ shell dumpsys|LOGCAT|adb shell am) ') AS allowed FROM c""")
def command_scope(spark, sf):
    kind = F.col("event_type")
    said = F.when(kind == "view", F.concat(F.lit("adb -s "), F.col("user_id").cast("string"), F.lit(" shell dumpsys "))).when(kind == "click", "adb shell rm ")
    said = said.when(kind == "purchase", "LOGCAT ").when(kind == "error", "shell ").otherwise("  adb shell am ")
    return read(spark, sf, "events").select("event_id", P.allowed_command(F.concat(said, "props")).alias("allowed"))


@query(f"""WITH {PATHS_SQL}, t AS (SELECT page_id, size % 7 = 0 AS native, lower(path || ' ' || html) AS said FROM p)
SELECT page_id, array_to_string(list_filter([CASE WHEN contains(said, 'manifest') THEN 'manifest_review' END, CASE WHEN regexp_matches(said, 'ssl|trust|http|cert|hostname|network|socket') THEN 'network_security' END,
 CASE WHEN native OR regexp_matches(said, '\\.so|jni|native') THEN 'offensive_android' END], lambda x: x IS NOT NULL), ',') AS skills FROM t""")
def contextual_skills(spark, sf):
    """Steps that look for a whole page's text in its path."""
    rows = paths(spark, sf)
    action = F.when(F.col("size") % 7 == 0, "inspect_native").otherwise("search_code")
    return rows.select("page_id", F.array_join(P.contextual_skills(action, F.col("path"), F.col("html")), ",").alias("skills"))


def _written(rows: DataFrame, root: str) -> list[str]:
    """Pages in archives of 500 numbers at most, one folder; and each as a file of its own. The folders that they are in."""

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        name = f"{own['app'].iloc[0]}-{own['part'].iloc[0]}"
        with _shared_file(f"{root}/packages/{name}.apk") as target, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path, html in zip(own["path"], own["html"], strict=True):
                archive.writestr(zipfile.ZipInfo(path), html)
        for page, path, html in zip(own["page_id"], own["path"], own["html"], strict=True):
            with _shared_file(f"{root}/trees/{page}/{path}") as target:
                target.write(html.encode())
        return own[["page_id"]]

    parts = rows.select("app", F.floor(F.col("page_id") / 500).alias("part"), "page_id", "path", "html")
    parts.groupBy("app", "part").applyInPandas(pack, "page_id long").count()
    return [f"{root}/packages/*.apk", f"{root}/trees"]


def _shared_file(path: str):
    """A new file below the shared folder, for writing."""
    import pyarrow.fs as fs

    if path.startswith("file:") or path.startswith("/"):
        place = Path("/" + path.removeprefix("file:").lstrip("/"))
        place.parent.mkdir(parents=True, exist_ok=True)
        return place.open("wb")
    store, place = fs.FileSystem.from_uri(path)
    return store.open_output_stream(place)


@query(f"WITH {PATHS_SQL} SELECT app || '-' || page_id // 500 AS package, path AS entry, octet_length(encode(html)) AS size FROM p")
def archive_listing(spark, sf):
    """Packages written to the shared folder and listed from their ends."""
    packages, _ = _written(paths(spark, sf), shared_folder(spark))
    return SF.archive_entries(spark, packages).select(F.regexp_extract("path", r"([^/]*)\.apk$", 1).alias("package"), "entry", "size")


@query(f"WITH {PATHS_SQL} SELECT app || '-' || page_id // 500 AS package, path AS entry, md5(html) AS text FROM p WHERE path LIKE '%AndroidManifest.xml' OR path LIKE '%/strings.xml'")
def archive_manifests(spark, sf):
    packages, _ = _written(paths(spark, sf), shared_folder(spark))
    found = SF.archive_texts(spark, packages, r"(^|/)(AndroidManifest|strings)\.xml$")
    return found.select(F.regexp_extract("path", r"([^/]*)\.apk$", 1).alias("package"), "entry", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"WITH {PATHS_SQL} SELECT page_id, path, md5(html) AS text FROM p WHERE path LIKE '%.java' OR path LIKE '%.kt'")
def source_tree(spark, sf):
    """Files written to the shared folder, of which those with the endings of sources are read."""
    _, trees = _written(paths(spark, sf), shared_folder(spark))
    part = lambda i: F.regexp_extract("path", r"/trees/(\d+)/(.*)$", i)
    return SF.source_tree(spark, trees).select(part(1).cast("long").alias("page_id"), F.url_decode(F.replace(part(2), F.lit("+"), F.lit("%2B"))).alias("path"), F.md5(F.col("text").cast("binary")).alias("text"))


@query("SELECT s_name AS serial, 'device' AS state, s_suppkey AS line_no FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_name, 'package', s_suppkey FROM supplier WHERE s_acctbal BETWEEN 1000 AND 3000")
def captured_listings(spark, sf):
    """Suppliers stand for the lines of captured listings: devices that are ready or not, packages, and lines that are neither."""
    money, name = F.col("s_acctbal"), F.col("s_name")
    line = F.when(money > 5000, F.concat(name, F.lit("\tdevice"))).when(money > 3000, F.concat(name, F.lit("\toffline")))
    line = line.when(money.between(1000, 3000), F.concat(F.lit("package:"), name, F.lit(" "))).otherwise("List of devices attached")
    rows = read(spark, sf, "supplier").select(line.alias("line"))
    numbered = lambda df, c: df.withColumn("line_no", F.substring(c, 10, 20).cast("long"))
    devices = numbered(SF.tab_devices(rows, "line"), "serial")
    packages = SF.package_names(rows, "line").select(F.col("package").alias("serial"), F.lit("package").alias("state"))
    return devices.select("serial", "state", "line_no").unionByName(numbered(packages, "serial").select("serial", "state", "line_no"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'parsed' WHEN page_id % 2 = 0 THEN 'raw' ELSE coalesce(nullif(regexp_extract(html, '<title>([^<]*)<', 1), ''), '-') END AS manifest FROM pages""")
def manifest_cascade(spark, sf):
    parsed, raw = F.when(F.col("page_id") % 3 == 0, "parsed"), F.when(F.col("page_id") % 2 == 0, "raw").otherwise(" ")
    title = F.nullif(F.regexp_extract("html", "<title>([^<]*)<", 1), F.lit(""))
    return read(spark, sf, "pages").select("page_id", P.first_source(parsed, raw, F.coalesce(title, F.lit("-"))).alias("manifest"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>([^<]*)<', 1)) AS heading FROM pages WHERE regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>([^<]*)<', 1) <> ''")
def first_element_text(spark, sf):
    found = read(spark, sf, "pages").select("page_id", T.first_tag_text(F.col("html"), "h1").alias("heading"))
    return found.where("heading is not null")


@query(f"WITH {_SQL}, r AS (SELECT project, path, CASE path WHEN 'AndroidManifest.xml' THEN 1 WHEN 'res' THEN 2 ELSE 3 END AS k FROM p) SELECT project, arg_min(path, (k, path)) AS path FROM r GROUP BY project")
def manifest_discovery(spark, sf):
    return SF.first_existing(files(spark, sf), "project", "path", ["AndroidManifest.xml", "res"])
