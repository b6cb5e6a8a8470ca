"""Queries over packages: hosts stand for apps, a path made from each of their pages for an entry of the package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.operators import indicators as I
from auditlake.operators import manifests as M
from auditlake.operators import matching as MA
from auditlake.operators import rollups as R
from auditlake.operators import rules as RU
from auditlake.plans.registry import query, read
from auditlake.plans.texts import PATHS_SQL, paths

WEIGHTS = {"The": 3, "license": 5, "token": 10, "Password": 7}


def entries(spark, sf: str) -> DataFrame:
    """app, entry: a file name from the list of known ones for each page, now and then bytecode or a library."""
    names = [i for own in I.TECHNOLOGIES.values() for i in own] + ["classes.dex", "lib/arm64-v8a/libapp.so", "res/x.xml"]
    which = F.pmod(F.col("page_id") * 7 + F.length("url"), F.lit(len(names)))
    entry = F.element_at(F.array(*[F.lit(n) for n in names]), (which + 1).cast("int"))
    app = F.concat(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.when(F.col("page_id") % 10 == 0, "-kotlin").otherwise(""))
    return read(spark, sf, "pages").select("page_id", app.alias("app"), entry.alias("entry"))


_NAMES = [i for own in I.TECHNOLOGIES.values() for i in own] + ["classes.dex", "lib/arm64-v8a/libapp.so", "res/x.xml"]
_SQL_ENTRIES = f"""e AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) || CASE WHEN page_id % 10 = 0 THEN '-kotlin' ELSE '' END AS app,
 [{", ".join(f"'{n}'" for n in _NAMES)}][CAST((page_id * 7 + length(url)) % {len(_NAMES)} + 1 AS INTEGER)] AS entry FROM pages)"""
_SQL_INDICATORS = "i(ord, framework, indicator) AS (VALUES " + ", ".join(f"({k}, '{f}', '{i}')" for k, (f, own) in enumerate(I.TECHNOLOGIES.items()) for i in own) + ")"
_SQL_HITS = f"{_SQL_ENTRIES}, {_SQL_INDICATORS}, h AS (SELECT app, ord, framework, count(DISTINCT indicator) AS n FROM e JOIN i ON contains(entry, indicator) GROUP BY ALL)"
_SQL_CONFIDENCE = "CASE framework " + " ".join(
    f"WHEN '{f}' THEN least({cap}::DOUBLE, {base}::DOUBLE + n * {step}::DOUBLE)" for f, (cap, base, step) in I.CONFIDENCE.items()
) + " ELSE 0.9::DOUBLE END"
_SQL_PLATFORM = """f AS (SELECT app, count(*) FILTER (regexp_matches(entry, '^lib/.*\\.so$')) AS n, bool_or(entry = 'classes.dex') AS dex,
 bool_or(regexp_matches(entry, 'libflutter.so|assets/flutter_assets/|isolate_snapshot|libreactnativejni.so|assets/index.android.bundle|index.bundle|libhermes.so|libjsi.so|libunity.so|UnityEngine.dll|UnityEditor.dll|libUE4.so|assets/Unreal/UE4Game/Manifest.xml')) AS other,
 bool_or(regexp_matches(entry, '^lib/.*\\.so$')) AS lib FROM e GROUP BY app),
p AS (SELECT app, 9 AS ord, 'Java' AS framework, n, 0.8::DOUBLE AS confidence FROM f WHERE dex AND NOT other UNION ALL SELECT app, 10, 'Kotlin', n, 0.9::DOUBLE FROM f WHERE contains(lower(app), 'kotlin')
 UNION ALL SELECT app, 11, 'Native (C/C++)', n, 1.0::DOUBLE FROM f WHERE lib),
a AS (SELECT app, ord, framework, n, """ + _SQL_CONFIDENCE + """ AS confidence FROM h UNION ALL SELECT app, ord, framework, n, confidence FROM p),
s AS (SELECT *, bool_or((framework IN ('Flutter', 'React Native', 'Expo') AND confidence >= 0.8) OR (framework IN ('Java', 'Kotlin') AND confidence >= 0.5)) OVER (PARTITION BY app) AS strong FROM a),
d AS (SELECT * EXCLUDE (strong) FROM s WHERE NOT (strong AND framework = 'Native (C/C++)'))"""


def detected(spark, sf: str) -> DataFrame:
    rows = entries(spark, sf)
    found = I.with_confidence(I.framework_hits(rows, "app", "entry")).select("app", "ord", "framework", F.col("n").cast("long").alias("n"), "confidence")
    return found.unionByName(I.platform_hits(rows, "app", "entry").select("app", "ord", "framework", "n", "confidence"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.bround(c, 6) for c in columns})


@query("WITH w AS (SELECT doc_id, 3 * CAST(contains(lower(text), 'the') AS INTEGER) + 5 * CAST(contains(lower(text), 'license') AS INTEGER) + 10 * CAST(contains(lower(text), 'token') AS INTEGER)"
       " + 7 * CAST(contains(lower(text), 'password') AS INTEGER) AS score FROM documents) SELECT doc_id, score, round_even(score / 25.0::DOUBLE, 6) AS confidence FROM w")  # fmt: skip
def indicator_score(spark, sf):
    return _rounded(I.weighted_score(read(spark, sf, "documents").select("doc_id", "text"), "text", WEIGHTS).drop("text"), "confidence")


_SQL_PASSAGES = "w AS (SELECT lower(substr(text, k * 9 + 1, 6)) AS pattern, max(item_id % 5 + 1) AS weight FROM benchmark, range(8) r(k) WHERE length(text) > k * 9 GROUP BY 1)"


@query(f"""WITH {_SQL_PASSAGES}, h AS (SELECT doc_id, count(pattern) AS hits, coalesce(sum(weight), 0) AS score FROM documents LEFT JOIN w ON contains(lower(text), pattern) GROUP BY doc_id)
SELECT doc_id, hits, CAST(score AS BIGINT) AS score, round_even(least(1.0::DOUBLE, score / (SELECT CAST(sum(weight) AS DOUBLE) FROM w)), 6) AS confidence FROM h""")
def indicator_table(spark, sf):
    """Hundreds of indicators out of a table: pieces of the benchmark's texts, in every document."""
    at = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    cut = read(spark, sf, "benchmark").select("item_id", "text", at).where(F.length("text") > F.col("k") * 9)
    indicators = cut.select(F.lower(F.substring("text", F.col("k") * 9 + 1, F.lit(6))).alias("pattern"), (F.col("item_id") % 5 + 1).alias("weight"))
    return _rounded(MA.table_score(read(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")), ["doc_id"], "text", indicators), "confidence")


@query(f"WITH {_SQL_HITS} SELECT app, CAST(ord AS INTEGER) AS ord, framework, n FROM h")
def framework_table(spark, sf):
    """The same frameworks as by flag columns, with the indicators as rows."""
    rows = [(k, f, i) for k, (f, own) in enumerate(I.TECHNOLOGIES.items()) for i in own]
    return MA.table_hits(entries(spark, sf), "app", "entry", spark.createDataFrame(rows, "ord int, framework string, pattern string"))


@query(f"WITH {_SQL_HITS} SELECT app, ord, framework, n, round_even({_SQL_CONFIDENCE}, 6) AS confidence FROM h")
def framework_detect(spark, sf):
    found = I.with_confidence(I.framework_hits(entries(spark, sf), "app", "entry"))
    return _rounded(found.withColumn("n", F.col("n").cast("long")), "confidence")


@query(f"WITH {_SQL_HITS} SELECT app, arg_min(framework, ord) AS framework, CASE WHEN count(*) = 1 THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS confidence, count(*) - 1 AS more FROM h GROUP BY app")
def framework_generic(spark, sf):
    return I.generic_detection(I.framework_hits(entries(spark, sf), "app", "entry"), "app")


@query(f"WITH {_SQL_HITS}, {_SQL_PLATFORM} SELECT app, ord, framework, n, round_even(confidence, 6) AS confidence FROM d")
def framework_suppress(spark, sf):
    return _rounded(I.suppressed(detected(spark, sf), "app"), "confidence")


@query(f"WITH {_SQL_HITS}, {_SQL_PLATFORM}, r AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY confidence DESC, ord) AS k FROM d) SELECT app, framework, round_even(confidence, 6) AS confidence FROM r WHERE k = 1")
def primary_framework(spark, sf):
    return _rounded(I.primary(I.suppressed(detected(spark, sf), "app"), "app"), "confidence")


@query(f"WITH {_SQL_HITS}, {_SQL_PLATFORM}, r AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY confidence DESC, ord) AS place FROM d) SELECT app, framework, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3")
def top_frameworks(spark, sf):
    return R.top_per_key(I.suppressed(detected(spark, sf), "app"), "app", "confidence", "ord", 3).select("app", "framework", "place")


@query(f"WITH {_SQL_HITS}, {_SQL_PLATFORM} SELECT CASE WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' WHEN confidence >= 0.3 THEN 'Low' ELSE 'Very Low' END AS level, count(*) AS n FROM d GROUP BY 1")
def confidence_levels(spark, sf):
    return I.suppressed(detected(spark, sf), "app").groupBy(R.confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT user_id, event_type, event_id, value FROM events)
SELECT user_id AS app, event_type AS framework, arg_max(value, event_id) AS last, max(value) AS best FROM x GROUP BY ALL""")
def confidence_map(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("app"), F.col("event_type").alias("framework"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"))
    return I.last_scores(rows, "app")


@query(f"WITH {_SQL_HITS}, x AS (SELECT DISTINCT framework FROM h UNION SELECT 'Java') SELECT framework, lower(framework) NOT IN ({', '.join(repr(u) for u in I.UNSUPPORTED)}) AS supported FROM x")
def support_gate(spark, sf):
    names = I.framework_hits(entries(spark, sf), "app", "entry").select("framework").distinct().unionByName(spark.sql("SELECT 'Java' AS framework"))
    return names.withColumn("supported", I.supported(F.col("framework")))


# rules -------------------------------------------------------------------------------------------------------------------------------


def manifests(spark, sf: str) -> DataFrame:
    """A manifest for each part, with what its key chooses."""
    k, name = F.col("p_partkey"), F.element_at(F.split("p_name", " "), 1)
    lit = F.lit
    permission = F.element_at(F.array(*[lit(p) for p in RU.DANGEROUS_PERMISSIONS]), (k % 15 + 1).cast("int"))
    xml = F.concat(
        lit('<manifest><uses-permission android:name="'), permission, lit('"/><uses-permission  android:name="app.'), name, lit('"/><application'),
        F.when(k % 2 == 0, ' android:debuggable="true"').otherwise(""), F.when(k % 3 == 0, ' android:allowBackup="true"').otherwise(""),
        F.when(k % 5 == 0, ' android:usesCleartextTraffic="true"').otherwise(""), F.when(k % 7 == 0, ' android:networkSecurityConfig="@xml/n"').otherwise(""),
        lit('><activity android:name=".'), name, lit('Activity"'), F.when(k % 4 == 0, ' android:exported="true"').when(k % 4 == 1, ' android:exported="false"').otherwise(""),
        F.when(k % 6 == 0, ' android:permission="app.P"').otherwise(""), lit("><intent-filter><action android:name=\"android.intent.action.MAIN\"/><action android:name=\"app.GO\"/></intent-filter></activity>"),
        lit('<service android:name=".Sync"/></application></manifest>'),
    )
    return read(spark, sf, "part").select(k.alias("app"), xml.alias("xml"))


_PERMISSIONS = "[" + ", ".join(f"'{p}'" for p in RU.DANGEROUS_PERMISSIONS) + "]"
_SQL_MANIFESTS = f"""k AS (SELECT p_partkey AS app, string_split(p_name, ' ')[1] AS name, {_PERMISSIONS}[CAST(p_partkey % 15 + 1 AS INTEGER)] AS permission,
 CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS exported, CASE WHEN p_partkey % 6 = 0 THEN 'app.P' END AS guard FROM part)"""


@query(f"""WITH {_SQL_MANIFESTS} SELECT app, array_to_string(list_sort(list_filter([permission, 'app.' || name, guard], lambda x: x IS NOT NULL)), ',') AS permissions FROM k""")
def permissions(spark, sf):
    return manifests(spark, sf).select("app", F.array_join(RU.permissions(F.col("xml")), ",").alias("permissions"))


@query(f"WITH {_SQL_MANIFESTS} SELECT app, permission FROM k")
def dangerous_permissions(spark, sf):
    asked = manifests(spark, sf).select("app", F.explode(RU.permissions(F.col("xml"))).alias("permission"))
    return asked.where(RU.dangerous(F.col("permission")))


@query("SELECT p_partkey AS app, p_partkey % 2 = 0 AS debuggable, p_partkey % 3 = 0 AS allow_backup, p_partkey % 5 = 0 AS cleartext, p_partkey % 7 = 0 AS network_config, false AS test_only FROM part")
def manifest_flags(spark, sf):
    return manifests(spark, sf).select("app", *[c.alias(n) for n, c in RU.manifest_flags(F.col("xml")).items()])


@query(f"""WITH {_SQL_MANIFESTS} SELECT app, 'activity' AS kind, '.' || name || 'Activity' AS name, coalesce(exported, '-') AS exported, coalesce(guard, '-') AS permission, coalesce(exported = 'true', true) AS reachable,
 'GO' AS actions FROM k UNION ALL SELECT app, 'service', '.Sync', '-', '-', false, '' FROM k""")
def xml_components(spark, sf):
    found = RU.components(manifests(spark, sf), "app")
    return found.select(
        "app", "kind", "name", F.coalesce("exported", F.lit("-")).alias("exported"), F.coalesce("permission", F.lit("-")).alias("permission"),
        RU.is_exported(F.col("exported"), F.col("has_filter")).alias("reachable"), F.array_join(RU.action_names(F.col("actions")), ",").alias("actions"),
    )


@query(f"""WITH {_SQL_MANIFESTS} SELECT app, 'dangerous_permission' AS rule, 'MEDIUM' AS severity, permission AS of FROM k
 UNION ALL SELECT app, 'exported_component', 'MEDIUM', '.' || name || 'Activity' FROM k WHERE exported = 'true' AND guard IS NULL UNION ALL SELECT app, 'debuggable', 'HIGH', '' FROM k WHERE app % 2 = 0
 UNION ALL SELECT app, 'backup', 'LOW', '' FROM k WHERE app % 3 = 0 UNION ALL SELECT app, 'cleartext', 'HIGH', '' FROM k WHERE app % 5 = 0 UNION ALL SELECT app, 'no_network_config', 'MEDIUM', '' FROM k WHERE app % 7 <> 0""")
def manifest_rules(spark, sf):
    xml = manifests(spark, sf)
    opened = RU.components(xml, "app").where((F.col("exported") == "true") & F.col("permission").isNull() & (F.col("kind") == "activity"))
    opened = opened.groupBy("app").agg(F.array_sort(F.collect_set("name")).alias("exported"))
    apps = xml.select("app", RU.permissions(F.col("xml")).alias("permissions"), *[c.alias(n) for n, c in RU.manifest_flags(F.col("xml")).items()])
    apps = apps.join(opened, "app", "left").withColumn("exported", F.coalesce("exported", F.expr("array()").cast("array<string>")))
    return RU.manifest_issues(apps, "app")


@query("""
WITH v AS (SELECT p_brand AS app, p_size AS name, arg_min(p_name, p_partkey) AS value FROM part GROUP BY p_brand, p_size), r AS (SELECT p_partkey, p_brand AS app, CASE WHEN p_size > 25 THEN '@string/' || (p_size - 7) ELSE p_name END AS ref FROM part)
SELECT p_partkey, r.app, ref, coalesce(v.value, ref) AS resolved FROM r LEFT JOIN v ON v.app = r.app AND '@string/' || v.name = r.ref""")
def resolve_string_ref(spark, sf):
    """Brands stand for apps, which give the same names (sizes) their own values."""
    part = read(spark, sf, "part").withColumn("app", F.col("p_brand"))
    ref = F.when(F.col("p_size") > 25, F.concat(F.lit("@string/"), (F.col("p_size") - 7).cast("string"))).otherwise(F.col("p_name"))
    values = part.select("app", F.col("p_size").cast("string").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("value"))
    return RU.resolved(part.select("p_partkey", "app", ref.alias("ref")), values, "app")


def app_manifests(spark, sf: str) -> DataFrame:
    """A manifest for each page, with its host, address and paragraphs in it. One in four is cut off before its end."""
    k, host = F.col("page_id"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    said = T.html_escaped(F.col("url"))
    n = F.regexp_count("html", F.lit("<p"))
    whole = F.concat(
        F.lit("<?xml version='1.0'?>\n<!-- <activity android:name=\"Hidden\"/> --><manifest xmlns:android='http://schemas.android.com/apk/res/android' xmlns:t=\"urn:t\" package='"), host,
        F.lit("' android:versionCode='"), F.length("html").cast("string"), F.lit("' android:versionName=\"v"), n.cast("string"), F.lit('"><uses-sdk android:minSdkVersion="'), (n % 30).cast("string"),
        F.lit('" android:targetSdkVersion="'), F.when(n % 2 == 0, "S").otherwise("31"), F.lit('"/><application android:label="'), said, F.lit('"><activity android:name=".'), said,
        F.lit("Activity\" android:enabled='false' t:exported='true'><intent-filter><action android:name='a.MAIN'/><category android:name='c'/><data android:scheme='x'/></intent-filter></activity>"),
        F.lit("<![CDATA[<service android:name='no'/>]]><activity-alias android:name=\".Alias\"/><service android:name='.S&amp;T' android:exported='true' android:permission=\"p>q\"/><receiver/>"),
        F.repeat(F.lit("<provider android:name='.P'></provider>"), (n % 4).cast("int")),
    )
    xml = F.when(k % 4 == 0, whole).otherwise(F.concat(whole, F.lit("</application></manifest>")))
    return read(spark, sf, "pages").select(k.alias("app"), xml.alias("xml"))


_SQL_APPS = r"""k AS (SELECT page_id AS app, url, page_id % 4 <> 0 AS parsed, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, length(html) AS size, CAST(len(regexp_extract_all(html, '<p')) AS BIGINT) AS n,
 replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS raw FROM pages)"""


@query(rf"""WITH {_SQL_APPS} SELECT app, parsed, CASE WHEN parsed THEN host ELSE '-' END AS package, CASE WHEN parsed THEN size ELSE -1 END AS version_code, CASE WHEN parsed THEN 'v' || n ELSE '-' END AS version_name,
 CASE WHEN parsed THEN n % 30 ELSE -1 END AS min_sdk, CASE WHEN parsed AND n % 2 = 1 THEN 31 ELSE -1 END AS target_sdk, CASE WHEN NOT parsed THEN '-' WHEN n % 2 = 0 THEN 'S' ELSE '31' END AS target_sdk_text,
 CASE WHEN parsed THEN url ELSE '-' END AS label, '.' || CASE WHEN parsed THEN url ELSE raw END || 'Activity' AS activities, CASE WHEN parsed THEN '.S&T' ELSE '.S&amp;T' END AS services, '' AS receivers,
 array_to_string(list_transform(range(n % 4), lambda x: '.P'), ',') AS providers FROM k""")
def manifest_info(spark, sf):
    info = M.app_info(M.manifests(app_manifests(spark, sf), ["app"]), ["app"])
    text = [F.coalesce(c, F.lit("-")).alias(c) for c in ("package", "version_name", "target_sdk_text", "label")]
    numbers = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("version_code", "min_sdk", "target_sdk")]
    return info.select("app", "parsed", *text, *numbers, *[F.array_join(p, ",").alias(p) for p in M.PLURALS.values()])


@query(rf"WITH {_SQL_APPS} SELECT app, 1 AS activities, 1 AS services, 0 AS receivers, CAST(n % 4 AS INTEGER) AS providers, CAST(2 + n % 4 AS INTEGER) AS total FROM k")
def component_counts(spark, sf):
    return M.component_counts(M.app_info(M.manifests(app_manifests(spark, sf), ["app"]), ["app"]), ["app"])


@query(rf"""WITH {_SQL_APPS} SELECT app, '.' || url || 'Activity' AS name, 'false' AS exported, 'false' AS enabled, '' AS permission, true AS has_intent_filters FROM k WHERE parsed
 UNION ALL SELECT app, '.' || raw || 'Activity', 'unknown', 'unknown', '', false FROM k WHERE NOT parsed""")
def activity_details(spark, sf):
    files = app_manifests(spark, sf)
    return M.activity_details(M.manifests(files, ["app", "xml"]), ["app"], F.col("xml"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN string_split(p_name, ' ')[1] ELSE '-' END AS kept FROM part")
def strings_xml_filter(spark, sf):
    name = F.element_at(F.split("p_name", " "), 1)
    xml = F.concat(F.lit('<resources><string name="abc_x">a</string>'), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('<string  name="'), name, F.lit('">b</string>'))).otherwise(""), F.lit("</resources>"))
    return read(spark, sf, "part").select("p_partkey", F.coalesce(F.array_join(RU.kept_strings(xml), ","), F.lit("-")).alias("kept"))


@query("""SELECT doc_id, lang = 'fr' OR regexp_matches(lower(text), 'login|log in|sign in|signin|username|password|email|phone') AS login FROM documents""")
def login_screen(spark, sf):
    """Screens whose texts, descriptions or hints are whole documents; words in other attributes don't count."""
    said, k = T.html_escaped(F.col("text")), F.col("doc_id") % 3
    where = F.when(k == 0, F.lit('text="')).when(k == 1, F.lit('content-desc="')).otherwise(F.lit('hint="'))
    secret = F.when(F.col("lang") == "fr", '" password="true').otherwise("")
    screen = F.concat(F.lit('<node bounds="login" '), where, said, secret, F.lit('"/>'))
    return read(spark, sf, "documents").select("doc_id", RU.login_screen(screen).alias("login"))


# inventories ----------------------------------------------------------------------------------------------------------------------------


@query(rf"""WITH {PATHS_SQL} SELECT app, count(*) FILTER (regexp_matches(path, '\.java$')) AS java, count(*) FILTER (regexp_matches(path, '\.kt$')) AS kotlin, count(*) FILTER (regexp_matches(path, '\.xml$')) AS xml,
 count(*) FILTER (regexp_matches(path, '\.so$')) AS libs, bool_or(path LIKE '%AndroidManifest.xml') AS manifest, count(*) AS total FROM p GROUP BY app""")
def app_inventory(spark, sf):
    ends = lambda e: F.count_if(F.col("path").endswith(e))
    return paths(spark, sf).groupBy("app").agg(
        ends(".java").alias("java"), ends(".kt").alias("kotlin"), ends(".xml").alias("xml"), ends(".so").alias("libs"),
        F.bool_or(F.col("path").endswith("AndroidManifest.xml")).alias("manifest"), F.count("*").alias("total"),
    )


@query(f"WITH {PATHS_SQL} SELECT app, CAST(sum(size) AS BIGINT) AS size, count(*) AS files, sum(size) > 20000 AS large FROM p GROUP BY app")
def dir_sizes(spark, sf):
    total = F.sum("size")
    return paths(spark, sf).groupBy("app").agg(total.alias("size"), F.count("*").alias("files"), (total > 20000).alias("large"))


@query("""
WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' ERROR - ' || n_chars || ' of' WHEN 1 THEN ' ERROR x ERROR' ELSE '' END || text AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, 'ERROR - (\\d+)') THEN CAST(regexp_extract(t, 'ERROR - (\\d+)', 1) AS BIGINT) ELSE CAST(len(regexp_extract_all(t, 'ERROR')) AS BIGINT) END AS errors FROM t""")
def error_count(spark, sf):
    k = F.col("doc_id") % 3
    more = F.when(k == 0, F.concat(F.lit(" ERROR - "), F.col("n_chars").cast("string"), F.lit(" of"))).when(k == 1, " ERROR x ERROR").otherwise("")
    return read(spark, sf, "documents").select("doc_id", T.error_count(F.concat("text", more, "text")).alias("errors"))


@query(rf"""WITH {PATHS_SQL}, d AS (SELECT app, regexp_replace(path, '/[^/]*$', '') AS dir, page_id FROM p WHERE regexp_matches(path, '\.(java|kt)$')),
r AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY len(string_split(dir, '/')) DESC, dir, page_id) AS k FROM d) SELECT app, replace(regexp_replace(dir, '^sources/', ''), '/', '.') AS package FROM r WHERE k = 1""")
def deepest_package(spark, sf):
    rows = paths(spark, sf).where(F.col("path").rlike(r"\.(java|kt)$")).select("app", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    best = rows.groupBy("app").agg(F.min(F.struct((-F.size(F.split("dir", "/"))).alias("depth"), "dir")).alias("b"))
    return best.select("app", F.replace(F.regexp_replace("b.dir", "^sources/", ""), F.lit("/"), F.lit(".")).alias("package"))


@query(r"""SELECT p_partkey, array_to_string(list_filter(string_split(p_name || ' MainActivity Splash' || p_size, ' '), lambda x: regexp_matches(lower(x), 'main|launcher|splash')), ',') AS guess,
 p_size || ' (' || p_brand || ')' AS version FROM part""")
def main_activity_guess(spark, sf):
    size = F.col("p_size").cast("string")
    names = F.split(F.concat("p_name", F.lit(" MainActivity Splash"), size), " ")
    guess = F.array_join(F.filter(names, lambda x: F.lower(x).rlike("main|launcher|splash")), ",")
    return read(spark, sf, "part").select("p_partkey", guess.alias("guess"), F.concat(size, F.lit(" ("), "p_brand", F.lit(")")).alias("version"))


@query("""
WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'arm64-v8a' WHEN 1 THEN 'armeabi-v7a' WHEN 2 THEN 'x86_64' WHEN 3 THEN 'x86' ELSE 'mips' END AS abi,
 'const-string v0, "a "' || p_brand || '" z"' AS ins, 'import x; package com.' || replace(lower(p_brand), '#', '') || CASE WHEN p_partkey % 2 = 0 THEN ';' ELSE '' END AS src FROM part)
SELECT p_partkey, CASE WHEN abi LIKE 'arm64%' THEN 'arm64' WHEN abi LIKE 'armeabi%' THEN 'arm' WHEN abi = 'mips' THEN '-' ELSE abi END AS arch, regexp_extract(ins, '"(.*)"', 1) AS literal,
 CASE WHEN p_partkey % 2 = 0 THEN regexp_extract(src, 'package\\s+([a-zA-Z_][\\w.]*)\\s*;', 1) ELSE '-' END AS package FROM x""")
def source_facts(spark, sf):
    k = F.col("p_partkey")
    abi = F.when(k % 5 == 0, "arm64-v8a").when(k % 5 == 1, "armeabi-v7a").when(k % 5 == 2, "x86_64").when(k % 5 == 3, "x86").otherwise("mips")
    ins = F.concat(F.lit('const-string v0, "a "'), "p_brand", F.lit('" z"'))
    src = F.concat(F.lit("import x; package com."), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.when(k % 2 == 0, ";").otherwise(""))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return read(spark, sf, "part").select("p_partkey", dash(T.architecture(abi)).alias("arch"), T.quoted_literal(ins).alias("literal"), dash(T.package_of_source(src)).alias("package"))
