"""Queries over source text: documents and pages stand for source files, page URLs for paths, parts for resource strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.operators import context as C
from auditlake.operators import graph as G
from auditlake.operators import highlight as H
from auditlake.operators import rules as RU
from auditlake.operators import symbols as SY
from auditlake.plans.registry import query, read
from auditlake.sources import files as SF


def documents(spark, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")


_LINES = "l AS (SELECT doc_id AS path, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))"


@query(f"WITH {_LINES} SELECT path, CAST(line_no AS INTEGER) AS line_no, left(trim(line), 200) AS line FROM l WHERE regexp_matches(line, '(?i)license|secret|token')")
def grep_lines(spark, sf):
    return C.grep(documents(spark, sf), "license|secret|token", scoped=True)


@query(f"""WITH {_LINES}, f AS (SELECT path, CAST(line_no AS INTEGER) AS line_no, left(trim(line), 200) AS line FROM l WHERE contains(lower(line), 'e t') ORDER BY path, line_no LIMIT 60)
SELECT * FROM f UNION ALL SELECT -1, -1, '... (stopped at 60 matches)' FROM f HAVING count(*) >= 60""")
def grep_first_60(spark, sf):
    """The row that says where it stopped has neither path nor line, here -1."""
    return C.first_matches(C.grep(documents(spark, sf), "e t", scoped=True)).fillna(-1, ["path", "line_no"])


@query(rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '{T.SECRET_PATTERN}', 1) AS f FROM documents WHERE regexp_matches(text, '{T.SECRET_PATTERN}'))
SELECT doc_id, len(f) AS n, left(f[1], 60) AS first FROM s""")
def secret_scan(spark, sf):
    """Texts with hits, found in one pass: the filter stands between the hits and the row that they make."""
    hits = F.regexp_extract_all("text", F.lit(T.SECRET_PATTERN), F.lit(1))
    found = read(spark, sf, "documents").select("doc_id", F.explode(F.filter(F.array(hits), lambda f: F.size(f) > 0)).alias("f"))
    return found.select("doc_id", F.size("f").cast("long").alias("n"), F.left(F.element_at("f", 1), F.lit(60)).alias("first"))


@query(rf"""WITH h AS (SELECT doc_id, list_filter(list_concat(string_split(text, chr(10)), string_split(text, chr(10))), lambda x: regexp_matches(x, '{T.SECRET_PATTERN}')) AS h FROM documents),
k AS (SELECT doc_id, list_transform(list_filter(list_transform(h, lambda x, i: {{'x': x, 'i': i}}), lambda s: length(s.x) > 60 OR list_position(list_transform(h, lambda y: left(y, 60)), s.x) = s.i), lambda s: left(s.x, 60)) AS k FROM h)
SELECT doc_id, len(k) AS n, md5(array_to_string(k, chr(10))) AS kept FROM k WHERE len(k) > 0""")
def secret_strings(spark, sf):
    """Lines of a text, each of them twice, as the constants of a class."""
    own = F.split("text", "\n")
    kept = read(spark, sf, "documents").select("doc_id", G.secret_strings(F.concat(own, own)).alias("k")).where(F.size("k") > 0)
    return kept.select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", "\n").cast("binary")).alias("kept"))


_TOKENS = """t AS (SELECT p_partkey, i, CASE p_partkey % 9 WHEN 0 THEN 'abc_' || w WHEN 1 THEN 'android.' || w WHEN 2 THEN 'main' WHEN 3 THEN '@string/' || w WHEN 4 THEN p_partkey::VARCHAR
 WHEN 5 THEN 'deadbeef01' WHEN 6 THEN ' ' WHEN 7 THEN '${' || w || '}' ELSE w END AS name FROM (SELECT p_partkey, unnest(range(0, len(s))) AS i, unnest(s) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS s FROM part)))"""


def resource_names(spark, sf: str) -> DataFrame:
    words = read(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    k, w = F.col("p_partkey") % 9, F.col("w")
    name = F.when(k == 0, F.concat(F.lit("abc_"), w)).when(k == 1, F.concat(F.lit("android."), w)).when(k == 2, "main").when(k == 3, F.concat(F.lit("@string/"), w))
    name = name.when(k == 4, F.col("p_partkey").cast("string")).when(k == 5, "deadbeef01").when(k == 6, " ").when(k == 7, F.concat(F.lit("${"), w, F.lit("}")))
    return words.select("p_partkey", F.col("i").cast("long").alias("i"), name.otherwise(w).alias("name"))


_QUOTED_PREFIXES = "|".join(p.replace(".", "\\.") for p in T.STRING_PREFIXES)
_QUOTED_NAMES = ", ".join(f"'{n}'" for n in T.STRING_NAMES)


@query(rf"""WITH {_TOKENS} SELECT p_partkey, i, name, trim(name) <> '' AND trim(name) NOT IN ({_QUOTED_NAMES}) AND NOT regexp_matches(trim(name), '^({_QUOTED_PREFIXES})')
 AND NOT regexp_matches(trim(name), '{T.STRING_PATTERN}') AS own FROM t""")
def user_string_filter(spark, sf):
    return resource_names(spark, sf).withColumn("own", T.user_defined(F.col("name")))


def paths(spark, sf: str) -> DataFrame:
    """A path in a decompiled package for each page, from its URL."""
    k = F.col("page_id") % 12
    leaf = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    shapes = [
        F.concat(F.lit("sources/com/shop/"), name, F.lit(".java")),
        F.concat(F.lit("sources/androidx/core/"), name, F.lit(".kt")),
        F.concat(F.lit("res/layout/abc_"), name, F.lit(".xml")),
        F.concat(F.lit("res/values-de/"), leaf, F.lit(".xml")),
        F.lit("resources/AndroidManifest.xml"),
        F.lit("resources/res/values/strings.xml"),
        F.concat(F.lit("res/layout/"), name, F.lit(".xml")),
        F.concat(F.lit("res/xml/"), F.when(F.col("page_id") % 24 == 7, F.lit("backup_rules")).otherwise(name), F.lit(".xml")),
        F.concat(F.lit("lib/arm64-v8a/lib"), (F.col("page_id") % 36).cast("string"), F.lit(".so")),
        F.concat(F.lit("sources/com/shop/R$"), name, F.lit(".java")),
        F.concat(F.lit("res/raw/"), leaf, F.lit(".bin")),
        F.concat(F.lit("sources/org/bank/"), name, F.lit(".kt")),
    ]
    path = F.element_at(F.array(*shapes), (k + 1).cast("int"))
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return read(spark, sf, "pages").select("page_id", host.alias("app"), path.alias("path"), F.length("html").cast("long").alias("size"), "html")


PATHS_SQL = r"""p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS app, length(html) AS size, html, CASE page_id % 12
 WHEN 0 THEN 'sources/com/shop/p' || page_id || '.java' WHEN 1 THEN 'sources/androidx/core/p' || page_id || '.kt' WHEN 2 THEN 'res/layout/abc_p' || page_id || '.xml'
 WHEN 3 THEN 'res/values-de/' || regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) || '.xml' WHEN 4 THEN 'resources/AndroidManifest.xml' WHEN 5 THEN 'resources/res/values/strings.xml'
 WHEN 6 THEN 'res/layout/p' || page_id || '.xml' WHEN 7 THEN 'res/xml/' || CASE WHEN page_id % 24 = 7 THEN 'backup_rules' ELSE 'p' || page_id END || '.xml'
 WHEN 8 THEN 'lib/arm64-v8a/lib' || page_id % 36 || '.so' WHEN 9 THEN 'sources/com/shop/R$p' || page_id || '.java'
 WHEN 10 THEN 'res/raw/' || regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) || '.bin' ELSE 'sources/org/bank/p' || page_id || '.kt' END AS path FROM pages)"""
_BUNDLED = rf"""(regexp_matches('/' || path, '{"|".join(T.BUNDLED_FRAGMENTS)}') OR regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{T.BUNDLED_LAYOUTS}')
 OR regexp_matches(path, '{T.QUALIFIED_RESOURCE}'))"""


@query(f"WITH {PATHS_SQL} SELECT page_id, path, {_BUNDLED} AS bundled FROM p")
def framework_path_filter(spark, sf):
    return paths(spark, sf).select("page_id", "path", T.bundled_path(F.col("path")).alias("bundled"))


@query(f"WITH {PATHS_SQL}, d AS (SELECT DISTINCT path FROM p), n AS (SELECT count(*) AS c FROM d) SELECT path, greatest(c - 200, 0) AS more FROM d, n ORDER BY path LIMIT 200")
def file_listing(spark, sf):
    return SF.listing(paths(spark, sf).select("path").distinct(), "path")


@query(f"WITH {PATHS_SQL}, d AS (SELECT DISTINCT path FROM p) SELECT path, {_BUNDLED} AS bundled, (SELECT greatest(count(*) - 400, 0) FROM d) AS more FROM d ORDER BY bundled, path LIMIT 400")
def file_tree(spark, sf):
    return SF.tree(paths(spark, sf).select("path").distinct(), "path")


@query(f"""WITH {PATHS_SQL} SELECT page_id, path, CASE WHEN path LIKE '%AndroidManifest.xml' THEN 'manifest' WHEN path LIKE '%res/values/strings.xml' THEN 'strings'
 WHEN regexp_matches(path, '(^|/)res/layout/[^/]+\\.xml$') THEN 'layout' WHEN path LIKE '%res/xml/backup_rules.xml' THEN 'backup_rules' WHEN regexp_matches(path, '\\.(java|kt)$') THEN 'source' END AS bucket FROM p""")
def bucket_files(spark, sf):
    return paths(spark, sf).select("page_id", "path", SF.bucket_of(F.col("path")).alias("bucket"))


@query(f"WITH {PATHS_SQL} SELECT page_id, path FROM p WHERE regexp_matches(path, '\\.(java|kt)$') AND NOT {_BUNDLED} AND NOT regexp_matches(path, '/(R|BuildConfig)\\.[^.]*$|/R\\$[^/]*$')")
def app_source_select(spark, sf):
    return SF.app_sources(paths(spark, sf).where(F.col("path").rlike(r"\.(java|kt)$")).select("page_id", "path"), "path")


@query(f"WITH {PATHS_SQL} SELECT page_id, path, size FROM p WHERE regexp_matches(path, '(^|/)res/(xml|raw)/[^/]+$|(^|/)res/values/strings\\.xml$')")
def resource_pick(spark, sf):
    return SF.resource_files(paths(spark, sf), "path").select("page_id", "path", "size")


@query(rf"""WITH {PATHS_SQL} SELECT page_id, NOT path LIKE '%R.java' AND NOT {_BUNDLED} AND NOT (length(html) < 500 AND NOT contains(html, 'class ')) AS keep,
 coalesce(CASE WHEN path LIKE '%.java' OR path LIKE '%.kt' THEN regexp_matches('L' || regexp_replace(regexp_replace(path, '^sources/', ''), '\.[a-z]+$', '') || ';', '^L')
 AND NOT regexp_matches('L' || regexp_replace(path, '^sources/', ''), '^(Landroid/|Landroidx/|Lkotlin/|Lorg/json/)') AND NOT regexp_matches(path, '/(R|BuildConfig)(\$|\.)') END, false) AS own_class FROM p""")
def class_selection(spark, sf):
    rows = paths(spark, sf)
    descriptor = F.concat(F.lit("L"), F.regexp_replace(F.regexp_replace("path", "^sources/", ""), r"\.[a-z]+$", ""), F.lit(";"))
    keep = SF.worth_reading(F.col("path"), F.col("html"))
    return rows.select("page_id", keep.alias("keep"), (F.col("path").rlike(r"\.(java|kt)$") & T.app_class(descriptor)).alias("own_class"))


@query(rf"""WITH {PATHS_SQL}, s AS (SELECT app, page_id, path, CASE page_id % 3 WHEN 0 THEN 'out/' ELSE 'x/y/' END || CASE WHEN path LIKE 'sources/com/%' AND app < 'm' THEN replace(path, 'com/shop', 'com/google') ELSE path END AS file, html FROM p WHERE path LIKE 'sources/%'),
f AS (SELECT *, regexp_extract(file, '(?:^|/)sources/(.*)$', 1) AS under FROM s), o AS (SELECT *, regexp_matches(under, '^[^/]+/') AND NOT regexp_matches(under, '^(androidx|android|kotlin|kotlinx|com|org)/')
 OR regexp_matches(under, '^com/[^/]+/') AND NOT regexp_matches(under, '^com/(google|android)/') OR regexp_matches(under, '^org/[^/]+/') AND NOT regexp_matches(under, '^org/(jetbrains|intellij|apache|junit)/') AS own FROM f),
a AS (SELECT *, bool_or(own) OVER (PARTITION BY app) AS any_own FROM o) SELECT app, page_id, file, own FROM a WHERE (own OR NOT any_own)""")
def app_folders(spark, sf):
    """Files below the folders of the app's own packages; of apps without any, all sources."""
    rows = paths(spark, sf).where(F.col("path").startswith("sources/"))
    shop = F.when(F.col("path").startswith("sources/com/") & (F.col("app") < "m"), F.replace("path", F.lit("com/shop"), F.lit("com/google"))).otherwise(F.col("path"))
    file = F.concat(F.when(F.col("page_id") % 3 == 0, "out/").otherwise("x/y/"), shop)
    found = SF.app_folders(rows.select("app", "page_id", file.alias("file")), "app", "file")
    return found.select("app", "page_id", "file", SF.own_folder(F.col("file")).alias("own"))


_WORDS = "|".join(RU.MANIFEST_WORDS)


@query(rf"""SELECT page_id, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(chr(1) || 'android:name' || chr(2) || 'tag' || chr(3) || html || chr(0) || url, '[\x20-\x7e]{{4,}}'), lambda x: regexp_matches(lower(x), '{_WORDS}')))), chr(10))) AS found FROM pages""")
def printable_strings(spark, sf):
    """Of the bytes of each page, between others that don't print."""
    content = F.concat(F.lit("\x01android:name\x02tag\x03"), "html", F.lit("\x00"), "url").cast("binary")
    found = RU.printable_strings(content)
    return read(spark, sf, "pages").select("page_id", F.md5(F.array_join(found, "\n").cast("binary")).alias("found"))


def spans(spark, sf: str) -> DataFrame:
    """Two spans of lines in each document, some past its end and some with their ends swapped."""
    k = F.col("doc_id")
    one = F.struct((k % 5 + 1).cast("int").alias("s"), (k % 7 + 1).cast("int").alias("e"))
    two = F.struct((k % 40 + 1).cast("int").alias("s"), (k % 40 + 1).cast("int").alias("e"))
    return read(spark, sf, "documents").select(k.alias("path"), F.explode(F.array(one, two)).alias("p")).select("path", "p.*")


@query("""
WITH d AS (SELECT doc_id AS path, string_split(text, chr(10)) AS a FROM documents), p AS (SELECT doc_id AS path, doc_id % 5 + 1 AS s, doc_id % 7 + 1 AS e FROM documents
 UNION ALL SELECT doc_id, doc_id % 40 + 1, doc_id % 40 + 1 FROM documents),
x AS (SELECT path, s, e, a, greatest(1, least(least(s, e), len(a)) - 4) AS b, least(len(a), greatest(s, e) + 4) AS z FROM p JOIN d USING (path))
SELECT path, CAST(s AS INTEGER) AS s, CAST(e AS INTEGER) AS e, CAST(b AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line, md5(array_to_string(a[b:z], chr(10))) AS lines FROM x""")
def code_context(spark, sf):
    found = C.context(documents(spark, sf), spans(spark, sf), "path")
    return found.withColumn("lines", F.md5(F.array_join("lines", "\n").cast("binary")))


@query(f"""
WITH {_LINES}, s AS (SELECT path, line AS snippet FROM l WHERE line_no = 2 AND length(trim(line)) >= 6), f AS (SELECT s.path, s.snippet, min(l.line_no) AS first_line FROM s JOIN l USING (path)
 WHERE contains(l.line, trim(s.snippet)) GROUP BY ALL) SELECT path, md5(snippet) AS snippet, CAST(first_line AS INTEGER) AS first_line, CAST(first_line AS INTEGER) AS last_line FROM f""")
def snippet_locate(spark, sf):
    files = documents(spark, sf)
    second = F.try_element_at(F.split("text", "\n"), F.lit(2))
    wanted = files.select("path", second.alias("snippet")).where(F.length(F.trim("snippet")) >= 6)
    return C.locate(files, wanted, "path").withColumn("snippet", F.md5(F.col("snippet").cast("binary")))


@query(f"""
WITH RECURSIVE {_LINES}, n AS (SELECT path, line_no, length(line) + 1 AS size, max(line_no) OVER (PARTITION BY path) AS total FROM l),
w AS (SELECT path, line_no, total, size AS used, CAST(1 AS BIGINT) AS page FROM n WHERE line_no = 1
 UNION ALL SELECT n.path, n.line_no, n.total, CASE WHEN w.used + n.size > 2000 THEN n.size ELSE w.used + n.size END, CASE WHEN w.used + n.size > 2000 THEN w.page + 1 ELSE w.page END
 FROM w JOIN n ON n.path = w.path AND n.line_no = w.line_no + 1)
SELECT path, CAST(page AS INTEGER) AS page, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line FROM w GROUP BY path, page""")
def paged_read(spark, sf):
    return C.pages(documents(spark, sf), "path", 2000)


@query(f"""WITH s AS (SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.java' END AS path, doc_id, string_split('/* ' || replace(text, '*/', '* /') || ' */' || chr(10) || 'int x = ' || doc_id || ';', chr(10)) AS a FROM documents),
l AS (SELECT path, doc_id, len(a) AS n, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM s), e AS (SELECT *, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM l)
SELECT path, CAST(line_no AS INTEGER) AS line_no, md5(CASE WHEN path LIKE '%.txt' OR safe = '' THEN safe WHEN line_no < n THEN '<span class="tok-cm">' || safe || '</span>'
 ELSE '<span class="tok-kw">int</span> x <span class="tok-op">=</span> <span class="tok-num">' || doc_id || '</span><span class="tok-op">;</span>' END) AS html FROM e""")
def code_highlight(spark, sf):
    """Texts as comments of many lines before a line of code; every third file is of no known kind."""
    k = F.col("doc_id")
    source = F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("* /")), F.lit(" */\nint x = "), k.cast("string"), F.lit(";"))
    name = F.concat(k.cast("string"), F.when(k % 3 == 0, ".txt").otherwise(".java"))
    found = H.highlighted_lines(read(spark, sf, "documents").select(name.alias("path"), source.alias("text")))
    return found.select("path", "line_no", F.md5(F.col("html").cast("binary")).alias("html"))


@query(r"""WITH c AS (SELECT p_brand AS file, p_partkey AS line_no, p_partkey % 5 AS k, p_name, p_size, lower(string_split(p_name, ' ')[1]) AS word FROM part),
h AS (SELECT *, max(CASE WHEN k = 0 THEN line_no END) OVER (PARTITION BY file ORDER BY line_no) AS at FROM c), o AS (SELECT h.*, 'lib/' || x.p_size || '.so' AS library FROM h LEFT JOIN part x ON x.p_partkey = h.at)
SELECT file, line_no, coalesce(library, '-') AS library, CASE WHEN k = 1 THEN '*UND*' ELSE '.text' END AS section, CASE WHEN k = 1 THEN 'imported' ELSE 'exported' END AS kind,
 CASE k WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'strcpy' ELSE 'malloc' END WHEN 2 THEN 'Java_com_app_' || word || '_1x_run' || p_size || '_000e9__ILjava_lang_String_2' ELSE 'helper_' || word END AS symbol,
 CASE WHEN k = 2 THEN 'com.app.' || word || '_x' ELSE '-' END AS class, CASE WHEN k = 2 THEN 'run' || p_size || 'é' ELSE '-' END AS method, k = 1 AND p_size % 2 = 0 AS unsafe FROM o WHERE k IN (1, 2, 3)""")
def symbol_listing(spark, sf):
    """Brands stand for captured listings, their parts for the lines: headers, imported and exported symbols, and lines that are none."""
    k, size, word = F.col("p_partkey") % 5, F.col("p_size").cast("string"), F.lower(F.element_at(F.split("p_name", " "), 1))
    line = F.when(k == 0, F.concat(F.lit("lib/"), size, F.lit(".so:     file format elf64-littleaarch64")))
    line = line.when(k == 1, F.concat(F.lit("0000000000000000      DF *UND*\t0000000000000000  LIBC        "), F.when(F.col("p_size") % 2 == 0, "strcpy").otherwise("malloc")))
    line = line.when(k == 2, F.concat(F.lit("00000000000007a0 g    DF .text\t0000000000000050  Base        Java_com_app_"), word, F.lit("_1x_run"), size, F.lit("_000e9__ILjava_lang_String_2")))
    line = line.when(k == 3, F.concat(F.lit("00000000000007a0 g    DF .text\t0000000000000050  Base        helper_"), word)).otherwise("DYNAMIC SYMBOL TABLE:")
    found = SY.symbols(read(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line_no"), line.alias("line")))
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return found.select("file", "line_no", dash("library"), "section", "kind", "symbol", dash("class"), dash("method"), "unsafe")


@query(f"WITH {_LINES} SELECT path, CAST(line_no AS INTEGER) AS line_no, line_no BETWEEN path % 3 + 1 AND path % 3 + 3 AS highlight FROM l")
def highlight_rows(spark, sf):
    files = documents(spark, sf)
    spot = files.select("path", (F.col("path") % 3 + 1).alias("s"), (F.col("path") % 3 + 3).alias("e"))
    return C.highlighted(C.lines(files), spot, "path").drop("line")


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html || ' see ' || url, 'https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+'))), ' ') AS urls FROM pages""")
def extract_urls(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(T.urls(F.concat("html", F.lit(" see "), "url")), " ").alias("urls"))


@query(r"""
WITH t AS (SELECT doc_id, 'x' || chr(10) || '```java' || chr(10) || '  ' || text || chr(10) || '```' || chr(10) || 'y ```' || chr(10) || '  ' || chr(10) || '```' AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(t, '(?s)```(?:\w+)?\n(.*?)```', 1), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> ''), '|') AS blocks FROM t""")
def code_blocks(spark, sf):
    text = F.concat(F.lit("x\n```java\n  "), F.col("text"), F.lit("\n```\ny ```\n  \n```"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(T.code_blocks(text), "|").alias("blocks"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(chr(1) || text || chr(9), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.collapsed(F.concat(F.lit("\x01"), "text", F.lit("\t"))).alias("clean"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS short, CASE WHEN text = '' THEN 0 ELSE CAST(len(string_split(text, chr(10))) AS INTEGER) END AS n FROM documents")
def truncate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.truncated(F.col("text"), 100).alias("short"), T.line_count(F.col("text")).alias("n"))


@query(rf"""WITH {PATHS_SQL} SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS class, 'sources/' || regexp_replace(path, '\$.*$', '') || '.java' AS source,
 regexp_replace(CASE WHEN page_id % 2 = 0 THEN '../' || path ELSE './' || path END, '^[./]+', '') AS plain FROM p""")
def class_name(spark, sf):
    descriptor = F.concat(F.lit("L"), "path", F.lit(";"))
    dotted = F.concat(F.when(F.col("page_id") % 2 == 0, "..\\").otherwise("./"), F.col("path"))
    return paths(spark, sf).select("page_id", T.class_name(descriptor).alias("class"), T.source_path(descriptor).alias("source"), T.normal_path(dotted).alias("plain"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages")
def html_escape(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.html_escaped(F.col("html")).cast("binary")).alias("escaped"))


@query(r"""SELECT page_id, left(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 200) AS safe,
 regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS upload FROM pages""")
def sanitize_filename(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.safe_file_name(F.col("url")).alias("safe"), T.upload_name(F.col("url")).alias("upload"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://127.0.0.1/x' WHEN 1 THEN 'https://10.1.2.3' WHEN 2 THEN 'ftp://host/x' WHEN 3 THEN 'http://172.20.0.1:80/' ELSE url END AS u FROM pages),
h AS (SELECT *, regexp_extract(u, '^https?://([^/:?#]+)', 1) AS h FROM u)
SELECT page_id, h <> '' AND NOT regexp_matches(h, '^(localhost|0\.0\.0\.0|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') AS public FROM h""")
def url_guard(spark, sf):
    k = F.col("page_id") % 5
    url = F.when(k == 0, "http://127.0.0.1/x").when(k == 1, "https://10.1.2.3").when(k == 2, "ftp://host/x").when(k == 3, "http://172.20.0.1:80/").otherwise(F.col("url"))
    return read(spark, sf, "pages").select("page_id", T.public_url(url).alias("public"))


@query("""
SELECT conv_id, right(string_agg(text, chr(10) ORDER BY turn), 300) AS tail FROM conversations GROUP BY conv_id""")
def tail_transcript(spark, sf):
    return C.transcript_tail(read(spark, sf, "conversations"), "conv_id", "turn", "text", 300)


@query("""
WITH b AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) SELECT conv_id, turn FROM b WHERE before < 600 AND place <= 8""")
def batch_read(spark, sf):
    turns = read(spark, sf, "conversations").withColumn("size", F.length("text"))
    return C.batch_within(turns, ["conv_id"], "turn", "size", 600, 8).select("conv_id", "turn")
