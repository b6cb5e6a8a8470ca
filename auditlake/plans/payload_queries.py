"""Queries over replies of models: conversations stand for agents' turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import severity as S
from auditlake.functions import text as T
from auditlake.operators import payloads as P
from auditlake.operators import reports as RP
from auditlake.plans.findings import SQL_BUCKET, events_as_findings
from auditlake.plans.registry import query, read


def turns(spark, sf: str) -> DataFrame:
    """The whole text of each turn, and the same as the inside of a JSON string."""
    quoted = F.to_json(F.struct(F.col("text").alias("v")))
    escaped = F.substring(quoted, F.lit(7), F.length(quoted) - 8)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("said"), escaped.alias("escaped"))


def _finding(turn, escaped):
    """One finding as JSON; every other turn names its place another way."""
    place = F.when(turn % 2 == 0, F.lit('"file": "a/B.java", "line": "6-7"')).otherwise(F.lit('"location": "lines 9 to 6"'))
    return F.concat(F.lit('{"title": "'), escaped, F.lit('", "severity": "high!", '), place, F.lit(', "description": "d {x}"}'))


def replies(spark, sf: str) -> DataFrame:
    """Replies in the shapes that models use: array, wrapper, object, fenced, bare values, cut off, prose."""
    t, one = F.col("turn"), _finding(F.col("turn"), F.col("escaped"))
    k = (F.col("conv_id") + t) % 7
    reply = F.when(k == 0, F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]"))).when(k == 1, F.concat(F.lit('{"findings": ['), one, F.lit("]}"))).when(k == 2, one)
    reply = reply.when(k == 3, F.concat(F.lit("Here:\n```json\n["), one, F.lit("]\n```\nbye"))).when(k == 4, F.concat(F.lit('[{"title": "'), "escaped", F.lit('", "line": 76-80 (x), "severity": low,}]')))
    reply = reply.when(k == 5, F.concat(F.lit("["), one, F.lit(', {"title": "t2"'))).otherwise(F.lit("nothing to say"))
    return turns(spark, sf).select("conv_id", "turn", "said", "escaped", k.alias("k"), reply.alias("reply"))


_SQL_TURNS = """t AS (SELECT conv_id, turn, text AS said, CAST(to_json(text) AS VARCHAR)[2:-2] AS escaped, (conv_id + turn) % 7 AS k FROM conversations)"""


@query(f"""WITH {_SQL_TURNS} SELECT conv_id, turn, said AS title, 'high!' AS severity FROM t WHERE k IN (0, 1, 2, 3, 5) UNION ALL SELECT conv_id, turn, said, 'high!' FROM t WHERE k = 0
 UNION ALL SELECT conv_id, turn, said, 'low' FROM t WHERE k = 4""")
def tolerant_json(spark, sf):
    found = P.parsed_findings(replies(spark, sf).select("conv_id", "turn", "reply"), ["conv_id", "turn"], "reply")
    return found.select("conv_id", "turn", "title", F.coalesce("severity", F.lit("-")).alias("severity"))


@query(f"""WITH {_SQL_TURNS}, n AS (SELECT * FROM t WHERE k IN (0, 1, 2, 3, 5) UNION ALL SELECT * FROM t WHERE k = 0) SELECT conv_id, turn, CASE WHEN said = '' THEN 'd {{x}}' ELSE said END AS title,
 CASE WHEN turn % 2 = 0 THEN 'a/B.java' ELSE 'lines 9 to 6' END AS file, 6 AS line_number, CASE WHEN turn % 2 = 0 THEN 7 ELSE 9 END AS line_end, CASE WHEN turn % 2 = 0 THEN 'lines 6-7' ELSE 'lines 6-9' END AS location, 'High' AS severity FROM n""")
def validate_normalize_findings(spark, sf):
    """Of all turns; those without a description or a place (cut off, prose) have no valid finding."""
    made = P.parsed_findings(replies(spark, sf), ["conv_id", "turn"], "reply")
    found = P.normalised(P.valid(made), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "title", "file", "line_number", "line_end", "location", "severity")


@query(f"""WITH {_SQL_TURNS}, n AS (SELECT * FROM t WHERE k < 6 UNION ALL SELECT * FROM t WHERE k = 0) SELECT conv_id, turn, 'info' AS bucket, CASE WHEN said = '' THEN 'Unknown' ELSE said END AS title, CASE WHEN k = 4 THEN 'low' ELSE 'high!' END AS severity,
 CASE WHEN k = 4 THEN 0 ELSE 6 END AS line, CASE WHEN k = 4 THEN 0 WHEN turn % 2 = 0 THEN 7 ELSE 6 END AS line_end, CASE WHEN k <> 4 AND turn % 2 = 0 THEN 'a/B.java' ELSE '' END AS file, CASE WHEN k = 4 THEN '' ELSE 'd {{x}}' END AS description FROM n""".replace("'info' AS bucket", "CASE WHEN k = 4 THEN 'low' ELSE 'info' END AS bucket"))
def report_entries(spark, sf):
    """Findings as they were said, with what a report puts where fields lack."""
    found = P.parsed_findings(replies(spark, sf), ["conv_id", "turn"], "reply")
    span = T.line_span(F.coalesce("line", "location"))
    rows = found.withColumn("line_number", F.when(F.col("severity") != "low", span["s"])).withColumn("line_end", F.when(F.col("severity").eqNullSafe("high!") & F.col("file").isNotNull(), span["e"]))
    return RP.entries(rows, ["conv_id", "turn"]).select("conv_id", "turn", "bucket", "title", "severity", "line", "line_end", "file", "description")


_SQL_THINK = """x AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>a' || chr(10) || 'b</think>' || text WHEN 1 THEN 'draft </think> more </THINK>' || text WHEN 2 THEN text || '<Think>x</think>' ELSE text END AS t FROM conversations)"""


@query(f"""WITH {_SQL_THINK}, y AS (SELECT *, regexp_replace(t, '(?is)<think>.*?</think>', '', 'g') AS u FROM x)
SELECT conv_id, turn, trim(CASE WHEN regexp_matches(u, '(?i)</think>') THEN regexp_replace(u, '(?is)^.*</think>', '') ELSE u END) AS said FROM y""")
def think_strip(spark, sf):
    t, said = F.col("turn") % 4, F.col("text")
    shaped = F.when(t == 0, F.concat(F.lit("<think>a\nb</think>"), said)).when(t == 1, F.concat(F.lit("draft </think> more </THINK>"), said)).when(t == 2, F.concat(said, F.lit("<Think>x</think>"))).otherwise(said)
    return read(spark, sf, "conversations").select("conv_id", "turn", T.without_thinking(shaped).alias("said"))


_SQL_ONE = """o AS (SELECT *, '{"title": "' || escaped || '", "severity": "high!", ' || CASE WHEN turn % 2 = 0 THEN '"file": "a/B.java", "line": "6-7"' ELSE '"location": "lines 9 to 6"' END
 || ', "description": "d {x}"}' AS one FROM t)"""


@query(f"""WITH {_SQL_TURNS}, {_SQL_ONE} SELECT conv_id, turn, CAST(0 AS INTEGER) AS ord, CASE k WHEN 1 THEN '{{"findings": [' || one || ']}}' WHEN 4 THEN '{{"title": "' || escaped || '", "line": 76-80 (x), "severity": low,}}' ELSE one END AS object
 FROM o WHERE k < 6 UNION ALL SELECT conv_id, turn, 1, one FROM o WHERE k IN (0, 1)""")
def balanced_json(spark, sf):
    return P.objects(replies(spark, sf), ["conv_id", "turn"], "reply")


@query(f"""WITH {_SQL_TURNS}, x AS (SELECT conv_id, turn, said AS title, CASE WHEN k = 4 THEN 'low' ELSE 'high!' END AS severity, CASE WHEN k < 4 OR k = 5 THEN CASE WHEN turn % 2 = 0 THEN 'a/B.java' END END AS file,
 CASE WHEN k = 4 THEN '76-80 (x)' WHEN turn % 2 = 0 THEN '6-7' END AS line, CASE WHEN k <> 4 THEN 'd {{x}}' END AS description, k FROM t WHERE k < 6 AND said <> '')
SELECT conv_id, turn, title, coalesce(severity, '-') AS severity, coalesce(file, '-') AS file, coalesce(line, '-') AS line, coalesce(description, '-') AS description FROM x
UNION ALL SELECT conv_id, turn, title, severity, coalesce(file, '-'), coalesce(line, '-'), description FROM x WHERE k = 0 OR k = 1""")
def salvage_fields(spark, sf):
    found = P.salvaged(replies(spark, sf), ["conv_id", "turn"], "reply")
    return found.select("conv_id", "turn", "title", *[F.coalesce(c, F.lit("-")).alias(c) for c in ("severity", "file", "line", "description")])


@query(f"""WITH {_SQL_TURNS}, {_SQL_ONE} SELECT conv_id, turn, said AS title, CASE WHEN k = 4 THEN '76-80 (x)' WHEN turn % 2 = 0 THEN '6-7' ELSE '-' END AS line, CASE WHEN k = 4 THEN 'low' ELSE 'high!' END AS severity FROM o WHERE k < 6
UNION ALL SELECT conv_id, turn, said, CASE WHEN turn % 2 = 0 THEN '6-7' ELSE '-' END, 'high!' FROM o WHERE k = 0""")
def payload_coerce(spark, sf):
    found = replies(spark, sf).select("conv_id", "turn", F.explode(P.tolerant_findings(F.col("reply"))).alias("j"))
    field = lambda name: F.coalesce(F.get_json_object("j", f"$.{name}"), F.lit("-")).alias(name)
    return found.select("conv_id", "turn", F.get_json_object("j", "$.title").alias("title"), field("line"), field("severity"))


@query(rf"""WITH {_SQL_TURNS} SELECT conv_id, turn, 'SQL ' || turn AS vulnerability_type, 'B.java' AS file, CAST(turn AS VARCHAR) AS line_number, trim(regexp_extract('x ' || escaped, '^([^",}}{{\[\]]*)', 1)) AS description, 'low' AS severity
 FROM t WHERE NOT regexp_matches(escaped, '["\[\]{{}}]')""")
def text_patterns(spark, sf):
    """Of texts without brackets, braces and quotes, which would end a part or a value elsewhere."""
    line = F.col("turn").cast("string")
    reply = F.concat(F.lit("no [json] {vulnerability_type: SQL "), line, F.lit(', file: B.java, line_number: '), line, F.lit(', description: "x '), "escaped", F.lit('", severity: low} {file: other}'))
    plain = turns(spark, sf).where(~F.col("escaped").rlike(r'["\[\]{}]'))
    found = P.block_findings(plain.select("conv_id", "turn", reply.alias("reply")), ["conv_id", "turn"], "reply")
    return found.select("conv_id", "turn", "vulnerability_type", "file", "line_number", "description", "severity")


@query(rf"""WITH {_SQL_TURNS} SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'SQL: ' || said || ', unsafe' ELSE 'SQL ' || turn END AS title, CASE WHEN turn % 2 = 0 THEN 'low' ELSE '-' END AS severity, CASE WHEN turn % 2 = 0 THEN '-' ELSE 'B.java' END AS file
 FROM t WHERE turn % 2 = 0 OR NOT regexp_matches(said, '[\[\]{{}}]')""")
def json_repair(spark, sf):
    """Marks of JSON within strings beside a fault elsewhere; prose in which only patterns find anything."""
    faulty = F.concat(F.lit('Report: [{"title": "SQL: '), "escaped", F.lit(', unsafe", "severity": low,}'))
    prose = F.concat(F.lit("vulnerability_type: SQL "), F.col("turn").cast("string"), F.lit("\nfile: B.java\n"), "said")
    rows = turns(spark, sf).where((F.col("turn") % 2 == 0) | ~F.col("said").rlike(r"[\[\]{}]"))
    found = P.parsed_findings(rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, faulty).otherwise(prose).alias("reply")), ["conv_id", "turn"], "reply")
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return found.select("conv_id", "turn", F.coalesce("title", "vulnerability_type").alias("title"), dash("severity"), dash("file"))


@query(f"""WITH {_SQL_TURNS}, {_SQL_ONE} SELECT conv_id, turn, CASE WHEN k < 2 THEN 'report' WHEN k IN (2, 4) THEN '' WHEN k = 3 THEN 'read' ELSE 'grep' END AS action, CASE k WHEN 3 THEN 'a/' || said WHEN 5 THEN 'p' ELSE '-' END AS path,
 CASE k WHEN 0 THEN '[' || one || ']' ELSE '-' END AS bare, k = 0 OR k = 1 AS has_findings FROM o WHERE k <> 6""")
def action_parse(spark, sf):
    k, one = F.col("k"), _finding(F.col("turn"), F.col("escaped"))
    reply = F.when(k == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k == 1, F.concat(F.lit('<think>{"action": "x"}</think>{"findings": ['), one, F.lit("]}"))).when(k.isin(2, 4), one)
    reply = reply.when(k == 3, F.concat(F.lit('```json\n{"action": " READ", "path": "a/'), "escaped", F.lit('"}\n```'))).when(k == 5, 'I will look: {"action": "grep", "path": "p"} and then {"action": "z"}').otherwise("nothing {")
    found = P.actions(replies(spark, sf).select("conv_id", "turn", "k", reply.alias("reply")), ["conv_id", "turn", "k"], "reply")
    bare = F.when(F.col("k") == 0, F.col("findings")).otherwise("-")
    return found.select("conv_id", "turn", "action", F.coalesce("path", F.lit("-")).alias("path"), bare.alias("bare"), F.col("findings").isNotNull().alias("has_findings"))


@query("""SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN '{"limits":{"chars":100,"more":[' || c_nationkey || ',null],"steps":' || c_custkey || '},"new":{"a":' || CAST(floor(c_acctbal) AS BIGINT) || '.25},"provider":"' || c_mktsegment || '"}'
 WHEN 1 THEN '{"limits":{"chars":5,"steps":null},"provider":"' || c_name || '"}' WHEN 2 THEN '{"limits":"' || c_mktsegment || '","provider":null}' ELSE '{"limits":{"chars":100,"steps":30},"provider":"none"}' END AS settings FROM customer""")
def override_merge(spark, sf):
    """Settings of customers, sorted by key."""
    k, segment, quote = F.col("c_nationkey") % 4, F.col("c_mktsegment"), F.lit('"')
    more = F.concat(F.lit('{"provider": "'), segment, F.lit('", "limits": {"steps": '), F.col("c_custkey").cast("string"), F.lit(', "more": ['), F.col("c_nationkey").cast("string"), F.lit(', null]}, "new": {"a": '), F.floor("c_acctbal").cast("string"), F.lit(".25}}"))
    null = F.concat(F.lit('{"limits": {"steps": null, "chars": 5}, "provider": "'), F.col("c_name"), F.lit('"}'))
    other = F.concat(F.lit('{"provider": null, "limits": '), quote, segment, quote, F.lit("}"))
    override = F.when(k == 0, more).when(k == 1, null).when(k == 2, other).otherwise(F.concat(F.lit("{broken "), segment))
    defaults = {"limits": {"chars": 100, "steps": 30}, "provider": "none"}
    return read(spark, sf, "customer").select("c_custkey", P.merged(defaults, override).alias("settings"))


@query("SELECT page_id, coalesce(nullif(regexp_extract('pre ' || CASE WHEN page_id % 3 = 0 THEN 'none' ELSE '{a ' || url || '} x {b}' END || ' post', '(?s)\\{.*\\}'), ''), '-') AS object FROM pages")
def object_grab(spark, sf):
    text = F.concat(F.lit("pre "), F.when(F.col("page_id") % 3 == 0, "none").otherwise(F.concat(F.lit("{a "), "url", F.lit("} x {b}"))), F.lit(" post"))
    return read(spark, sf, "pages").select("page_id", F.coalesce(P.greedy_object(text), F.lit("-")).alias("object"))


_SQL_COUNTS = f"""c AS (SELECT user_id, count(*) FILTER (b = 'critical') AS critical, count(*) FILTER (b = 'high') AS high, count(*) FILTER (b = 'medium') AS medium, count(*) FILTER (b = 'low') AS low,
 count(*) FILTER (b = 'info') AS info, count(*) AS n FROM (SELECT user_id, {SQL_BUCKET} AS b FROM events) GROUP BY user_id)"""


@query(f"""WITH {_SQL_COUNTS}, x AS (SELECT c_custkey AS scan, c_mktsegment AS segment, c_custkey % 3 > 0 AS analysed, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
 coalesce(low, 0) AS low, coalesce(info, 0) AS info, coalesce(n, 0) AS n FROM customer LEFT JOIN c ON c_custkey = user_id), y AS (SELECT *, CASE WHEN analysed THEN 'true' ELSE 'false' END AS done,
 CASE WHEN analysed THEN greatest(0.0::DOUBLE, 100.0::DOUBLE - (20.0::DOUBLE * critical + 10 * high + 5 * medium + 2 * low + 0.5::DOUBLE * info)) ELSE 0.0::DOUBLE END AS score FROM x)
SELECT scan, '{{"metadata":{{"scan":' || scan || '}},"framework_detection":{{"primary":"' || segment || '"}},"application_info":{{"package":"app.c' || scan || '"}},"vulnerability_analysis":{{"analyzed":' || done
 || ',"total_vulnerabilities":' || n || ',"by_severity":{{"critical":' || critical || ',"high":' || high || ',"medium":' || medium || ',"low":' || low || ',"info":' || info || '}}}},"analyzer_details":{{}},"summary":{{"framework_detected":true,"vulnerability_scan_complete":'
 || done || ',"total_vulnerabilities":' || n || ',"critical_count":' || critical || ',"high_count":' || high || ',"medium_count":' || medium || ',"low_count":' || low || ',"security_score":' || CAST(score AS VARCHAR) || '}}}}' AS report FROM y""")
def report_json(spark, sf):
    key, package = F.col("c_custkey"), F.concat(F.lit("app.c"), F.col("c_custkey").cast("string"))
    scans = read(spark, sf, "customer").select(
        key.alias("scan"),
        F.struct(key.alias("scan")).alias("metadata"),
        F.struct(F.col("c_mktsegment").alias("primary")).alias("framework_detection"),
        F.struct(package.alias("package")).alias("application_info"),
        F.create_map().cast("map<string,string>").alias("analyzer_details"),
        (key % 3 > 0).alias("analysed"),
    )
    return RP.json_reports(scans, events_as_findings(spark, sf).withColumnRenamed("user_id", "scan"), "scan")


_SQL_PAGE = f"""f AS (SELECT user_id, event_id, {SQL_BUCKET} AS bucket, event_type || ' & ' || CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'a' END AS title FROM events),
g AS (SELECT *, CASE bucket WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS worse FROM f)"""
_SQL_ITEM = """'<li class="' || bucket || '">' || replace(title, '&', '&amp;') || CASE WHEN event_id % 3 = 0 THEN '' ELSE '<table><tr><td>1</td><td>a &lt; ' || event_id || '</td></tr><tr><td>2</td><td>b</td></tr></table>' END || '</li>'"""


def _titled(spark, sf: str) -> DataFrame:
    k = F.col("event_id")
    title = F.concat("event_type", F.lit(" & "), F.when(k % 2 == 0, "B").otherwise("a"))
    code = F.when(k % 3 > 0, F.concat(F.lit("a < "), k.cast("string"), F.lit("\nb")))
    return events_as_findings(spark, sf).withColumns({"title": title, "code": code})


@query(f"WITH {_SQL_PAGE} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY worse, lower(title), event_id) AS place, {_SQL_ITEM} AS html FROM g")
def report_html(spark, sf):
    return RP.page_rows(_titled(spark, sf), "user_id", "title", "code", "event_id")


@query(f"WITH {_SQL_PAGE} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY lower(title), event_id) AS place, {_SQL_ITEM} AS html FROM g WHERE bucket = 'high'")
def severity_filter(spark, sf):
    return RP.page_rows(_titled(spark, sf), "user_id", "title", "code", "event_id", "HIGH")


@query(f"""WITH {_SQL_PAGE}, {_SQL_COUNTS}, j AS (SELECT c_custkey AS scan, coalesce(n, 0) AS n FROM customer LEFT JOIN c ON c_custkey = user_id)
SELECT 'html' AS kind, user_id AS scan, count(*) AS n FROM g GROUP BY user_id UNION ALL SELECT 'json', scan, n FROM j""")
def report_formats(spark, sf):
    """The report in each format: findings that its page lists, and that its JSON counts."""
    key = F.col("c_custkey")
    none = F.create_map().cast("map<string,string>").alias("analyzer_details")
    scans = read(spark, sf, "customer").select(key.alias("user_id"), F.struct(key.alias("scan")).alias("metadata"), F.struct(F.col("c_mktsegment").alias("primary")).alias("framework_detection"),
                                               F.struct(key.alias("app")).alias("application_info"), none, F.lit(True).alias("analysed"))
    made = {kind: RP.report(kind, scans, _titled(spark, sf), "user_id", "title", "code", "event_id") for kind in ("html", "json")}
    pages = made["html"].groupBy(F.col("user_id").alias("scan")).agg(F.count("*").alias("n")).select(F.lit("html").alias("kind"), "scan", "n")
    total = F.get_json_object("report", "$.vulnerability_analysis.total_vulnerabilities").cast("long")
    return pages.unionByName(made["json"].select(F.lit("json").alias("kind"), F.col("user_id").alias("scan"), total.alias("n")))


@query("SELECT p_partkey, coalesce('https://cwe.mitre.org/data/definitions/' || nullif(regexp_extract(p_brand, '(\\d+)', 1), '') || '.html', '-') AS link, 'he said \"no\" it''s ' || p_brand AS folded FROM part")
def cwe_links(spark, sf):
    said = F.concat(F.lit("he said “no” it’s "), "p_brand")
    return read(spark, sf, "part").select("p_partkey", F.coalesce(T.cwe_link(F.col("p_brand")), F.lit("-")).alias("link"), T.fold_quotes(said).alias("folded"))
