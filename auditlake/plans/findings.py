"""Queries over findings and scans: events stand for findings, orders for scans, customers for apps, line items for vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import severity as S
from auditlake.functions import text as T
from auditlake.operators import rollups as R
from auditlake.operators import verdicts as V
from auditlake.plans.registry import query, read
from auditlake.sources.shared import shared_folder
from auditlake.sources.store import ScanStore

EVENT_SEVERITY = {"error": "Critical", "purchase": "high", "click": "MEDIUM", "view": " low ", "signup": "Informational"}
SQL_BUCKET = "CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'info' END"


def events_as_findings(spark, sf: str) -> DataFrame:
    severity = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_SEVERITY.items()])
    return read(spark, sf, "events").withColumn("severity", severity).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


@query(f"""
WITH f AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, {SQL_BUCKET} AS b FROM events),
c AS (SELECT user_id, day, count(*) FILTER (b = 'critical') AS critical, count(*) FILTER (b = 'high') AS high, count(*) FILTER (b = 'medium') AS medium,
             count(*) FILTER (b = 'low') AS low, count(*) FILTER (b = 'info') AS info FROM f GROUP BY user_id, day)
SELECT *, critical + high + medium + low + info AS total,
       greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - (critical * 20.0::DOUBLE + high * 10 + medium * 5 + low * 2 + info * 0.5::DOUBLE))) AS score FROM c""")
def severity_rollup(spark, sf):
    return R.severity_rollup(events_as_findings(spark, sf), ["user_id", "day"])


@query(f"""
SELECT event_type, {SQL_BUCKET} AS bucket, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY event_type), 0) AS percent
FROM events GROUP BY event_type, bucket
UNION ALL
SELECT 'all', {SQL_BUCKET} AS bucket, count(*), round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 0) FROM events GROUP BY bucket""")
def severity_pct(spark, sf):
    found = events_as_findings(spark, sf)
    return R.severity_shares(found, ["event_type"]).unionByName(R.severity_shares(found, []).withColumn("event_type", F.lit("all")))


@query(f"""
WITH f AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, {SQL_BUCKET} AS b FROM events),
c AS (SELECT user_id, day, count(*) FILTER (b = 'critical')::DOUBLE AS c, count(*) FILTER (b = 'high')::DOUBLE AS h, count(*) FILTER (b = 'medium')::DOUBLE AS m,
             count(*) FILTER (b = 'low')::DOUBLE AS l, count(*) FILTER (b = 'info')::DOUBLE AS i FROM f GROUP BY user_id, day)
SELECT user_id, day, CASE WHEN user_id % 2 = 0 THEN greatest(0::DOUBLE, 100 - (20 * c + 10 * h + 5 * m + 2 * l + 0.5::DOUBLE * i)) ELSE 0 END AS json_score,
       greatest(0::DOUBLE, 100 - (20 * c + 10 * h + 5 * m + 2 * l)) AS dynamic_score, greatest(0::DOUBLE, 100 - (25 * c + 10 * h + 5 * m + 2 * l)) AS html_score FROM c""")
def score_variants(spark, sf):
    return R.score_variants(events_as_findings(spark, sf), ["user_id", "day"], F.col("user_id") % 2 == 0)


_TITLES = "CASE WHEN event_type = 'signup' THEN '' ELSE event_type || ' ' || CAST(floor(value / 50) AS BIGINT) END"


@query(f"""
WITH f AS (SELECT {_TITLES} AS t, CASE {SQL_BUCKET} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS r FROM events),
g AS (SELECT CASE WHEN coalesce(trim(t), '') = '' THEN 'Security Issue' ELSE t END AS title, count(*) AS n, min(r) AS r FROM f GROUP BY 1)
SELECT title, n, ['critical', 'high', 'medium', 'low', 'info'][r + 1] AS severity, row_number() OVER (ORDER BY r, n DESC, lower(title), title) AS place FROM g""")
def group_by_title_max_severity(spark, sf):
    title = F.when(F.col("event_type") == "signup", "").otherwise(F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 50).cast("string")))
    return R.by_title(events_as_findings(spark, sf).withColumn("title", title))


def orders_as_scans(spark, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    rest = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        status.alias("status"),
        F.concat(F.lit("app-"), F.col("o_custkey").cast("string"), F.lit(".apk")).alias("filename"),
        F.col("o_orderpriority").alias("framework"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.when(rest % 7 > 0, rest % 23).alias("vulnerabilities"),
        *[F.when(rest % 7 > 0, rest % k).alias(c) for c, k in (("critical", 2), ("high", 3), ("medium", 5), ("low", 11))],
    )


_SCANS = """(SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
 'app-' || o_custkey || '.apk' AS filename, o_orderpriority AS framework, strftime(o_orderdate, '%Y-%m-%d') AS created_at,
 CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 23 END AS vulnerabilities, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 2 END AS critical,
 CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3 END AS high, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 5 END AS medium,
 CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 11 END AS low FROM orders)"""


@query(f"""SELECT count(*) AS scans, count(*) FILTER (status = 'completed') AS completed, CAST(sum(vulnerabilities) AS BIGINT) AS vulnerabilities,
 CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low FROM {_SCANS}""")
def dashboard_totals(spark, sf):
    return R.dashboard_totals(orders_as_scans(spark, sf))


@query(f"SELECT id, status, filename, framework FROM {_SCANS} WHERE status = 'completed' AND (contains(lower(filename), 'app-1') OR contains(lower(framework), 'app-1'))")
def scan_search(spark, sf):
    return R.scan_search(orders_as_scans(spark, sf), "completed", " APP-1 ", ["filename", "framework"]).select("id", "status", "filename", "framework")


SCAN = "id string, status string, filename string, created_at string"


def stored(spark, sf: str) -> ScanStore:
    """The scans, written to a store."""
    store = ScanStore(spark, shared_folder(spark), SCAN)
    store.create(orders_as_scans(spark, sf))
    return store


@query(f"SELECT id, status, created_at FROM {_SCANS}")
def scan_list(spark, sf):
    return R.newest_first(stored(spark, sf).read()).select("id", "status", "created_at")


@query(f"SELECT id, status, filename FROM {_SCANS} WHERE id = '7'")
def scan_get(spark, sf):
    return stored(spark, sf).get("7").select("id", "status", "filename")


@query(f"SELECT id, status FROM {_SCANS} WHERE id NOT LIKE '%7'")
def scan_delete(spark, sf):
    """Deleted, then saved: what is gone stays so."""
    store = stored(spark, sf)
    gone = orders_as_scans(spark, sf).where(F.col("id").endswith("7"))
    store.delete(gone.select("id"))
    store.save(gone)
    return store.read().select("id", "status")


@query(f"SELECT id, CASE WHEN id LIKE '%3' THEN 'cancelled' ELSE status END AS status FROM {_SCANS}")
def scan_save(spark, sf):
    store = stored(spark, sf)
    changed = store.read().where(F.col("id").endswith("3")).withColumn("status", F.lit("cancelled"))
    store.save(changed.unionByName(changed.withColumn("id", F.concat(F.lit("gone-"), F.col("id")))))
    return store.read().select("id", "status")


# CVSS -----------------------------------------------------------------------------------------------------------------------------


def _pick(values: str, key: Column) -> Column:
    return F.substring(F.lit(values), (F.pmod(key, F.lit(len(values))) + 1).cast("int"), F.lit(1))


def vectors(spark, sf: str) -> DataFrame:
    """A vector from the keys of each line item; some have a prefix, further metrics, small letters, or lack a metric."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    parts = [("AV", "NALP", k), ("AC", "LH", n), ("PR", "NLH", k + n), ("UI", "NR", F.col("l_partkey")), ("S", "UC", F.col("l_suppkey")),
             ("C", "NLH", F.col("l_partkey")), ("I", "NLH", F.col("l_suppkey")), ("A", "NLH", k)]
    body = F.concat_ws("/", *[F.concat(F.lit(f"{m}:"), _pick(v, key)) for m, v, key in parts])
    bodies = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", body.alias("body"))
    body = F.col("body")
    vector = (
        F.when(n == 1, F.concat(F.lit("CVSS:3.1/"), body)).when(n == 2, F.concat(body, F.lit("/E:P"))).when(n == 3, F.lower(body)).when(n == 4, F.left(body, F.lit(20)))
    )
    return bodies.select("l_orderkey", "l_linenumber", vector.otherwise(body).alias("vector"))


_SQL_BODY = " || '/' || ".join(
    f"'{m}:' || substr('{v}', CAST({k} % {len(v)} + 1 AS INTEGER), 1)"
    for m, v, k in (("AV", "NALP", "l_orderkey"), ("AC", "LH", "l_linenumber"), ("PR", "NLH", "(l_orderkey + l_linenumber)"), ("UI", "NR", "l_partkey"),
                    ("S", "UC", "l_suppkey"), ("C", "NLH", "l_partkey"), ("I", "NLH", "l_suppkey"), ("A", "NLH", "l_orderkey"))
)
_SQL_VECTORS = f"""v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'CVSS:3.1/' || b WHEN 2 THEN b || '/E:P' WHEN 3 THEN lower(b)
 WHEN 4 THEN left(b, 20) ELSE b END AS vector FROM (SELECT *, {_SQL_BODY} AS b FROM lineitem))"""
_SQL_METRICS = "m AS (SELECT *, " + ", ".join(
    f"nullif(regexp_extract('/' || upper(vector) || '/', '/{m}:([{v}])/', 1), '') AS {n}"
    for m, v, n in (("AV", "NALP", "av"), ("AC", "LH", "ac"), ("PR", "NLH", "pr"), ("UI", "NR", "ui"), ("S", "UC", "s"), ("C", "NLH", "c"), ("I", "NLH", "i"), ("A", "NLH", "a"))
) + " FROM v)"
_CIA = "CASE {} WHEN 'N' THEN 0.0::DOUBLE WHEN 'L' THEN 0.22::DOUBLE ELSE 0.56::DOUBLE END"
_SQL_SCORES = f"""{_SQL_VECTORS}, {_SQL_METRICS},
w AS (SELECT *, 1 - (1 - {_CIA.format('c')}) * (1 - {_CIA.format('i')}) * (1 - {_CIA.format('a')}) AS base,
  8.22::DOUBLE * CASE av WHEN 'N' THEN 0.85::DOUBLE WHEN 'A' THEN 0.62::DOUBLE WHEN 'L' THEN 0.55::DOUBLE ELSE 0.2::DOUBLE END
  * CASE ac WHEN 'L' THEN 0.77::DOUBLE ELSE 0.44::DOUBLE END
  * CASE pr WHEN 'N' THEN 0.85::DOUBLE WHEN 'L' THEN CASE s WHEN 'C' THEN 0.68::DOUBLE ELSE 0.62::DOUBLE END ELSE CASE s WHEN 'C' THEN 0.5::DOUBLE ELSE 0.27::DOUBLE END END
  * CASE ui WHEN 'N' THEN 0.85::DOUBLE ELSE 0.62::DOUBLE END AS exploit FROM m),
x AS (SELECT *, CASE s WHEN 'C' THEN 7.52::DOUBLE * (base - 0.029::DOUBLE) - 3.25::DOUBLE * pow(base - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * base END AS impact FROM w),
y AS (SELECT *, CASE WHEN impact <= 0 THEN 0.0::DOUBLE ELSE least(10.0::DOUBLE, CASE s WHEN 'C' THEN 1.08::DOUBLE * (impact + exploit) ELSE impact + exploit END) END AS raw FROM x),
z AS (SELECT *, CAST(round_even(raw * 100000, 0) AS BIGINT) AS k FROM y),
r AS (SELECT l_orderkey, l_linenumber, vector, CASE WHEN av IS NULL OR ac IS NULL OR pr IS NULL OR ui IS NULL OR s IS NULL OR c IS NULL OR i IS NULL OR a IS NULL THEN NULL
  WHEN k % 10000 = 0 THEN k / 100000.0::DOUBLE ELSE (k // 10000 + 1) / 10.0::DOUBLE END AS score FROM z)"""
_SQL_BAND = "CASE WHEN score = 0 THEN 'Informational' WHEN score < 4 THEN 'Low' WHEN score < 7 THEN 'Medium' WHEN score < 9 THEN 'High' WHEN score IS NOT NULL THEN 'Critical' END"


@query(f"WITH {_SQL_SCORES} SELECT l_orderkey, l_linenumber, vector, score FROM r")
def cvss_score(spark, sf):
    return S.with_cvss_score(vectors(spark, sf))


@query(f"WITH {_SQL_SCORES} SELECT {_SQL_BAND} AS severity, count(*) AS n, min(score) AS least, max(score) AS most FROM r GROUP BY 1")
def cvss_severity(spark, sf):
    scored = S.with_cvss_score(vectors(spark, sf))
    return scored.groupBy(S.cvss_band(F.col("score")).alias("severity")).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(f"WITH {_SQL_VECTORS}, {_SQL_METRICS} SELECT l_orderkey, l_linenumber, av, ac, pr, ui, s, c, i, a FROM m")
def cvss_parse(spark, sf):
    return vectors(spark, sf).select("l_orderkey", "l_linenumber", *[S.cvss_metric(F.col("vector"), m).alias(m.lower()) for m in S.CVSS_WEIGHTS])


# scalars over findings --------------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'line ' || p_size WHEN 1 THEN p_size || '-' || (p_partkey % 40) WHEN 2 THEN 'lines ' || p_size || ' to ' || (p_size - 3)
  WHEN 3 THEN p_brand ELSE 'application tag' END AS v FROM part), n AS (SELECT *, regexp_extract_all(v, '(\\d+)', 1) AS d FROM p)
SELECT p_partkey, v, CAST(least(CAST(d[1] AS INTEGER), CAST(coalesce(d[2], d[1]) AS INTEGER)) AS INTEGER) AS s,
       CAST(greatest(CAST(d[1] AS INTEGER), CAST(coalesce(d[2], d[1]) AS INTEGER)) AS INTEGER) AS e FROM n""")
def parse_line_span(spark, sf):
    refs = line_references(spark, sf)
    span = T.line_span(F.col("v"))
    return refs.select("p_partkey", "v", span["s"].alias("s"), span["e"].alias("e"))


def line_references(spark, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    v = F.when(k == 0, F.concat(F.lit("line "), size)).when(k == 1, F.concat(size, F.lit("-"), (F.col("p_partkey") % 40).cast("string")))
    v = v.when(k == 2, F.concat(F.lit("lines "), size, F.lit(" to "), (F.col("p_size") - 3).cast("string"))).when(k == 3, F.col("p_brand"))
    return read(spark, sf, "part").select("p_partkey", v.otherwise("application tag").alias("v"))


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'line ' || p_size WHEN 1 THEN p_size || '-' || (p_partkey % 40) WHEN 2 THEN 'lines ' || p_size || ' to ' || (p_size - 3)
  WHEN 3 THEN p_brand ELSE 'application tag' END AS v FROM part), n AS (SELECT *, regexp_extract_all(v, '(\\d+)', 1) AS d FROM p),
q AS (SELECT *, least(CAST(d[1] AS INTEGER), CAST(coalesce(d[2], d[1]) AS INTEGER)) AS s, greatest(CAST(d[1] AS INTEGER), CAST(coalesce(d[2], d[1]) AS INTEGER)) AS e FROM n)
SELECT p_partkey, CASE WHEN s IS NULL OR s = 0 THEN v WHEN s = e THEN 'line ' || s ELSE 'lines ' || s || '-' || e END AS location FROM q""")
def location_text(spark, sf):
    return line_references(spark, sf).select("p_partkey", T.location_text(F.col("v")).alias("location"))


_SQL_WORD = """CASE o_orderkey % 3 WHEN 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'critical!' WHEN '2-HIGH' THEN 'HIGH risk' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'lowish' ELSE 'Info' END
 WHEN 1 THEN o_orderpriority ELSE CASE WHEN o_orderstatus = 'F' THEN ' ' || lower(substr(o_orderpriority, 3)) || ' ' END END"""


@query(f"""
WITH p AS (SELECT o_orderkey, {_SQL_WORD} AS w FROM orders)
SELECT o_orderkey, CASE WHEN contains(upper(w), 'CRITICAL') THEN 'Critical' WHEN contains(upper(w), 'HIGH') THEN 'High' WHEN contains(upper(w), 'MEDIUM') THEN 'Medium'
 WHEN contains(upper(w), 'LOW') THEN 'Low' WHEN contains(upper(w), 'INFO') THEN 'Informational' ELSE 'Medium' END AS word,
 CASE WHEN starts_with(lower(w), 'crit') THEN 'critical' WHEN starts_with(lower(w), 'high') THEN 'high' WHEN starts_with(lower(w), 'med') THEN 'medium'
 WHEN starts_with(lower(w), 'low') THEN 'low' ELSE 'info' END AS client,
 CASE WHEN lower(trim(w)) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(trim(w)) ELSE 'info' END AS report FROM p""")
def normalize_severity(spark, sf):
    """Priorities of orders in several spellings, missing ones among them."""
    priority, k = F.col("o_orderpriority"), F.col("o_orderkey") % 3
    spelt = F.when(priority == "1-URGENT", "critical!").when(priority == "2-HIGH", "HIGH risk").when(priority == "3-MEDIUM", "medium").when(priority == "5-LOW", "lowish").otherwise("Info")
    bare = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.lower(F.substring(priority, 3, 20)), F.lit(" ")))
    word = F.when(k == 0, spelt).when(k == 1, priority).otherwise(bare)
    return read(spark, sf, "orders").select("o_orderkey", S.word_severity(word).alias("word"), S.client_severity(word).alias("client"), S.bucket(word).alias("report"))


@query("""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, regexp_extract(t, '^(.*?[.!?])\\s', 1) AS h FROM t),
x AS (SELECT doc_id, t, CASE WHEN h = '' THEN t ELSE h END AS x FROM h)
SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN 'Security Issue' WHEN length(x) > 80 THEN rtrim(left(x, 77)) || '...' ELSE x END AS title FROM x""")
def derive_title(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.derived_title(F.col("text")).alias("title"))


@query("""
WITH f AS (SELECT event_id, user_id, event_type, 'F' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS finding_id FROM events) SELECT * FROM f""")
def finding_index(spark, sf):
    return R.finding_ids(read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(f"""
WITH f AS (SELECT user_id, event_id, {SQL_BUCKET} AS bucket FROM events)
SELECT user_id, bucket, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY CASE bucket WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
 WHEN 'low' THEN 3 ELSE 4 END, event_id) AS place FROM f""")
def flatten_buckets(spark, sf):
    return R.flattened(events_as_findings(spark, sf), ["user_id"], "event_id")


@query("""SELECT c_custkey, coalesce(nullif(nullif(c_mktsegment, 'BUILDING'), ''), 'N/A') AS segment, round_even(c_acctbal / 7.0::DOUBLE, 2) + 0.0 AS size_mb, CAST([] AS VARCHAR[])::VARCHAR AS permissions
 FROM customer""")
def app_info_projection(spark, sf):
    segment = F.coalesce(T.clean(F.when(F.col("c_mktsegment") == "BUILDING", "Unknown").otherwise(F.col("c_mktsegment"))), F.lit("N/A"))
    return read(spark, sf, "customer").select("c_custkey", segment.alias("segment"), F.bround(F.col("c_acctbal") / 7.0, 2).alias("size_mb"), F.lit("[]").alias("permissions"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS verified, count(*) AS total FROM events GROUP BY user_id")
def verified_counts(spark, sf):
    status = F.when(F.col("event_type") == "purchase", "verified").otherwise("not_verified")
    return V.verified_counts(read(spark, sf, "events").withColumn("status", status), ["user_id"])


@query("SELECT user_id, CAST(greatest(20, least(60, count(*) * 2 + 6)) AS BIGINT) AS steps FROM events GROUP BY user_id")
def step_budget(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(V.step_budget(F.count("*")).alias("steps"))


@query("""
SELECT event_id, CASE WHEN v < 0 THEN '0s' WHEN v < 1 THEN printf('%.1f', round_even(v * 1000, 1)) || 'ms' WHEN v < 60 THEN printf('%.1f', round_even(v, 1)) || 's'
 ELSE concat_ws(' ', CASE WHEN k // 3600 > 0 THEN k // 3600 || 'h' END, CASE WHEN k % 3600 // 60 > 0 THEN k % 3600 // 60 || 'm' END, CASE WHEN k % 60 > 0 THEN k % 60 || 's' END) END AS said
FROM (SELECT event_id, v, CAST(floor(v) AS BIGINT) AS k FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN -value WHEN 1 THEN value / 1000 WHEN 2 THEN value ELSE value * 50 END AS v FROM events))""")
def format_duration(spark, sf):
    k, v = F.col("event_id") % 4, F.col("value")
    seconds = F.when(k == 0, -v).when(k == 1, v / 1000).when(k == 2, v).otherwise(v * 50)
    return read(spark, sf, "events").select("event_id", T.duration(seconds).alias("said"))


@query("""
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' bytes' WHEN n < 1048576 THEN printf('%.1f', round_even(n / 1024.0::DOUBLE, 1)) || ' KB'
 WHEN n < 1073741824 THEN printf('%.1f', round_even(n / 1048576.0::DOUBLE, 1)) || ' MB' ELSE printf('%.1f', round_even(n / 1073741824.0::DOUBLE, 1)) || ' GB' END AS said
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1000 ELSE n_chars * 1000000 END AS n FROM documents)""")
def format_size(spark, sf):
    k, n = F.col("doc_id") % 3, F.col("n_chars")
    return read(spark, sf, "documents").select("doc_id", T.file_size(F.when(k == 0, n).when(k == 1, n * 1000).otherwise(n * 1000000)).alias("said"))


@query("""SELECT doc_id, CASE WHEN n IS NULL THEN '—' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round_even(n / 1024.0::DOUBLE, 1)) || ' KB'
 WHEN n < 1073741824 THEN printf('%.1f', round_even(n / 1048576.0::DOUBLE, 1)) || ' MB' ELSE printf('%.2f', round_even(n / 1073741824.0::DOUBLE, 2)) || ' GB' END AS said
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1000 WHEN 2 THEN n_chars * 1000000 END AS n FROM documents)""")
def client_size(spark, sf):
    k, n = F.col("doc_id") % 4, F.col("n_chars")
    return read(spark, sf, "documents").select("doc_id", T.client_size(F.when(k == 0, n).when(k == 1, n * 1000).when(k == 2, n * 1000000)).alias("said"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y') AS day FROM events")
def short_date(spark, sf):
    return read(spark, sf, "events").select("event_id", T.short_date(F.col("ts")).alias("day"))


@query("""
WITH t AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-03-01') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s, value FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS ago,
 CASE WHEN value >= 85 THEN 'green' WHEN value >= 65 THEN 'yellow' WHEN value >= 40 THEN 'orange' ELSE 'red' END AS colour FROM t""")
def time_ago(spark, sf):
    then = F.col("ts").cast("timestamp")
    return read(spark, sf, "events").select("event_id", T.time_ago(then, F.lit("2024-03-01").cast("timestamp")).alias("ago"), T.score_colour(F.col("value")).alias("colour"))


@query("""
SELECT o_orderkey, regexp_matches(md5(o_orderkey::VARCHAR)[1:CAST(11 + o_orderkey % 2 AS INTEGER)], '^[0-9a-f]{12}$') AS is_id,
 regexp_matches(o_orderkey || '.' || (o_custkey % 10) || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '.1' END, '^\\d+\\.\\d+\\.\\d+$') AS is_version FROM orders""")
def id_validators(spark, sf):
    key = F.col("o_orderkey")
    scan = F.substring(F.md5(key.cast("string").cast("binary")), F.lit(1), (11 + key % 2).cast("int"))
    version = F.concat(key.cast("string"), F.lit("."), (F.col("o_custkey") % 10).cast("string"), F.when(key % 3 == 0, "x").otherwise(".1"))
    return read(spark, sf, "orders").select("o_orderkey", scan.rlike("^[0-9a-f]{12}$").alias("is_id"), version.rlike(r"^\d+\.\d+\.\d+$").alias("is_version"))


@query("""
SELECT p_partkey, CAST(list_transform(string_split(p_partkey % 3 || '.' || p_size || '.' || p_partkey % 12, '.'), lambda x: CAST(x AS INTEGER)) AS VARCHAR) AS key,
 CAST(row_number() OVER (PARTITION BY p_brand ORDER BY list_transform(string_split(p_partkey % 3 || '.' || p_size || '.' || p_partkey % 12, '.'), lambda x: CAST(x AS INTEGER)) DESC, p_partkey) AS INTEGER) AS place
FROM part""")
def version_sort(spark, sf):
    from pyspark.sql import Window

    version = F.concat_ws(".", (F.col("p_partkey") % 3).cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string"))
    rows = read(spark, sf, "part").withColumn("k", T.version_key(version))
    text = F.concat(F.lit("["), F.array_join(F.transform("k", lambda x: x.cast("string")), ", "), F.lit("]"))
    return rows.select("p_partkey", text.alias("key"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("k"), "p_partkey")).alias("place"))
