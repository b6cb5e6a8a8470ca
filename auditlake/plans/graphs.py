"""Queries over the code graph and over verdicts: pages stand for classes and their links for references, conversations for agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import graph as G
from auditlake.operators import rollups as R
from auditlake.operators import verdicts as V
from auditlake.plans.registry import query, read
from auditlake.plans.texts import PATHS_SQL, paths

_LINK = r'href="([^"]+)"'
_APP = ("app",)
#: Pages with even and with odd numbers stand for the classes of two apps, which have the same names.
_SQL_REFS = r"""r AS (SELECT page_id % 2 AS app, 'C' || page_id // 2 AS cls, i AS ord, 'C' || (length(ref) * 31 + page_id * 3) % 97 AS ref, ref AS href FROM (SELECT page_id, unnest(range(0, len(a))) AS i, unnest(a) AS ref
 FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS a FROM pages)))"""


def _class_of_page():
    return (F.col("page_id") % 2).alias("app"), F.concat(F.lit("C"), F.floor(F.col("page_id") / 2).cast("string")).alias("cls")


def references(spark, sf: str) -> DataFrame:
    links = read(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("ord", "href"))
    ref = F.concat(F.lit("C"), ((F.length("href") * 31 + F.col("page_id") * 3) % 97).cast("string"))
    return links.select(*_class_of_page(), F.col("ord").cast("long").alias("ord"), ref.alias("ref"), "href")


_CALLS = [k for keys in G.SINKS.values() for k in keys] + ["Lcom/app/X;->run"]
_SQL_CALLS = f"c AS (SELECT l_orderkey % 2 AS app, 'K' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN '$1' ELSE '' END AS cls, [{', '.join(repr(c) for c in _CALLS)}][CAST(l_partkey % {len(_CALLS)} + 1 AS INTEGER)] AS call FROM lineitem)"


def calls(spark, sf: str) -> DataFrame:
    call = F.element_at(F.array(*[F.lit(c) for c in _CALLS]), (F.col("l_partkey") % len(_CALLS) + 1).cast("int"))
    cls = F.concat(F.lit("K"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "$1").otherwise(""))
    return read(spark, sf, "lineitem").select((F.col("l_orderkey") % 2).alias("app"), cls.alias("cls"), call.alias("call"))


_SQL_SINKS = "s(family, key) AS (VALUES " + ", ".join(f"('{f}', '{k}')" for f, keys in G.SINKS.items() for k in keys) + ")"


@query(f"WITH {_SQL_CALLS}, {_SQL_SINKS}, d AS (SELECT call, family FROM (SELECT DISTINCT call FROM c) JOIN s ON contains(call, key) GROUP BY ALL) SELECT app, split_part(cls, '$', 1) AS cls, family, count(*) AS n FROM c JOIN d USING (call) GROUP BY ALL")
def sink_tags(spark, sf):
    return G.signals(calls(spark, sf), "cls", "call", app=_APP)


_SQL_GRAPH = f"""{_SQL_REFS}, {_SQL_CALLS}, {_SQL_SINKS}, d AS (SELECT call, family FROM (SELECT DISTINCT call FROM c) JOIN s ON contains(call, key) GROUP BY ALL),
v AS (SELECT page_id % 2 AS app, 'C' || page_id // 2 AS cls, 'f/C' || page_id || '.java' AS file, CASE page_id % 3 WHEN 0 THEN 'Object' WHEN 1 THEN 'Base' END AS extends, page_id % 7 = 0 AS exported, page_id % 5 = 0 AS loads FROM pages),
k AS (SELECT DISTINCT app, 'C' || substr(split_part(cls, '$', 1), 2) AS cls, family, call FROM c JOIN d USING (call)),
k4 AS (SELECT *, row_number() OVER (PARTITION BY app, cls, family ORDER BY call) AS n FROM k), m AS (SELECT DISTINCT r.app, r.cls, r.ref AS call FROM r JOIN v ON v.app = r.app AND v.cls = r.ref AND v.loads WHERE r.cls <> r.ref),
m4 AS (SELECT *, row_number() OVER (PARTITION BY app, cls ORDER BY call) AS n FROM m),
g AS (SELECT app, cls, family, string_agg(call, ', ' ORDER BY call) AS names FROM (SELECT app, cls, family, call FROM k4 WHERE n <= 4 UNION ALL SELECT app, cls, 'native-call', call FROM m4 WHERE n <= 4) GROUP BY app, cls, family),
h AS (SELECT app, cls, string_agg(family || '(' || names || ')', '; ' ORDER BY family) AS signs FROM g GROUP BY app, cls),
f AS (SELECT app, cls, ref, min(ord) AS o FROM r GROUP BY app, cls, ref), f5 AS (SELECT *, row_number() OVER (PARTITION BY app, cls ORDER BY o, ref) AS n FROM f), rf AS (SELECT app, cls, string_agg(ref, ', ' ORDER BY n) AS refs FROM f5 WHERE n <= 5 GROUP BY app, cls),
z AS (SELECT v.*, CASE WHEN exported THEN 'activity' WHEN loads THEN 'native-bridge' ELSE 'class' END AS role, signs, refs FROM v LEFT JOIN h USING (app, cls) LEFT JOIN rf USING (app, cls))"""


def graph_nodes(spark, sf: str) -> DataFrame:
    """Pages as classes, their links as references, the calls of suppliers' line items as those of the class of the same number."""
    k, (app, name) = F.col("page_id"), _class_of_page()
    pages = read(spark, sf, "pages")
    file = F.concat(F.lit("f/C"), k.cast("string"), F.lit(".java"))
    classes = pages.select(app, name, F.when(k % 3 == 0, "Object").when(k % 3 == 1, "Base").alias("extends"), file.alias("file"))
    roles = pages.where(k % 7 == 0).select(app, name, F.lit("activity").alias("role"))
    made = calls(spark, sf).select("app", F.concat(F.lit("C"), F.expr("substring(cls, 2)")).alias("cls"), "call")
    return G.code_graph(classes, roles, references(spark, sf).select("app", "cls", "ord", "ref"), made, pages.where(k % 5 == 0).select(app, name), _APP)


@query(f"WITH {_SQL_GRAPH} SELECT app, cls, file, coalesce(extends, '-') AS extends, role, exported, signs IS NOT NULL AS flagged, coalesce(signs, '-') AS signs, coalesce(refs, '-') AS refs FROM z")
def code_graph(spark, sf):
    signs = F.array_join(F.transform("signals", lambda s: F.concat(s["family"], F.lit("("), s["names"], F.lit(")"))), "; ")
    lists = [F.coalesce(c, F.lit("-")).alias(n) for c, n in ((signs, "signs"), (F.col("refs"), "refs"))]
    return graph_nodes(spark, sf).select("app", "cls", "file", F.coalesce("extends", F.lit("-")).alias("extends"), "role", "exported", "flagged", *lists)


@query(f"""WITH {_SQL_GRAPH}, o AS (SELECT app, CASE WHEN exported THEN 0 WHEN signs IS NOT NULL THEN 1 ELSE 2 END AS tier, cls, '[' || role || '] ' || cls || ' (' || file || ')' || CASE WHEN extends = 'Base' THEN ' extends Base' ELSE '' END
 || CASE WHEN signs IS NULL AND refs IS NULL THEN '' ELSE chr(10) || '    ' || concat_ws(' | ', 'sinks: ' || signs, 'refs: ' || refs) END AS line, count(*) OVER (PARTITION BY app) AS total FROM z)
SELECT app, tier, cls, line, total FROM o QUALIFY row_number() OVER (PARTITION BY app ORDER BY tier, lower(cls), cls) <= 120""")
def graph_map(spark, sf):
    return G.rendered(graph_nodes(spark, sf), app=_APP)


@query(f"WITH {_SQL_GRAPH} SELECT app, cls, '[' || role || '] ' || cls || ' (' || file || '): ' || coalesce(signs, '-') AS line FROM z WHERE exported")
def graph_entry_points(spark, sf):
    return G.entry_points(graph_nodes(spark, sf), _APP)


@query(f"""WITH {_SQL_REFS}, l AS (SELECT DISTINCT app, cls FROM r WHERE href LIKE '%a%' AND CAST(substr(cls, 2) AS BIGINT) < 97), d AS (SELECT DISTINCT r.app, r.cls, r.ref FROM r SEMI JOIN l ON l.app = r.app AND l.cls = r.ref WHERE r.cls <> r.ref),
k AS (SELECT *, row_number() OVER (PARTITION BY app, cls ORDER BY ref) AS n FROM d) SELECT app, cls, string_agg(ref, ',' ORDER BY ref) AS loaders FROM k WHERE n <= 4 GROUP BY app, cls""")
def native_propagation(spark, sf):
    refs = references(spark, sf)
    loaders = refs.where(F.col("href").contains("a") & (F.substring("cls", 2, 9).cast("long") < 97)).select("app", "cls").distinct()
    return G.native_callers(refs.select("app", "cls", "ref"), loaders, app=_APP).withColumn("loaders", F.array_join("loaders", ","))


@query(f"WITH {_SQL_REFS}, f AS (SELECT app, cls, ref, min(ord) AS f FROM r GROUP BY app, cls, ref), k AS (SELECT *, row_number() OVER (PARTITION BY app, cls ORDER BY f, ref) AS n FROM f) SELECT app, cls, string_agg(ref, ',' ORDER BY n) AS refs FROM k WHERE n <= 8 GROUP BY app, cls")
def capped_refs(spark, sf):
    return R.capped_set(references(spark, sf), ["app", "cls"], "ref", "ord", 8).withColumn("refs", F.array_join("refs", ","))


@query(f"WITH {PATHS_SQL}, t AS (SELECT DISTINCT app, path FROM p WHERE path LIKE '%sources/%' OR path LIKE 'resources/%'), d AS (SELECT DISTINCT app, path FROM p WHERE page_id % 5 < 3) SELECT app, path FROM t EXCEPT SELECT app, path FROM d")
def coverage_gap(spark, sf):
    rows = paths(spark, sf)
    return G.unread(rows.where(F.col("path").contains("sources/") | F.col("path").startswith("resources/")), rows.where(F.col("page_id") % 5 < 3), "path", _APP)


@query(rf"""WITH {PATHS_SQL}, f AS (SELECT DISTINCT app, CASE page_id % 3 WHEN 0 THEN './' || path || ':12-14' WHEN 1 THEN regexp_replace(path, '^(re)?sources/', '') ELSE 'x/' || path END AS file, CASE page_id % 3 WHEN 0 THEN path WHEN 1 THEN regexp_replace(path, '^(re)?sources/', '') ELSE 'x/' || path END AS cited
 FROM p WHERE path LIKE '%sources/%'), n AS (SELECT app, 'N' || page_id AS node, page_id AS ord, path AS node_file FROM p WHERE path LIKE '%sources/%'),
m AS (SELECT app, file, node, ord, CASE WHEN cited = node_file OR cited LIKE '%/' || node_file OR node_file LIKE '%/' || cited THEN 0 ELSE 1 END AS tier FROM f JOIN n USING (app) WHERE regexp_extract(cited, '([^/]*)$', 1) = regexp_extract(node_file, '([^/]*)$', 1)),
k AS (SELECT *, row_number() OVER (PARTITION BY app, file ORDER BY tier, ord) AS r FROM m) SELECT app, file, node, CAST(tier AS INTEGER) AS tier FROM k WHERE r = 1""")
def node_for_file(spark, sf):
    """Files as findings cite them; manifests and strings, which every app has, meet their own app's."""
    rows, k = paths(spark, sf).where(F.col("path").contains("sources/")), F.col("page_id") % 3
    bare = F.regexp_replace("path", "^(re)?sources/", "")
    cited = F.when(k == 0, F.concat(F.lit("./"), "path", F.lit(":12-14"))).when(k == 1, bare).otherwise(F.concat(F.lit("x/"), "path"))
    nodes = rows.select("app", F.concat(F.lit("N"), F.col("page_id").cast("string")).alias("node"), F.col("page_id").alias("ord"), F.col("path").alias("node_file"))
    return G.node_of_file(rows.select("app", cited.alias("file")), nodes, _APP)


@query("""
WITH c AS (SELECT s_nationkey % 2 AS app, s_suppkey, 'K' || s_suppkey // 3 || CASE s_suppkey % 3 WHEN 0 THEN '' ELSE '$' || s_suppkey % 3 END AS cls, 'Base' || s_nationkey AS extends FROM supplier),
g AS (SELECT app, split_part(cls, '$', 1) AS o, max(CASE WHEN NOT contains(cls, '$') THEN extends END) AS own, arg_max(extends, cls) AS nested, count(*) AS members FROM c GROUP BY ALL)
SELECT app, o AS cls, coalesce(own, nested) AS extends, members, CASE WHEN app = 0 AND CAST(substr(o, 2) AS BIGINT) % 2 = 0 THEN 'activity' ELSE 'class' END AS role FROM g""")
def graph_vertices(spark, sf):
    k = F.col("s_suppkey")
    cls = F.concat(F.lit("K"), F.floor(k / 3).cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("$"), (k % 3).cast("string"))))
    classes = read(spark, sf, "supplier").select((F.col("s_nationkey") % 2).alias("app"), cls.alias("cls"), F.concat(F.lit("Base"), F.col("s_nationkey").cast("string")).alias("extends"))
    own = classes.where("app = 0").select("app", G.outer_class(F.col("cls")).alias("cls")).distinct()
    roles = own.where(F.substring("cls", 2, 9).cast("long") % 2 == 0).withColumn("role", F.lit("activity"))
    return G.vertices(classes, roles, "cls", _APP)


@query(f"WITH {PATHS_SQL} SELECT path, 'flagged' AS kind FROM p WHERE page_id % 3 = 0 AND path LIKE 'sources/%' UNION ALL SELECT path, 'library' FROM p WHERE path LIKE '%.so'")
def flagged_union(spark, sf):
    rows = paths(spark, sf)
    flagged = rows.where((F.col("page_id") % 3 == 0) & F.col("path").startswith("sources/")).select("path", F.lit("flagged").alias("kind"))
    return flagged.unionByName(rows.where(F.col("path").endswith(".so")).select("path", F.lit("library").alias("kind")))


@query(rf"WITH {PATHS_SQL} SELECT app, regexp_extract(path, '([^/]*)$', 1) AS name, min(path) AS path, count(*) AS copies FROM p WHERE path LIKE '%.so' GROUP BY ALL")
def dedupe_libs(spark, sf):
    return G.first_libraries(paths(spark, sf).where(F.col("path").endswith(".so")), "path", _APP)


@query("""WITH n AS (SELECT 'Node' || s_suppkey AS cls, s_suppkey % 7 = 0 AS exported, s_suppkey % 3 = 0 AS flagged FROM supplier), t AS (SELECT count(*) AS total FROM n)
SELECT cls, exported, flagged, CASE WHEN exported THEN 0 WHEN flagged THEN 1 ELSE 2 END AS tier, total FROM n, t ORDER BY tier, lower(cls), cls LIMIT 120""")
def node_ranking(spark, sf):
    k = F.col("s_suppkey")
    nodes = read(spark, sf, "supplier").select(F.concat(F.lit("Node"), k.cast("string")).alias("cls"), (k % 7 == 0).alias("exported"), (k % 3 == 0).alias("flagged"))
    return G.ranked_nodes(nodes, "cls")


@query("SELECT s_nationkey, arg_min(CASE WHEN s_acctbal < 2000 THEN 'emulator-' ELSE 'usb-' END || s_name, (s_acctbal >= 2000, s_name)) AS serial FROM supplier GROUP BY s_nationkey")
def device_pick(spark, sf):
    """The first emulator of a nation, else its first device, by name."""
    virtual = F.col("s_acctbal") < 2000
    serial = F.concat(F.when(virtual, "emulator-").otherwise("usb-"), "s_name")
    return read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min_by(serial, F.struct(~virtual, F.col("s_name"))).alias("serial"))


@query("""SELECT doc_id, array_to_string(list_filter(['core', CASE WHEN contains(lower(text), 'token') THEN 'auth' END, CASE WHEN contains(lower(text), 'license') THEN 'legal' END, CASE WHEN contains(lower(text), '@') THEN 'pii' END], lambda x: x IS NOT NULL), ',') AS tags FROM documents""")
def tag_routing(spark, sf):
    lower = F.lower("text")
    tags = [F.lit("core")] + [F.when(lower.contains(w), t) for w, t in (("token", "auth"), ("license", "legal"), ("@", "pii"))]
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.filter(F.array(*tags), lambda x: x.isNotNull()), ",").alias("tags"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'core,BUILDING,AUTOMOBILE' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'core,AUTOMOBILE,BUILDING' ELSE 'core,' || c_mktsegment || ',BUILDING,AUTOMOBILE' END AS skills FROM customer")
def skill_order(spark, sf):
    last = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit("BUILDING"))).otherwise(F.array(F.lit("BUILDING"), F.lit("AUTOMOBILE")))
    names = F.array_distinct(F.concat(F.array(F.lit("core"), F.col("c_mktsegment"), F.lit("core")), last))
    return read(spark, sf, "customer").select("c_custkey", F.array_join(names, ",").alias("skills"))


# verdicts ---------------------------------------------------------------------------------------------------------------------------------


def findings(spark, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("scan"), F.concat(F.lit("F"), (F.col("turn") + 1).cast("string")).alias("finding_id"), "turn")


def actions(spark, sf: str) -> DataFrame:
    """Each turn judges a finding, or two at once, or one that doesn't exist, or with a word that isn't a status."""
    t = F.col("turn")
    status = F.when(t % 5 == 4, "maybe").when(t % 2 == 0, "verified").otherwise("not_verified")
    name = lambda n: F.concat(F.lit("F"), n.cast("string"))
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("scan"), t.alias("step"), F.when(t % 3 > 0, name(t * 2 % 7)).alias("finding_id"), F.when(t % 3 == 0, F.array(name(t + 1), name(t + 2))).alias("finding_ids"),
        status.alias("status"), F.col("text").alias("evidence"), F.col("role").alias("reason"),
    )


_SQL_VERDICTS = """f AS (SELECT conv_id AS scan, 'F' || (turn + 1) AS finding_id, turn FROM conversations),
a AS (SELECT conv_id AS scan, turn AS step, unnest(CASE WHEN turn % 3 > 0 THEN ['F' || turn * 2 % 7] ELSE ['F' || (turn + 1), 'F' || (turn + 2)] END) AS finding_id,
 CASE WHEN turn % 5 = 4 THEN 'maybe' WHEN turn % 2 = 0 THEN 'verified' ELSE 'not_verified' END AS status, text AS evidence, role AS reason FROM conversations),
k AS (SELECT a.*, row_number() OVER (PARTITION BY scan, finding_id ORDER BY step DESC, status DESC, evidence DESC, reason DESC) AS r FROM a SEMI JOIN f USING (scan, finding_id) WHERE status <> 'maybe'),
v AS (SELECT scan, finding_id, status, evidence, reason FROM k WHERE r = 1)"""


@query(f"WITH {_SQL_VERDICTS} SELECT * FROM v")
def verdict_batch(spark, sf):
    return V.recorded(actions(spark, sf), findings(spark, sf))


@query(f"""WITH {_SQL_VERDICTS} SELECT f.scan, f.finding_id, f.turn, CASE WHEN v.status = 'verified' THEN 'verified' ELSE 'not_verified' END AS status, coalesce(CASE WHEN v.status = 'verified' THEN evidence END, '-') AS evidence,
 coalesce(CASE WHEN v.status IS DISTINCT FROM 'verified' THEN coalesce(reason, '{V.NO_REASON}') END, '-') AS reason FROM f LEFT JOIN v USING (scan, finding_id)""")
def verdict_join(spark, sf):
    found = findings(spark, sf)
    judged = V.judged(found, V.recorded(actions(spark, sf), found))
    return judged.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("evidence", "reason")})


@query(f"WITH {_SQL_VERDICTS}, n AS (SELECT DISTINCT scan, finding_id FROM a WHERE step % 2 = 1) SELECT scan, finding_id, turn, true AS needed FROM f SEMI JOIN n USING (scan, finding_id) UNION ALL SELECT scan, finding_id, turn, false FROM f ANTI JOIN n USING (scan, finding_id)")
def needs_split(spark, sf):
    named = F.coalesce("finding_ids", F.array("finding_id"))
    needed = actions(spark, sf).where(F.col("step") % 2 == 1).select("scan", F.explode(named).alias("finding_id"))
    yes, no = V.needs_check(findings(spark, sf), needed)
    columns = ["scan", "finding_id", "turn"]
    return yes.select(*columns, F.lit(True).alias("needed")).unionByName(no.select(*columns, F.lit(False).alias("needed")))


@query("SELECT user_id, event_type, CAST(floor(value / 100) AS BIGINT) AS argument, min(event_id) AS first, count(*) AS n FROM events GROUP BY ALL")
def dedupe_calls(spark, sf):
    rows = read(spark, sf, "events").withColumn("argument", F.floor(F.col("value") / 100))
    return V.first_calls(rows, ["user_id", "event_type", "argument"], "event_id")


_SQL_ISLANDS = """l AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM l)"""


@query("""WITH s AS (SELECT user_id, event_id, event_type, coalesce(event_type = lag(event_type) OVER w, false) OR event_id % 6 = 0 AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM s),
r AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS n FROM g) SELECT user_id, event_id, event_type, CAST(n AS BIGINT) AS repeats, n > 0 AND n % 2 = 0 AS nudge FROM r""")
def stall_detection(spark, sf):
    said = F.when(F.col("event_id") % 6 == 0, "(already read to the end of it)").otherwise("text")
    rows = read(spark, sf, "events").select("user_id", "event_id", "event_type", said.alias("observed"))
    return V.stalls(rows, "user_id", "event_id", "event_type", "observed").drop("observed")


@query(f"WITH {_SQL_ISLANDS} SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY user_id, island, event_type HAVING count(*) >= 3")
def error_runs(spark, sf):
    return V.runs(read(spark, sf, "events"), "user_id", "event_id", "event_type")


@query("""SELECT user_id, event_id, coalesce(string_agg(event_type, '; ') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context FROM events""")
def last5_context(spark, sf):
    return V.last_context(read(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").drop("event_type")


@query(rf"""WITH {PATHS_SQL}, x AS (SELECT DISTINCT app, path FROM p WHERE page_id % 2 = 0), c AS (SELECT app, page_id, CASE page_id % 4 WHEN 0 THEN 'com/shop/p' || page_id || '.java' WHEN 1 THEN '/AndroidManifest.xml' WHEN 2 THEN path
 ELSE 'res/values/strings.xml' END AS ref FROM p), m AS (SELECT page_id, path, CASE path WHEN ref THEN 0 WHEN 'sources/' || ltrim(ref, '/') THEN 1 WHEN 'resources/' || ltrim(ref, '/') THEN 2 ELSE 3 END AS k
 FROM c JOIN x ON x.app = c.app AND regexp_extract(path, '([^/]*)$', 1) = regexp_extract(ref, '([^/]*)$', 1)) SELECT page_id, arg_min(path, (k, path)) AS path FROM m GROUP BY page_id""")
def path_resolution(spark, sf):
    rows, k = paths(spark, sf), F.col("page_id") % 4
    asked = F.when(k == 0, F.concat(F.lit("com/shop/p"), F.col("page_id").cast("string"), F.lit(".java"))).when(k == 1, " /AndroidManifest.xml").when(k == 2, F.col("path")).otherwise("res/values/strings.xml")
    return G.resolved_paths(rows.select("app", "page_id", asked.alias("file")), rows.where(F.col("page_id") % 2 == 0), ["page_id"], _APP)
