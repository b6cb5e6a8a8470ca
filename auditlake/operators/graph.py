"""The code graph: classes, references between them, sinks that they call, coverage of review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import SECRET_PATTERN

# Call signatures that show a family of sensitive sinks.
SINKS = {
    "sql": ("->execSQL", "->rawQuery", "SQLiteDatabase;->query", "->compileStatement"),
    "prefs": ("SharedPreferences", "getDefaultSharedPreferences"),
    "logging": ("Landroid/util/Log;",),
    "crypto": ("Ljavax/crypto/Cipher;", "MessageDigest;", "SecretKeySpec", "IvParameterSpec", "Ljava/security/"),
    "webview": ("->loadUrl", "->loadData", "addJavascriptInterface", "setJavaScriptEnabled", "->evaluateJavascript", "setAllowFileAccess"),
    "runtime": ("Ljava/lang/Runtime;->exec", "ProcessBuilder"),
    "storage": ("getExternalStorage", "->openFileOutput", "MODE_WORLD", "getExternalFilesDir", "Landroid/os/Environment;"),
    "uri": ("->getLastPathSegment", "->getQueryParameter"),
    "native": ("Ljava/lang/System;->loadLibrary", "Ljava/lang/System;->load"),
    "ipc": ("->getStringExtra", "->getData", "->getSerializableExtra", "->getParcelableExtra"),
    "display": ("Landroid/widget/TextView;->setText",),
}


def sink_families(call: Column, sinks: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Array of the families whose signatures a call contains, in the order of the table."""
    sinks = sinks or SINKS
    any_of = lambda keys: reduce(lambda a, b: a | b, (call.contains(k) for k in keys))
    return F.filter(F.array(*[F.when(any_of(keys), F.lit(name)) for name, keys in sinks.items()]), lambda x: x.isNotNull())


def secret_strings(literals: Column, most: int | None = None) -> Column:
    """Of the string constants of a class, in order, the first 60 characters of those that look like secrets; the first ``most``. A constant is
    left out if what is kept of an earlier one equals it, so that longer ones stay each time (they equal none)."""
    hits = F.filter(literals, lambda x: x.rlike(SECRET_PATTERN))
    short = lambda x: F.left(x, F.lit(60))
    kept = F.transform(
        F.array(hits),
        lambda own: F.transform(F.filter(own, lambda x, i: (F.length(x) > 60) | (F.array_position(F.transform(own, short), x) == i + 1)), short),
    ).getItem(0)
    return kept if most is None else F.slice(kept, 1, most)


def outer_class(name: Column) -> Column:
    return F.substring_index(name, "$", 1)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, null ones being equal to each other; the keys of the left side stay."""
    other = right.select(*[F.col(k).alias(f"of__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of__{k}")) for k in keys))
    return left.join(other, same, how).drop(*[f"of__{k}" for k in keys])


def signals(calls: DataFrame, cls: str, call: str, sinks: dict[str, tuple[str, ...]] | None = None, app: tuple[str, ...] = ()) -> DataFrame:
    """app, class, family, n of the sinks a class calls; nested classes count for the outer one."""
    families = calls.select(*app, outer_class(F.col(cls)).alias(cls), F.explode(sink_families(F.col(call), sinks)).alias("family"))
    return families.groupBy(*app, cls, "family").agg(F.count("*").alias("n"))


def vertices(classes: DataFrame, roles: DataFrame, cls: str, app: tuple[str, ...] = ()) -> DataFrame:
    """One row for each outer class of an app: its role in the manifest (else class) and what it extends (the outer class's first)."""
    outer = classes.withColumn("outer", outer_class(F.col(cls)))
    own = F.col(cls) == F.col("outer")
    grouped = outer.groupBy(*app, "outer").agg(
        F.max(F.when(own, F.col("extends"))).alias("own"), F.max_by("extends", cls).alias("nested"), F.count("*").alias("members")
    )
    found = grouped.select(*app, F.col("outer").alias(cls), F.coalesce("own", "nested").alias("extends"), "members")
    return matched(found, roles, [*app, cls]).withColumn("role", F.coalesce("role", F.lit("class")))


def native_callers(refs: DataFrame, loaders: DataFrame, most: int = 4, app: tuple[str, ...] = ()) -> DataFrame:
    """app, class and the first few, by name, of the app's native loaders that it refers to."""
    near = matched(refs, loaders.select(*app, F.col("cls").alias("ref")).distinct(), [*app, "ref"], "left_semi").where("ref <> cls").distinct()
    place = F.row_number().over(Window.partitionBy(*app, "cls").orderBy("ref"))
    return near.withColumn("n", place).where(F.col("n") <= most).groupBy(*app, "cls").agg(F.array_sort(F.collect_list("ref")).alias("loaders"))


def exported(role: Column) -> Column:
    """Whether a role is a component of the manifest that other apps may reach."""
    return role.isin("activity", "service", "receiver", "provider")


def ranked_nodes(nodes: DataFrame, cls: str, most: int = 120, app: tuple[str, ...] = ()) -> DataFrame:
    """Exported nodes, then flagged ones, then the others, by name; the first ``most`` (of each app), with how many there are in all."""
    tier = F.when(F.col("exported"), 0).when(F.col("flagged"), 1).otherwise(2)
    if app:
        own = Window.partitionBy(*app)
        placed = nodes.withColumn("tier", tier).withColumn("place", F.row_number().over(own.orderBy("tier", F.lower(cls), cls)))
        first = placed.where(F.col("place") <= most).drop("place")  # cut before anything is joined
        return matched(first, nodes.groupBy(*app).agg(F.count("*").alias("total")), list(app))
    total = nodes.agg(F.count("*").alias("total"))
    return nodes.withColumn("tier", tier).orderBy("tier", F.lower(cls), cls).limit(most).crossJoin(F.broadcast(total))  # one row


def first_values(rows: DataFrame, keys: list[str], value: str, order: list[str], most: int, name: str) -> DataFrame:
    """keys and the first distinct values, joined by commas; cut by a window before they are gathered."""
    first = rows.groupBy(*keys, value).agg(*[F.min(o).alias(f"by_{i}") for i, o in enumerate(order)])
    by = [f"by_{i}" for i in range(len(order))]
    cut = first.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("n") <= most)
    listed = F.array_sort(F.collect_list(F.struct("n", value)))
    return cut.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda s: s[value]), ", ").alias(name))


def code_graph(classes: DataFrame, roles: DataFrame, refs: DataFrame, calls: DataFrame, loaders: DataFrame, app: tuple[str, ...] = ()) -> DataFrame:
    """One node for each outer class of an app: app, cls, file, extends, role, exported, flagged, signals, refs.

    classes: cls, extends, file; roles: cls, role; refs: cls, ord, ref; calls: cls, call; loaders: cls of those that load native
    libraries; each with the columns ``app``, which name the package: classes of two packages never meet, whatever their names
    (without such columns all are of one). signals is an array of family and the first four calls by name, with native-call for
    the loaders that a class refers to; a loader that is not exported becomes a native-bridge. refs are the first five. Every
    list is cut before it is gathered.
    """
    key = [*app, "cls"]
    files = classes.groupBy(*app, outer_class(F.col("cls")).alias("cls")).agg(F.min("file").alias("file"))
    nodes = matched(vertices(classes, roles, "cls", app), files, key, "inner")
    nodes = matched(nodes, loaders.select(*key).distinct().withColumn("loads", F.lit(True)), key).withColumn("exported", exported(F.col("role")))
    nodes = nodes.withColumn("role", F.when(F.col("loads") & ~F.col("exported"), "native-bridge").otherwise(F.col("role"))).drop("loads", "members")
    called = calls.select(*app, outer_class(F.col("cls")).alias("cls"), F.explode(sink_families(F.col("call"))).alias("family"), "call")
    native = native_callers(refs.select(*key, "ref"), loaders, app=app).select(*key, F.lit("native-call").alias("family"), F.array_join("loaders", ", ").alias("names"))
    families = first_values(called, [*key, "family"], "call", ["call"], 4, "names").unionByName(native)  # a dozen families a class at most
    listed = F.array_sort(F.collect_list(F.struct("family", "names")))
    near = first_values(refs, key, "ref", ["ord", "ref"], 5, "refs")
    found = matched(matched(nodes, families.groupBy(*key).agg(listed.alias("signals")), key), near, key)
    return found.withColumn("flagged", F.col("signals").isNotNull())


def _signs(before: str, after: str) -> Column:
    said = F.transform("signals", lambda s: F.concat(s["family"], F.lit("("), s["names"], F.lit(")")))
    return F.when(F.col("signals").isNotNull(), F.concat(F.lit(before), F.array_join(said, "; "), F.lit(after)))


def node_lines(nodes: DataFrame) -> DataFrame:
    """The nodes and their line of the map: role, class, file, superclass (but the plainest), sinks and references."""
    plain = F.coalesce(F.col("extends"), F.lit("")).isin("", "Object", "AppCompatActivity")
    head = F.concat(F.lit("["), "role", F.lit("] "), "cls", F.lit(" ("), "file", F.lit(")"), F.when(plain, "").otherwise(F.concat(F.lit(" extends "), "extends")))
    bits = F.concat_ws(" | ", _signs("sinks: ", ""), F.concat(F.lit("refs: "), F.col("refs")))
    return nodes.withColumn("line", F.when(bits == "", head).otherwise(F.concat(head, F.lit("\n    "), bits)))


def rendered(nodes: DataFrame, most: int = 120, app: tuple[str, ...] = ()) -> DataFrame:
    """The map of each app: lines of the first nodes (exported, flagged, others; by name) with their tier and the number of nodes in all."""
    return ranked_nodes(node_lines(nodes), "cls", most, app).select(*app, "tier", "cls", "line", "total")


def entry_points(nodes: DataFrame, app: tuple[str, ...] = ()) -> DataFrame:
    """The short map: exported nodes and what they call, - for nothing."""
    signs = F.coalesce(_signs("", ""), F.lit("-"))
    return nodes.where("exported").select(*app, "cls", F.concat(F.lit("["), "role", F.lit("] "), "cls", F.lit(" ("), "file", F.lit("): "), signs).alias("line"))


def _base(path: str | Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolved_paths(wanted: DataFrame, files: DataFrame, keys: list[str], app: tuple[str, ...] = ()) -> DataFrame:
    """keys, path of the file of the same app that a report means: as given, in sources/, in resources/, else the first with the same base
    name. Every rung implies equal base names, so the app and that are the join's key: a manifest or strings file, which each
    app has, meets its own app's alone. Blank and unknown files have no row."""
    asked = wanted.withColumn("asked", F.ltrim(F.trim("file"), F.lit("/"))).withColumn("base", _base("asked")).where("base <> ''")
    pairs = matched(asked, files.select(*app, "path", _base("path").alias("base")).distinct(), [*app, "base"], "inner")
    rung = F.when(F.col("path") == F.col("asked"), 0)
    for i, folder in enumerate(("sources/", "resources/"), 1):
        rung = rung.when(F.col("path") == F.concat(F.lit(folder), "asked"), i)
    return pairs.groupBy(*keys).agg(F.min_by("path", F.struct(rung.otherwise(3), F.col("path"))).alias("path"))


def unread(targets: DataFrame, read: DataFrame, path: str, app: tuple[str, ...] = ()) -> DataFrame:
    """Files that ought to be read and were not."""
    return matched(targets.select(*app, path).distinct(), read.select(*app, path).distinct(), [*app, path], "left_anti")


def cited_file(path: Column) -> Column:
    """The file that a finding cites: without leading dots and slashes, backslashes turned, without what stands behind a colon."""
    return F.substring_index(F.replace(F.ltrim(F.trim(path), F.lit("./")), F.lit("\\"), F.lit("/")), ":", 1)


def node_of_file(files: DataFrame, nodes: DataFrame, app: tuple[str, ...] = ()) -> DataFrame:
    """app, file, node, tier: the app's node of each file: equal paths or one the end of the other after a slash, else equal base names; the first
    in order. A file may come as findings cite it, with ./ before and :line behind.

    Either tier implies equal base names, so the app and that are the join's key, and no file is compared with every node.
    """
    asked = files.select(*app, "file").distinct().withColumn("cited", cited_file(F.col("file"))).withColumn("base", _base("cited"))
    pair = matched(asked.where("base <> ''"), nodes.withColumn("base", _base("node_file")), [*app, "base"], "inner")
    f, n = F.col("cited"), F.col("node_file")
    near = (f == n) | f.endswith(F.concat(F.lit("/"), n)) | n.endswith(F.concat(F.lit("/"), f))
    tier = F.when(near, 0).otherwise(1)
    best = pair.groupBy(*app, "file").agg(F.min(F.struct(tier.alias("tier"), "ord", "node")).alias("b"))
    return best.select(*app, "file", "b.node", "b.tier")


def first_libraries(libs: DataFrame, path: str, app: tuple[str, ...] = ()) -> DataFrame:
    """One path for each library file name of an app: the first in sorted order."""
    return libs.groupBy(*app, F.substring_index(path, "/", -1).alias("name")).agg(F.min(path).alias("path"), F.count("*").alias("copies"))
