"""Indicator matching: entries of packages against literal indicators, and the confidence of frameworks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# File names that show a framework inside a package, in the order in which frameworks are tried, and the
# confidence of each for n indicators: least of the cap and base + step * n.
TECHNOLOGIES = {
    "Flutter": ("libflutter.so", "assets/flutter_assets/", "isolate_snapshot"),
    "React Native": ("libreactnativejni.so", "assets/index.android.bundle", "index.bundle", "libhermes.so", "libjsi.so"),
    "Cordova": ("assets/www/index.html", "assets/www/cordova.js", "assets/www/cordova_plugins.js"),
    "Xamarin": (
        "assemblies/Sikur.Monodroid.dll", "assemblies/Sikur.dll", "assemblies/Xamarin.Mobile.dll", "assemblies/mscorlib.dll",
        "libmonodroid.so", "libmonosgen-2.0.so",
    ),
    "Unity": ("libunity.so", "assets/bin/Data/Managed/UnityEngine.dll", "assets/bin/Data/Managed/UnityEditor.dll"),
    "Unreal Engine": ("libUE4.so", "assets/Unreal/UE4Game/Manifest.xml"),
    "LibGDX": ("libgdx.so", "assets/libgdx/lwjgl.so", "assets/libgdx.jar"),
    "Expo": ("assets/shell-app.bundle", "assets/expo-manifest.json"),
    "Kony": ("assets/kony.js", "assets/konyframework.js", "assets/KonyApps/config.json"),
}
CONFIDENCE = {
    "Flutter": (0.95, 0.8, 0.05),
    "React Native": (0.95, 0.8, 0.05),
    "Cordova": (0.9, 0.6, 0.1),
    "Xamarin": (0.95, 0.7, 0.05),
    "Unity": (0.95, 0.7, 0.1),
    "Unreal Engine": (0.95, 0.75, 0.1),
    "LibGDX": (0.95, 0.7, 0.1),
    "Kony": (0.95, 0.7, 0.1),
}
CORDOVA_BOTH = (0.98, 0.85, 0.02)
UNSUPPORTED = ("flutter", "react native", "cordova", "xamarin", "unity", "unreal", "libgdx", "expo", "kony", "hybrid")


def confidence(n: Column, cap: float, base: float, step: float) -> Column:
    return F.least(F.lit(cap), F.lit(base) + n * F.lit(step))


def hits(entries: DataFrame, app: str, entry: str, indicators: tuple[str, ...]) -> DataFrame:
    """app and an array of the distinct indicators that any of its entries contains, sorted. The list is short and literal, so it is
    tested inside the scan; the arrays are combined by app."""
    flags = [F.max(F.col(entry).contains(i)).alias(f"i{k}") for k, i in enumerate(indicators)]
    found = entries.groupBy(app).agg(*flags)
    named = F.array(*[F.when(F.col(f"i{k}"), F.lit(i)) for k, i in enumerate(indicators)])
    return found.select(app, F.array_sort(F.filter(named, lambda x: x.isNotNull())).alias("indicators"))


def framework_hits(entries: DataFrame, app: str, entry: str, technologies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """app, ord, framework, n (distinct indicators) of every framework found. One pass over the entries whatever the number of
    frameworks: each is a flag column of the same aggregate."""
    technologies = technologies or TECHNOLOGIES
    flat = [(k, name, i) for k, (name, own) in enumerate(technologies.items()) for i in own]
    flags = entries.groupBy(app).agg(*[F.max(F.col(entry).contains(i)).cast("int").alias(f"f{j}") for j, (_, _, i) in enumerate(flat)])
    counts = []
    for k, name in enumerate(technologies):
        n = reduce(lambda a, b: a + b, (F.col(f"f{j}") for j, (own, _, _) in enumerate(flat) if own == k))
        counts.append(F.struct(F.lit(k).alias("ord"), F.lit(name).alias("framework"), n.alias("n")))
    return flags.select(app, F.explode(F.array(*counts)).alias("c")).select(app, "c.*").where("n > 0")


def with_confidence(found: DataFrame) -> DataFrame:
    """Adds the confidence of each framework; one without a formula of its own gets that of the generic detector."""
    n = F.col("n")
    value = reduce(lambda c, kv: c.when(F.col("framework") == kv[0], confidence(n, *kv[1])), CONFIDENCE.items(), F.when(F.lit(False), F.lit(0.0)))
    return found.withColumn("confidence", value.otherwise(F.lit(0.9)))


def generic_detection(found: DataFrame, app: str) -> DataFrame:
    """One framework: 0.9. Several: the first in order at 0.85 and how many more."""
    grouped = found.groupBy(app).agg(F.min_by("framework", "ord").alias("framework"), F.count("*").alias("n"))
    return grouped.select(app, "framework", F.when(F.col("n") == 1, F.lit(0.9)).otherwise(F.lit(0.85)).alias("confidence"), (F.col("n") - 1).alias("more"))


def platform_hits(entries: DataFrame, app: str, entry: str) -> DataFrame:
    """app, ord, framework, n, confidence of the platform detectors: Java by its bytecode without another framework's files, Kotlin by
    the app's name, native code by its libraries and their architectures."""
    e = F.col(entry)
    other = reduce(lambda a, b: a | b, (e.contains(i) for f in ("Flutter", "React Native", "Unity", "Unreal Engine") for i in TECHNOLOGIES[f]))
    library = e.rlike(r"^lib/.*\.so$")
    facts = entries.groupBy(app).agg(
        F.max(e.rlike(r"^classes.*\.dex$")).alias("dex"),
        F.max(other).alias("other"),
        F.max(library).alias("lib"),
        F.count_if(library).alias("n"),
        F.max(e.rlike(r"^lib/(armeabi-v7a|arm64-v8a|x86|x86_64)/")).alias("arch"),
    )
    name = F.lower(F.col(app).cast("string"))
    native = F.least(F.lit(1.0), F.when(F.col("lib"), 0.8).otherwise(0.0) + F.when(F.col("arch"), 0.4).otherwise(0.0) + F.when(name.contains("native"), 0.3).otherwise(0.0))
    rows = F.array(
        F.struct(F.lit(9).alias("ord"), F.lit("Java").alias("framework"), F.when(F.col("dex") & ~F.col("other"), F.lit(0.8)).alias("confidence")),
        F.struct(F.lit(10).alias("ord"), F.lit("Kotlin").alias("framework"), F.when(name.contains("kotlin"), F.lit(0.9)).alias("confidence")),
        F.struct(F.lit(11).alias("ord"), F.lit("Native (C/C++)").alias("framework"), F.when(native > 0, native).alias("confidence")),
    )
    return facts.select(app, F.col("n"), F.explode(rows).alias("r")).select(app, "n", "r.*").where("confidence is not null")


def suppressed(found: DataFrame, app: str) -> DataFrame:
    """Without native code where an app framework (0.8 or more) or bytecode (0.5 or more) is found: bundled libraries are common."""
    strong = F.col("framework").isin("Flutter", "React Native", "Expo") & (F.col("confidence") >= 0.8)
    strong = strong | (F.col("framework").isin("Java", "Kotlin") & (F.col("confidence") >= 0.5))
    other = F.max(strong).over(Window.partitionBy(app))
    return found.withColumn("strong", other).where(~(F.col("strong") & (F.col("framework") == "Native (C/C++)"))).drop("strong")


def primary(found: DataFrame, app: str) -> DataFrame:
    """app and the framework with the highest confidence, the first in order on ties."""
    best = F.max_by(F.struct("framework", "confidence"), F.struct("confidence", -F.col("ord")))
    return found.groupBy(app).agg(best.alias("b")).select(app, "b.*")


def last_scores(found: DataFrame, app: str) -> DataFrame:
    """Confidence by framework name: the last in detector order wins."""
    return found.groupBy(app, "framework").agg(F.max_by("confidence", "ord").alias("last"), F.max("confidence").alias("best"))


def weighted_score(texts: DataFrame, text: str, weights: dict[str, int]) -> DataFrame:
    """score (sum of the weights of the indicators a text contains, whatever the case) and confidence (its share of all weights)."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    score = reduce(lambda a, b: a + b, (F.when(lower.contains(i.lower()), w).otherwise(0) for i, w in weights.items()))
    total = sum(weights.values())
    share = F.least(F.lit(1.0), F.col("score") / total) if total else F.lit(0.0)
    return texts.withColumn("score", score).withColumn("confidence", share)


def supported(framework: Column) -> Column:
    """Whether sources of a framework can be reviewed. The list knows unreal, detectors say Unreal Engine, so that passes."""
    return ~F.lower(framework).isin(*UNSUPPORTED)
