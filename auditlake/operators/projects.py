"""Project folders: what their files and folders say about the framework, their make-up, and how complete an analysis's inputs are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Framework, whether the sign is needed for a match, path (a file, a folder, or * and an ending), weight, text that a file must hold.
SIGNS = [
    ("Flutter", True, "pubspec.yaml", 0.1, None),
    ("Flutter", True, "lib/main.dart", 0.1, None),
    ("Flutter", False, "android/app/build.gradle", 0.05, None),
    ("Flutter", False, "ios/Runner.xcodeproj", 0.05, None),
    ("Flutter", False, "flutter_assets", 0.05, None),
    ("Flutter", False, "build/app/intermediates", 0.05, None),
    ("React Native", True, "package.json", 0.1, '"react-native"'),
    ("React Native", True, "node_modules/react-native", 0.1, None),
    ("React Native", True, "metro.config.js", 0.1, None),
    ("React Native", False, "react-native.config.js", 0.1, None),
    ("React Native", False, "ios/Podfile", 0.1, None),
    *[("Cordova", True, p, 0.1, None) for p in ("config.xml", "www/index.html", "www/cordova.js", "platforms/android", "plugins")],
    *[("Xamarin", True, p, 0.05, None) for p in ("*.sln", "*.xaml", "Resources", "Properties/AndroidManifest.xml")],
    ("Xamarin", True, "*.csproj", 0.05, "Xamarin"),
    *[("Unity", True, p, 0.05, None) for p in ("Assets", "ProjectSettings", "Library", "*.unity")],
    *[("Unreal Engine", True, p, 0.05, None) for p in ("Config", "Content", "Source", "*.uproject")],
    *[("LibGDX", True, p, 0.06, None) for p in ("android", "core", "desktop", "ios")],
    ("LibGDX", True, "build.gradle", 0.06, "com.badlogicgames.gdx"),
    *[("Kony", True, p, 0.05, None) for p in ("kony", "KonyApps", "modules/kony", "kony.properties", "projectProperties.json", "forms")],
    *[("Java", True, p, 0.3, None) for p in ("AndroidManifest.xml", "src/main/java", "app/src/main/java", "res", "app/src/main/res")],
    *[("Java", True, p, 0.2, None) for p in ("build.gradle", "app/build.gradle", "build.gradle.kts", "app/build.gradle.kts", "gradle.properties")],
    ("Java", True, "*.java", 0.5, None),
    ("Kotlin", True, "src/main/kotlin", 0.8, None),
    ("Kotlin", True, "*.kt", 0.6, None),
    ("Kotlin", True, "app/build.gradle.kts", 0.4, "kotlin"),
    ("Kotlin", True, "build.gradle.kts", 0.2, "kotlin"),
    *[("Native (C/C++)", True, p, 0.4, None) for p in ("jni", "src/main/cpp", "src/main/jni", "app/src/main/cpp")],
    *[("Native (C/C++)", True, p, 0.3, None) for p in ("ndk-build", "Android.mk", "Application.mk", "CMakeLists.txt")],
    ("Native (C/C++)", True, "*.cpp", 0.5, None),
]
#: Confidence without signs, and the most it reaches.
BASE = {"Flutter": (0.8, 1.0), "React Native": (0.7, 1.0), "Cordova": (0.6, 0.95), "Xamarin": (0.7, 0.95), "Unity": (0.75, 0.98), "Unreal Engine": (0.75, 0.98),
        "LibGDX": (0.7, 0.95), "Kony": (0.7, 0.95), "Java": (0.0, 1.0), "Kotlin": (0.0, 1.0), "Native (C/C++)": (0.0, 1.0)}
EXTENSIONS = {"java": ".java", "kotlin": ".kt", "dart": ".dart", "script": ".js", "native_libs": ".so", "layouts": ".xml"}
SKILLS = {
    "manifest_review": (("manifest",), None),
    "network_security": (("ssl", "trust", "http", "cert", "hostname", "network", "socket"), None),
    "offensive_android": ((".so", "jni", "native"), "inspect_native"),
}
ALLOWED_COMMANDS = ("logcat", "run-as", "dumpsys", "pm", "am", "input", "screencap", "getprop", "pidof")


def _there(path: Column, sign: str) -> Column:
    return path.endswith(sign[1:]) if sign.startswith("*") else (path == sign) | path.startswith(f"{sign}/")


def project_hits(files: DataFrame, project: str = "project") -> DataFrame:
    """project, ord, framework, signs, confidence from the files (project, path, text) of project folders. One pass: each sign is a flag
    of the same aggregate, and a framework counts if one of its needed signs is there."""
    path, text = F.col("path"), F.coalesce("text", F.lit(""))
    flag = lambda s, needs: _there(path, s) & text.contains(needs) if needs else _there(path, s)
    flags = files.groupBy(project).agg(*[F.max(flag(s, needs)).cast("int").alias(f"f{k}") for k, (_, _, s, _, needs) in enumerate(SIGNS)])
    rows = []
    for place, (name, (base, most)) in enumerate(BASE.items()):
        own = [(k, needed, w) for k, (f, needed, _, w, _) in enumerate(SIGNS) if f == name]
        signs = reduce(lambda a, b: a + b, (F.col(f"f{k}") for k, _, _ in own))
        weight = reduce(lambda a, b: a + b, (F.col(f"f{k}") * F.lit(w) for k, _, w in own), F.lit(base))
        found = reduce(lambda a, b: a + b, (F.col(f"f{k}") for k, needed, _ in own if needed)) > 0
        rows.append(F.when(found, F.struct(F.lit(place).alias("ord"), F.lit(name).alias("framework"), signs.alias("signs"), F.least(F.lit(most), weight).alias("confidence"))))
    return flags.select(project, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select(project, "r.*")


def cordova_confidence(web: Column, classes: Column) -> Column:
    """Confidence of a package with so many web files and classes of the framework: higher if both are there."""
    n = web + classes
    return F.when((web > 0) & (classes > 0), F.least(F.lit(0.98), F.lit(0.85) + n * 0.02)).when(n > 0, F.least(F.lit(0.9), F.lit(0.6) + n * 0.1))


def structure(files: DataFrame, project: str = "project") -> DataFrame:
    """Files by kind, all files, and whether there is a build file."""
    build = F.substring_index("path", "/", -1).isin("pubspec.yaml", "package.json", "build.gradle", "CMakeLists.txt")
    counts = [F.count_if(F.col("path").endswith(e)).alias(k) for k, e in EXTENSIONS.items()]
    return files.groupBy(project).agg(*counts, F.count("*").alias("files"), F.bool_or(build).alias("has_build_file"))


def content_blob(files: DataFrame, project: str, most: int = 1_000_000) -> DataFrame:
    """Paths of a project joined by spaces in order, cut to a length; a path that starts beyond it is never gathered, but for the one whose
    space is the last character. Null without any path."""
    from pyspark.sql import Window

    before = Window.partitionBy(project).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    near = files.withColumn("before", F.coalesce(F.sum(F.length("path") + 1).over(before), F.lit(0))).where(F.col("before") <= most)
    listed = F.array_sort(F.collect_list("path"))
    return near.groupBy(project).agg(F.when(F.size(listed) > 0, F.left(F.array_join(listed, " "), F.lit(most))).alias("blob"))


def completeness(sources: Column, manifest: Column, build: Column) -> tuple[Column, Column]:
    """Percentage of the inputs that are there (40, 30, 30) and its level."""
    given = lambda c, w: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, w).otherwise(0)
    percent = given(sources, 40) + given(manifest, 30) + given(build, 30)
    return percent, F.when(percent >= 80, "complete").when(percent >= 50, "partial").otherwise("minimal")


def allowed_command(command: Column) -> Column:
    """Whether a logged device command is one of those that reviews may use, after an optional prefix."""
    bare = F.regexp_replace(F.trim(command), r"^(adb\s+(-s\s+\S+\s+)?)?(shell\s+)?", "")
    return F.lower(F.regexp_extract(bare, r"^(\S+)", 1)).isin(*ALLOWED_COMMANDS)


def contextual_skills(action: Column, path: Column, pattern: Column) -> Column:
    """Array of the skills that a step calls for, by words in its path and pattern and by its action, in the order of the table."""
    said = F.lower(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(pattern, F.lit(""))))
    any_of = lambda words: reduce(lambda a, b: a | b, (said.contains(w) for w in words))
    wanted = [F.when(any_of(words) | (F.coalesce(action == of, F.lit(False)) if of else F.lit(False)), F.lit(skill)) for skill, (words, of) in SKILLS.items()]
    return F.filter(F.array(*wanted), lambda x: x.isNotNull())


def first_source(*candidates: Column) -> Column:
    """The first candidate that holds anything: manifests are acquired in several ways, best first."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, c) for c in candidates])
