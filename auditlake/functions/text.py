"""Scalar functions over text, paths, sizes and durations, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns of strings that frameworks define, path fragments of bundled code, file name prefixes of bundled
# layouts, resource folders with qualifiers, class prefixes of bundled code, secret patterns.
STRING_PREFIXES = (
    "android.", "com.android.", "androidx.", "com.google.", "java.", "javax.", "org.apache.", "kotlin.", "io.flutter.", "abc_", "androidx_",
    "appbar_", "bottom_sheet_", "bottomsheet_", "character_counter_", "clear_text_", "error_", "exposed_dropdown_", "fab_", "hide_bottom_",
    "icon_content_", "item_view_", "m3_", "material_", "mtrl_", "password_toggle_", "path_password_", "search_menu_", "searchbar_",
    "searchview_", "side_sheet_", "status_bar_",
)
STRING_NAMES = (
    "true", "false", "null", "undefined", "NaN", "Infinity", "onCreate", "onDestroy", "onPause", "onResume", "onStart", "onStop", "main",
    "test", "debug", "release", "profile", "search_menu_title", "submit",
)
STRING_PATTERN = r"(?i)^android\.|^com\.android\.|^androidx\.|^com\.google\.|^\$\{.*\}$|^@\w+/|^\d+$|^[a-f0-9]{8,}$"
BUNDLED_FRAGMENTS = ("/androidx/", "/android/", "/kotlin/", "/kotlinx/", "/com/google/", "/org/jetbrains/", "/org/intellij/")
BUNDLED_LAYOUTS = r"^(mtrl_|abc_|design_|material_|m3_|notification_|select_dialog_|support_|test_|tooltip)"
QUALIFIED_RESOURCE = r"^/?([^/]+/)*?res/(values|drawable|layout|color|mipmap|anim|menu)-"
BUNDLED_CLASSES = (
    "Landroid/", "Landroidx/", "Lkotlin/", "Lkotlinx/", "Ljava/", "Ljavax/", "Lcom/google/", "Lorg/jetbrains/", "Lorg/intellij/", "Ldalvik/",
    "Lorg/xmlpull/", "Lorg/apache/", "Lorg/json/", "Lorg/w3c/", "Lorg/xml/", "Lorg/hamcrest/", "Ljunit/", "Lorg/junit/",
)
SECRET_PATTERN = r"(?i)(secret|passw|api[_-]?key|token|credential|private[_-]?key|-----BEGIN|https?://|[A-Za-z0-9+/]{24,}={0,2})"
URL_PATTERN = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
PERMISSION_PATTERNS = (r'<uses-permission\s+android:name="([^"]+)"', r'android:permission="([^"]+)"', r'E: uses-permission.*name="([^"]+)"')
SENTINELS = ("", "N/A", "Unknown", "None")


def starts_with_any(text: Column, prefixes: tuple[str, ...]) -> Column:
    quoted = "|".join(p.replace(".", r"\.") for p in prefixes)
    return text.rlike(f"^({quoted})")


def user_defined(name: Column, with_patterns: bool = True) -> Column:
    """Whether a resource string's name is the app's own and not a framework's."""
    own = F.trim(name)
    good = (own != "") & ~own.isin(*STRING_NAMES) & ~starts_with_any(own, STRING_PREFIXES)
    return good & ~own.rlike(STRING_PATTERN) if with_patterns else good


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def bundled_layout(path: Column) -> Column:
    return base_name(path).rlike(BUNDLED_LAYOUTS)


def bundled_path(path: Column) -> Column:
    """Whether a path is library code or a library's or qualified resource."""
    probe = F.concat(F.lit("/"), path)
    inside = probe.rlike("|".join(BUNDLED_FRAGMENTS))
    return inside | bundled_layout(path) | path.rlike(QUALIFIED_RESOURCE)


def app_class(descriptor: Column) -> Column:
    """Whether a class descriptor is the app's own: no library's, no generated class."""
    short = class_name(descriptor)
    return descriptor.startswith("L") & ~starts_with_any(descriptor, BUNDLED_CLASSES) & ~short.rlike(r"^(R|BuildConfig)(\$|$)")


def class_name(descriptor: Column) -> Column:
    """Short name of a class descriptor."""
    return base_name(F.regexp_replace(descriptor, "^L|;$", ""))


def source_path(descriptor: Column) -> Column:
    """Source file of a class descriptor; nested classes stand in their outer class's file."""
    return F.concat(F.lit("sources/"), F.regexp_replace(F.regexp_replace(descriptor, "^L|;$", ""), r"\$.*$", ""), F.lit(".java"))


def clean(value: Column) -> Column:
    """Null for a value that stands for none."""
    return F.when(~F.trim(value).isin(*SENTINELS), value)


def line_span(value: Column) -> Column:
    """struct<s, e> of the first two whole numbers in a text, in order; one number is both; null if there is none."""
    numbers = F.regexp_extract_all(value, F.lit(r"(\d+)"), F.lit(1))
    first, second = F.try_element_at(numbers, F.lit(1)).cast("int"), F.try_element_at(numbers, F.lit(2)).cast("int")
    second = F.coalesce(second, first)
    return F.when(first.isNotNull(), F.struct(F.least(first, second).alias("s"), F.greatest(first, second).alias("e")))


def location_text(value: Column) -> Column:
    span = line_span(value)
    return (
        F.when(span.isNull() | (span["s"] == 0), value)
        .when(span["s"] == span["e"], F.concat(F.lit("line "), span["s"].cast("string")))
        .otherwise(F.concat(F.lit("lines "), span["s"].cast("string"), F.lit("-"), span["e"].cast("string")))
    )


def derived_title(description: Column) -> Column:
    """First sentence of a description, at most 80 characters. These follow from its first 81 characters with white space folded, so only
    where the start doesn't hold as many is the whole folded."""
    folded = lambda text: F.trim(F.regexp_replace(text, r"\s+", " "))

    def title(text: Column) -> Column:
        head = F.regexp_extract(text, r"^(.*?[.!?])\s", 1)
        said = F.when(head == "", text).otherwise(head)
        said = F.when(F.length(said) > 80, F.concat(F.rtrim(F.left(said, F.lit(77))), F.lit("..."))).otherwise(said)
        return F.when(F.coalesce(text, F.lit("")) == "", "Security Issue").otherwise(said)

    start = F.transform(F.array(folded(F.left(description, F.lit(400)))), lambda text: F.when(F.length(text) > 90, text).otherwise(folded(description)))
    return F.transform(start, title).getItem(0)


def half_even(x: Column, digits: int) -> Column:
    """A double of so many decimals, halves to even once it is scaled as a double; a negative zero keeps its sign."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def tenths(x: Column) -> Column:
    """A number with one decimal, halves to even."""
    return F.format_string("%.1f", half_even(x, 1))


def duration(seconds: Column) -> Column:
    """1h 2m 3s; 59.5s below a minute; 250.0ms below a second; 0s if negative."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    long = F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in ((h, "h"), (m, "m"), (s, "s"))])
    return (
        F.when(seconds < 0, "0s")
        .when(seconds < 1, F.concat(tenths(seconds * 1000), F.lit("ms")))
        .when(seconds < 60, F.concat(tenths(seconds), F.lit("s")))
        .otherwise(long)
    )


def file_size(size: Column) -> Column:
    """Size with one decimal in bytes, KB, MB or GB."""
    k = 1024.0
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" bytes")))
        .when(size < 1024**2, F.concat(tenths(size / k), F.lit(" KB")))
        .when(size < 1024**3, F.concat(tenths(size / k**2), F.lit(" MB")))
        .otherwise(F.concat(tenths(size / k**3), F.lit(" GB")))
    )


def client_size(size: Column) -> Column:
    """Size as clients show it: B, KB and MB with one decimal, GB with two; a dash for none."""
    k = 1024.0
    return (
        F.when(size.isNull(), "—")
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, F.concat(tenths(size / k), F.lit(" KB")))
        .when(size < 1024**3, F.concat(tenths(size / k**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.2f", half_even(size / k**3, 2)), F.lit(" GB")))
    )


def short_date(when: Column) -> Column:
    """Day of a time as in Mar 5, 2024; null for none."""
    return F.date_format(when, "MMM d, yyyy")


def time_ago(then: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    said = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(u))
    return F.when(seconds < 60, "just now").when(seconds < 3600, said(60, "m ago")).when(seconds < 86400, said(3600, "h ago")).otherwise(said(86400, "d ago"))


def score_colour(score: Column) -> Column:
    return F.when(score >= 85, "green").when(score >= 65, "yellow").when(score >= 40, "orange").otherwise("red")


def safe_file_name(name: Column) -> Column:
    """A name without characters that file systems refuse, at most 200 long; unknown if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f\x7f-\x9f]", "")
    kept = F.regexp_replace(kept, r"^[ .]+|[ .]+$", "")
    return F.when(F.coalesce(kept, F.lit("")) == "", "unknown").otherwise(F.left(kept, F.lit(200)))


def upload_name(name: Column) -> Column:
    """Name of an uploaded file: the last part of its path, in letters, digits, dot, dash and underscore."""
    return F.regexp_replace(base_name(F.regexp_replace(name, r"\\", "/")), r"[^A-Za-z0-9._-]", "_")


def fold_quotes(text: Column) -> Column:
    """Straight quotes for typographic ones; escaped quotes unescaped."""
    straight = F.translate(text, "“”‘’", "\"\"''")
    return F.replace(F.replace(straight, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - len(suffix))), F.lit(suffix))).otherwise(text)


def urls(text: Column) -> Column:
    """Distinct URLs of a text, sorted. The character class holds a range from $ to _, as its users expect."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))))


def collapsed(text: Column) -> Column:
    """Text without control characters, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\s+", " "))


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")))


def code_blocks(text: Column) -> Column:
    """Trimmed contents of fenced blocks that hold anything."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w+)?\n(.*?)```"), F.lit(1))
    return F.filter(F.transform(found, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def normal_path(path: Column) -> Column:
    """Path with / and without any leading dots and slashes (all of them, not just one ./)."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def cwe_link(cwe: Column) -> Column:
    number = F.regexp_extract(cwe, r"(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")))


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quoted_literal(instruction: Column) -> Column:
    """What stands between the first and the last quote; null if there are none."""
    found = F.regexp_extract(instruction, r'"(.*)"', 1)
    return F.when(instruction.rlike(r'".*"'), found)


def package_of_source(text: Column) -> Column:
    """Package that a source names in a statement with a semicolon; null if none."""
    found = F.regexp_extract(text, r"package\s+([a-zA-Z_][\w.]*)\s*;", 1)
    return F.when(found != "", found)


def architecture(abi: Column) -> Column:
    """Short architecture of a device ABI."""
    return (
        F.when(abi.startswith("arm64"), "arm64")
        .when(abi.startswith("armeabi"), "arm")
        .when(abi == "x86_64", "x86_64")
        .when(abi.startswith("x86"), "x86")
    )


def first_tag_text(xml: Column, tag: str) -> Column:
    """Text of the first element of a name; null if there is none."""
    found = F.regexp_extract(xml, f"(?is)<{tag}(?:\\s[^>]*)?>([^<]*)<", 1)
    return F.when(found != "", F.trim(found))


def without_thinking(text: Column) -> Column:
    """Text without paired think tags and what they hold; after a lone closing tag only what follows the last one."""
    left = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.trim(F.when(left.rlike("(?i)</think>"), F.regexp_replace(left, r"(?is)^.*</think>", "")).otherwise(left))


def public_url(url: Column) -> Column:
    """Whether a URL is http(s) and its host no loopback, private or link-local address."""
    host = F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)
    local = host.rlike(r"^(localhost|0\.0\.0\.0|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[?::1)")
    return (host != "") & ~local


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, for sorting; parts that are no numbers count 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def error_count(log: Column) -> Column:
    """The number that a log says it counted (ERROR - 12), else how often it says ERROR."""
    named = F.regexp_extract(log, r"ERROR - (\d+)", 1)
    return F.when(named != "", named.try_cast("bigint")).otherwise(F.regexp_count(log, F.lit("ERROR"))).cast("long")
