"""Rules over manifests and layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import PERMISSION_PATTERNS, user_defined
from auditlake.operators.manifests import manifests

# Permissions that deserve a word, words of login screens, words of manifests in binary files.
DANGEROUS_PERMISSIONS = tuple(
    f"android.permission.{p}"
    for p in (
        "READ_EXTERNAL_STORAGE", "WRITE_EXTERNAL_STORAGE", "CAMERA", "RECORD_AUDIO", "ACCESS_FINE_LOCATION", "ACCESS_COARSE_LOCATION",
        "READ_CONTACTS", "WRITE_CONTACTS", "READ_SMS", "SEND_SMS", "READ_PHONE_STATE", "CALL_PHONE", "INSTALL_PACKAGES",
        "SYSTEM_ALERT_WINDOW", "WRITE_SETTINGS",
    )
)
LOGIN_WORDS = ("login", "log in", "sign in", "signin", "username", "password", "email", "phone")
MANIFEST_WORDS = (
    "permission", "activity", "service", "receiver", "provider", "intent", "action", "category", "data", "android:", "package",
    "versioncode", "versionname",
)


def permissions(xml: Column) -> Column:
    """Distinct permissions that a manifest asks for or guards with, sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(xml, F.lit(p), F.lit(1)) for p in PERMISSION_PATTERNS]))
    return F.array_sort(F.array_distinct(found))


def dangerous(permission: Column) -> Column:
    return permission.isin(*DANGEROUS_PERMISSIONS)


def manifest_flags(xml: Column) -> dict[str, Column]:
    """Switches that a manifest turns on by the text of their attributes."""
    on = lambda name: xml.contains(f'android:{name}="true"')
    return {
        "debuggable": on("debuggable"),
        "allow_backup": on("allowBackup"),
        "cleartext": on("usesCleartextTraffic"),
        "network_config": xml.contains("networkSecurityConfig"),
        "test_only": on("testOnly"),
    }


def manifest_issues(apps: DataFrame, app: str) -> DataFrame:
    """app, rule, severity: a row for each rule that an app breaks. Apps have permissions (array), exported (array of the names of
    components exported without a permission) and the flags."""
    plain = (
        (F.col("debuggable"), "debuggable", "HIGH"),
        (F.col("allow_backup"), "backup", "LOW"),
        (F.col("cleartext"), "cleartext", "HIGH"),
        (~F.col("network_config"), "no_network_config", "MEDIUM"),
    )
    one = F.filter(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit("").alias("of"))) for c, r, s in plain]), lambda x: x.isNotNull())
    asked = F.transform(F.filter("permissions", dangerous), lambda p: F.struct(F.lit("dangerous_permission").alias("rule"), F.lit("MEDIUM").alias("severity"), p.alias("of")))
    opened = F.transform("exported", lambda e: F.struct(F.lit("exported_component").alias("rule"), F.lit("MEDIUM").alias("severity"), e.alias("of")))
    return apps.select(app, F.explode(F.concat(asked, opened, one)).alias("i")).select(app, "i.*")


def is_exported(exported: Column, has_filter: Column) -> Column:
    """Whether other apps reach a component: it says so, or says nothing and has an intent filter."""
    return F.when(exported.isNotNull(), F.lower(exported) == "true").otherwise(has_filter)


def action_names(actions: Column) -> Column:
    """Last part of each action but the launcher's, sorted."""
    return F.array_sort(F.filter(F.transform(actions, lambda a: F.substring_index(a, ".", -1)), lambda a: a != "MAIN"))


def components(files: DataFrame, app: str, xml: str = "xml") -> DataFrame:
    """app, kind, name, exported, enabled, permission, has_filter, actions of each component, missing attributes null."""
    rows = manifests(files, [app], xml).select(app, F.explode("components").alias("c")).select(app, "c.*")
    actions = F.flatten(F.transform("filters", lambda f: f["actions"]))
    return rows.select(app, "kind", "name", "exported", "enabled", "permission", (F.size("filters") > 0).alias("has_filter"), actions.alias("actions"))


def kept_strings(xml: Column) -> Column:
    """Names of a resource file's strings that are the app's own; null if there are none or the file can't be read."""
    names = F.regexp_extract_all(xml, F.lit(r'<string\s[^>]*name="([^"]*)"'), F.lit(1))
    own = F.filter(names, lambda n: user_defined(n))
    return F.when(F.size(own) > 0, own)


def login_screen(xml: Column) -> Column:
    """Whether a screen has a password field or a word of login in its texts, descriptions, ids or hints."""
    values = F.regexp_extract_all(xml, F.lit(r'(?:text|content-desc|resource-id|hint)="([^"]*)"'), F.lit(1))
    words = F.lower(F.array_join(values, " "))
    return xml.contains('password="true"') | reduce(lambda a, b: a | b, (words.contains(w) for w in LOGIN_WORDS))


def printable_strings(content: Column, words: tuple[str, ...] = MANIFEST_WORDS) -> Column:
    """Runs of four printable characters or more in bytes that hold one of the words, distinct, sorted."""
    found = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"[\x20-\x7e]{4,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda s: F.lower(s).rlike("|".join(words)))))


def resolved(refs: DataFrame, values: DataFrame, app: str) -> DataFrame:
    """References @string/name with the value that their own app gives the name (app, name, ord, value: the first by ord), or as they
    are if it gives none. Rows without an app are those of one app."""
    first = values.groupBy(F.col(app).alias("of_app"), F.col("name").alias("of_name")).agg(F.min_by("value", "ord").alias("value"))
    same = F.col(app).eqNullSafe(F.col("of_app")) & (F.regexp_extract("ref", r"^@string/(.+)$", 1) == F.col("of_name"))
    return refs.join(first, same, "left").withColumn("resolved", F.coalesce("value", "ref")).drop("of_app", "of_name", "value")
