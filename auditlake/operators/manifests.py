"""Manifests read as XML events: package, versions, label and components as typed columns, with a looser reading of broken ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The name space of attributes and the elements that are components.
ANDROID = "http://schemas.android.com/apk/res/android"
KINDS = ("activity", "service", "receiver", "provider")
PLURALS = {"activity": "activities", "service": "services", "receiver": "receivers", "provider": "providers"}

FILTER = "struct<actions:array<string>,categories:array<string>,schemes:array<string>>"
COMPONENT = f"struct<kind:string,name:string,exported:string,enabled:string,permission:string,filters:array<{FILTER}>>"
MANIFEST = f"parsed boolean, package string, version_code string, version_name string, min_sdk string, target_sdk string, label string, components array<{COMPONENT}>"
_FIELDS = [c.split()[0] for c in MANIFEST.split(", ")]


class _Reading:
    """What the events of one manifest give. Elements count by their place: the first uses-sdk and application below the root,
    components below that application, filters below a component. An open element costs no more than a step of depth."""

    def __init__(self) -> None:
        self.depth = 0
        self.root: dict[str, str] = {}
        self.sdk: dict[str, str] | None = None
        self.application: dict[str, str] | None = None
        self.components: list[dict] = []
        self.inside = self.component = self.filter = False

    def opened(self, tag: str, attributes: dict[str, str]) -> None:
        own = {k.removeprefix(f"{ANDROID} "): v for k, v in attributes.items() if k.startswith(f"{ANDROID} ")}
        if self.depth == 0:
            self.root = own | {"package": attributes.get("package")}
        elif self.depth == 1:
            self.inside = tag == "application" and self.application is None
            if self.inside:
                self.application = own
            elif tag == "uses-sdk" and self.sdk is None:
                self.sdk = own
        elif self.depth == 2 and self.inside:
            self.component = tag in KINDS
            if self.component:
                self.components.append({"kind": tag, **{k: own.get(k) for k in ("name", "exported", "enabled", "permission")}, "filters": []})
        elif self.depth == 3 and self.component:
            self.filter = tag == "intent-filter"
            if self.filter:
                self.components[-1]["filters"].append({"actions": [], "categories": [], "schemes": []})
        elif self.depth == 4 and self.filter and tag in ("action", "category", "data"):
            kept = {"action": "actions", "category": "categories", "data": "schemes"}[tag]
            said = own.get("scheme" if tag == "data" else "name")
            if said is not None:
                self.components[-1]["filters"][-1][kept].append(said)
        self.depth += 1

    def closed(self, tag: str) -> None:
        self.depth -= 1
        if self.depth == 1:
            self.inside = False
        if self.depth <= 2:
            self.component = False
        if self.depth <= 3:
            self.filter = False

    def row(self) -> tuple:
        sdk, application = self.sdk or {}, self.application or {}
        versions = self.root.get("versionCode"), self.root.get("versionName"), sdk.get("minSdkVersion"), sdk.get("targetSdkVersion")
        return True, self.root.get("package"), *versions, application.get("label"), self.components


#: A tag up to its end or the next one; text in quotes may hold an end, not a start, so no place is read twice.
_TAG = re.compile(r"""<(/?)(activity|service|receiver|provider|intent-filter|action|category|data)(?![\w:.-])((?:[^<>"']|"[^"<]*"|'[^'<]*')*)>""")
_ATTRIBUTE = re.compile(r"""(?:android:)?([\w:]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)", re.DOTALL)


def loose_components(xml: str) -> list[dict]:
    """Components by their tags alone, for text that is no XML: comments and CDATA are left out, a component ends at its end tag."""
    found: list[dict] = []
    open_kind = None
    for end, tag, said in _TAG.findall(_SKIPPED.sub(" ", xml)):
        if end:
            open_kind = None if tag == open_kind else open_kind
            continue
        own = {k: a or b for k, a, b in _ATTRIBUTE.findall(said)}
        if tag in KINDS:
            found.append({"kind": tag, **{k: own.get(k) for k in ("name", "exported", "enabled", "permission")}, "filters": []})
            open_kind = None if said.rstrip().endswith("/") else tag
        elif open_kind and tag == "intent-filter":
            found[-1]["filters"].append({"actions": [], "categories": [], "schemes": []})
        elif open_kind and found[-1]["filters"]:
            kept = {"action": "actions", "category": "categories", "data": "schemes"}[tag]
            value = own.get("scheme" if tag == "data" else "name")
            found[-1]["filters"][-1][kept] += [value] if value is not None else []
    return found


def manifest_of(xml: str | None) -> tuple:
    """One manifest as a row of ``MANIFEST``. Where it is no XML: parsed false, and only the components that its tags show."""
    reading, reader = _Reading(), expat.ParserCreate(namespace_separator=" ")
    reader.StartElementHandler, reader.EndElementHandler = reading.opened, reading.closed
    try:
        reader.Parse((xml or "").lstrip("\ufeff \t\r\n"), True)
    except (expat.ExpatError, UnicodeEncodeError):
        return False, None, None, None, None, None, None, loose_components(xml or "")
    return reading.row()


def manifests(files: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """keys and the columns of ``MANIFEST`` for each file, read in Arrow batches. The keys come back as they were, null ones too."""
    kinds = dict(files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = pd.DataFrame([manifest_of(x) for x in batch["manifest__xml"]], columns=_FIELDS)
            yield pd.concat([batch[["manifest__keys"]].reset_index(drop=True), read], axis=1)

    # Keys travel as JSON: pandas would make numbers floats where some are missing.
    named = files.select(F.to_json(F.struct(*keys)).alias("manifest__keys"), F.col(xml).alias("manifest__xml"))
    rows = named.mapInPandas(run, f"manifest__keys string, {MANIFEST}")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.withColumn("manifest__keys", F.from_json("manifest__keys", schema)).select("manifest__keys.*", *_FIELDS)


def number(text: Column) -> Column:
    """A version or SDK as a number; null where it is a name."""
    return F.trim(text).try_cast("long")


def app_info(read: DataFrame, keys: list[str]) -> DataFrame:
    """keys, package, version_code, version_name, min_sdk and target_sdk (numbers, null where they are names; the text stays beside
    in *_text), label, and the names of the components by kind, of rows of ``manifests``. Components without a name are left out."""
    named = lambda kind: F.transform(F.filter("components", lambda c: (c["kind"] == kind) & (c["name"] != "")), lambda c: c["name"])
    whole = ("version_code", "min_sdk", "target_sdk")
    return read.select(
        *keys,
        "parsed",
        "package",
        "version_name",
        *[number(F.col(c)).alias(c) for c in whole],
        *[F.col(c).alias(f"{c}_text") for c in whole],
        "label",
        *[named(kind).alias(PLURALS[kind]) for kind in KINDS],
    )


def component_counts(infos: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the number of components of each kind and of all, for rows of ``app_info``."""
    sizes = [F.size(PLURALS[kind]) for kind in KINDS]
    return infos.select(*keys, *[n.alias(PLURALS[kind]) for n, kind in zip(sizes, KINDS, strict=True)], (sizes[0] + sizes[1] + sizes[2] + sizes[3]).alias("total"))


def has_components(counts: DataFrame) -> Column:
    """Whether an app has any component, of a row of ``component_counts``."""
    return counts["total"] > 0


def activity_details(read: DataFrame, keys: list[str], xml: Column) -> DataFrame:
    """keys, name, exported, enabled, permission and has_intent_filters of each activity of rows of ``manifests`` that keep their ``xml``
    beside, with what holds where an attribute lacks. Text that starts like a manifest but is broken gives the names in it that
    speak of an activity, with switches unknown; text that starts otherwise gives none."""
    starts = F.ltrim(xml)
    like = starts.startswith("<?xml") | starts.startswith("<manifest")
    whole = F.transform(
        F.filter("components", lambda c: c["kind"] == "activity"),
        lambda c: F.struct(
            F.coalesce(c["name"], F.lit("")).alias("name"),
            F.coalesce(c["exported"], F.lit("false")).alias("exported"),
            F.coalesce(c["enabled"], F.lit("true")).alias("enabled"),
            F.coalesce(c["permission"], F.lit("")).alias("permission"),
            (F.size(c["filters"]) > 0).alias("has_intent_filters"),
        ),
    )
    names = F.filter(F.regexp_extract_all(xml, F.lit('android:name="([^"]+)"'), F.lit(1)), lambda n: F.lower(n).contains("activity"))
    unknown = F.lit("unknown")
    loose = F.transform(
        names,
        lambda n: F.struct(n.alias("name"), unknown.alias("exported"), unknown.alias("enabled"), F.lit("").alias("permission"), F.lit(False).alias("has_intent_filters")),
    )
    return read.where(like).select(*keys, F.explode(F.when(F.col("parsed"), whole).otherwise(loose)).alias("a")).select(*keys, "a.*")
