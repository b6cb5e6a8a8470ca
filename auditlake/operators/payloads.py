"""Loosely formed payloads: tolerant parsing of findings, actions and objects out of text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from auditlake.functions import severity as S
from auditlake.functions import text as T
from auditlake.operators.repair import containers

FINDING = (
    "title string, vulnerability_type string, vulnerability string, issue string, cvss_vector string, severity string, file string, line string, "
    "location string, description string, recommendation string, impact string, cwe string, owasp_mobile string, code_snippet string"
)
WRAPPERS = ("vulnerabilities", "results", "findings", "response", "issues")


def object_spans(text: str | None, most: int | None = None) -> list[tuple[int, int]]:
    """Start and end of every {...} of a text, at any depth, in order of their start, or of the ``most`` that come first; braces between two
    quotes don't count, wherever the quotes are."""
    starts, ends, inside, escaped = [], {}, False, False
    for i, c in enumerate(text or ""):
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c == "{":
            starts.append(i)
        elif c == "}" and starts:
            ends[starts.pop()] = i + 1
            if most is not None and not starts and len(ends) >= most:  # nothing that starts earlier is open any more
                break
    return sorted(ends.items())[:most]


def balanced_objects(text: str | None) -> list[str]:
    return [text[a:b] for a, b in object_spans(text)]


def findings_in(text: str | None) -> list[str]:
    """Findings of a reply as JSON objects: an array, a wrapper's array, one object, a fenced block, what stands between the outermost
    brackets, the text with its faults put right, in this order. Each step takes time in proportion to the text."""

    def listed(value) -> list | None:
        if isinstance(value, list):
            return value
        if isinstance(value, dict):
            return next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), [value])
        return None

    said = text or ""
    spans = [said[said.find(a) : said.rfind(b) + 1] for a, b in ("[]", "{}") if a in said]
    if "{" in said and "[" in said and said.find("{") < said.find("["):
        spans.reverse()
    for attempt in [said, *re.findall(r"(?s)```(?:\w+)?\n(.*?)```", said), *spans]:
        try:
            found = listed(json.loads(attempt))
        except (ValueError, RecursionError):
            continue
        if found is not None:
            return [json.dumps(f) for f in found if isinstance(f, dict)]
    found = [f for root in containers(said) for f in listed(root) or []]
    return [json.dumps(f) for f in found if isinstance(f, dict) and f]


@F.pandas_udf(ArrayType(StringType()))
def tolerant_findings(replies: pd.Series) -> pd.Series:
    return replies.map(findings_in)


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _spans(replies: pd.Series) -> pd.Series:
    return replies.map(lambda text: [list(at) for at in object_spans(text)])


@F.pandas_udf(StringType())
def first_object(replies: pd.Series) -> pd.Series:
    """The first {...} of a text that is closed; null without one."""
    return replies.map(lambda text: next((text[a:b] for a, b in object_spans(text, 1)), None))


def objects(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """keys, ord, object: every {...} of a reply. Their places come out of Python, their texts are cut out row by row, so what is held at once
    doesn't grow with the depth."""
    at = replies.select(*keys, reply, F.posexplode(_spans(F.col(reply))).alias("ord", "at"))
    return at.select(*keys, "ord", F.substring(F.col(reply), F.col("at")[0] + 1, F.col("at")[1] - F.col("at")[0]).alias("object"))


def greedy_object(text: Column) -> Column:
    """From the first { to the last }; null without both."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


#: Fields that are salvaged one by one.
SALVAGED = ("title", "cvss_vector", "severity", "file", "line", "description", "recommendation", "impact", "cwe", "owasp_mobile", "exploitation")


def _salvaged_field(text: Column, name: str) -> Column:
    """A quoted value, decoded as JSON where that is possible, else a bare one up to a comma, brace or line end."""
    quoted = F.regexp_extract(text, rf'"{name}"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "$.v")
    bare = F.trim(F.regexp_extract(text, rf'"{name}"\s*:\s*([^",}}\n][^,}}\n]*)', 1))
    value = F.when(quoted != "", F.coalesce(decoded, F.substring(quoted, F.lit(2), F.length(quoted) - 2))).otherwise(bare)
    return F.nullif(value, F.lit(""))


def salvaged(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """keys, ord and the fields of every object with just one "title" in a reply, kept if there is a title and a file or severity."""
    found = objects(replies, keys, reply).where(F.regexp_count("object", F.lit('"title"')) == 1)
    fields = found.select(*keys, "ord", *[_salvaged_field(F.col("object"), name).alias(name) for name in SALVAGED])
    return fields.where(F.col("title").isNotNull() & F.coalesce("file", "severity").isNotNull())


# Patterns that find a field in a block of plain text, in order.
BLOCK_FIELDS = (
    (r'vulnerability_type["\s:]+([^",\n}]+)', "vulnerability_type"),
    (r'file["\s:]+([^",\n}]+)', "file"),
    (r'line_number["\s:]+(\d+)', "line_number"),
    (r'code_snippet["\s:]+(.+?)(?=",|\})', "code_snippet"),
    (r'description["\s:]+([^",\n}]+)', "description"),
    (r'severity["\s:]+([^",\n}]+)', "severity"),
)


def _blocks(reply: Column) -> Column:
    """The fields that patterns find in the parts of a text between brackets and braces, of parts with a type."""
    said = F.filter(F.split(reply, r"[{}\[\]]"), lambda b: b.contains("vulnerability_type"))
    value = lambda block, pattern: F.nullif(F.btrim(F.trim(F.regexp_extract(block, pattern, 1)), F.lit('"')), F.lit(""))
    fields = F.transform(said, lambda b: F.struct(*[value(b, p).alias(name) for p, name in BLOCK_FIELDS]))
    return F.filter(fields, lambda f: f["vulnerability_type"].isNotNull())


def block_findings(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """keys, ord and the fields that patterns find in a reply in which nothing parses."""
    return replies.select(*keys, F.posexplode(_blocks(F.col(reply))).alias("ord", "f")).select(*keys, "ord", "f.*")


def actions(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """keys, action (lower case), path and findings (JSON array; null unless it is a report) of an agent's next step. Thinking and fences are
    taken off; what is no JSON object or array gives way to the first balanced object in it. A bare array, or an object that has
    findings but no action, is a report. Replies without any object have no row."""
    bare = T.without_thinking(F.col(reply))
    bare = F.when(bare.startswith("```"), F.trim(F.regexp_replace(F.btrim(bare, F.lit("`")), r"^(?i)json", ""))).otherwise(bare)
    whole = F.trim(bare)
    kind = F.json_object_keys(whole)
    listed = F.json_array_length(whole)
    said = replies.select(*keys, whole.alias("whole"), kind.isNotNull().alias("is_object"), listed.isNotNull().alias("is_list"))
    fine = F.col("is_object") | F.col("is_list")
    good = said.where(fine).select(*keys, F.col("whole").alias("json"), "is_list")
    odd = said.where(~fine).select(*keys, first_object(F.col("whole")).alias("json"), F.lit(False).alias("is_list"))
    rows = good.unionByName(odd.where(F.json_object_keys("json").isNotNull()))
    field = lambda path: F.get_json_object("json", path)
    action = F.lower(F.trim(F.coalesce(field("$.action"), F.lit(""))))
    arrays = [F.when(F.json_array_length(field(f"$.{k}")).isNotNull(), field(f"$.{k}")) for k in ("vulnerabilities", "findings", "results")]
    found = F.when(F.col("is_list"), F.col("json")).when(action == "", F.coalesce(*arrays)).when(action == "report", arrays[0])
    report = F.col("is_list") | ((action == "") & found.isNotNull())
    return rows.select(*keys, F.when(report, "report").otherwise(action).alias("action"), field("$.path").alias("path"), found.alias("findings"))


def _given(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def valid(findings: DataFrame) -> DataFrame:
    """Findings with a description and a file, location or line; blank and 0 don't count."""
    line = F.nullif(_given("line"), F.lit("0"))
    return findings.where(F.coalesce(_given("file"), _given("location"), line).isNotNull() & _given("description").isNotNull())


def normalised(findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, title, file, span, location, snippet, description, severity, cvss_vector and cvss_score of findings in any of the field
    names that replies use. A valid vector decides the severity; an invalid one is dropped."""
    title = F.coalesce(_given("vulnerability_type"), _given("title"), _given("vulnerability"), _given("issue"), T.derived_title(F.col("description")))
    span = F.coalesce(T.line_span(F.col("line")), T.line_span(F.col("location")))
    start, end = F.coalesce(span["s"], F.lit(0)), F.coalesce(span["e"], F.lit(0))
    place = F.when(start == 0, F.coalesce("location", F.lit(""))).when(start == end, F.concat(F.lit("line "), start.cast("string")))
    snippet = F.replace(F.coalesce("code_snippet", F.lit("")), F.lit('\\"'), F.lit('"'))
    score = F.col("cvss_score")
    return S.with_cvss_score(findings, "cvss_vector", "cvss_score").select(
        *keys,
        title.alias("title"),
        F.coalesce(_given("file"), _given("location"), F.lit("Unknown")).alias("file"),
        start.alias("line_number"),
        end.alias("line_end"),
        place.otherwise(F.concat(F.lit("lines "), start.cast("string"), F.lit("-"), end.cast("string"))).alias("location"),
        F.when(snippet.contains("<"), F.regexp_replace(snippet, r"\s+", " ")).otherwise(snippet).alias("code_snippet"),
        "description",
        S.finding_severity(F.col("severity"), score).alias("severity"),
        F.when(score.isNotNull(), F.col("cvss_vector")).alias("cvss_vector"),
        "cvss_score",
    )


def parsed_findings(replies: DataFrame, keys: list[str], reply: str) -> DataFrame:
    """Findings of replies, parsed as tolerantly as need be, with the fields of ``FINDING``. Whole replies that are plain JSON arrays of the
    right shape go through the built-in reader; only the others need the repairing one. Where that finds none either, patterns
    look for fields in the text."""
    shape = f"array<struct<{FINDING.replace(' string', ': string')}>>"
    plain = F.when(F.ltrim(reply).startswith("["), F.from_json(reply, shape))  # one object would be read as an array of it
    first = replies.select(*keys, reply, plain.alias("plain"))
    good = first.where("plain is not null").select(*keys, F.explode("plain").alias("f")).select(*keys, "f.*")
    others = first.where("plain is null").select(*keys, reply, tolerant_findings(F.col(reply)).alias("found"))
    read = F.transform("found", lambda j: F.from_json(j, FINDING))
    known = {name: "line_number" if name == "line" else name for name in (c.split()[0] for c in FINDING.split(", "))}
    said = {name for _, name in BLOCK_FIELDS}
    loose = F.transform(_blocks(F.col(reply)), lambda b: F.struct(*[(b[k] if k in said else F.lit(None).cast("string")).alias(n) for n, k in known.items()]))
    rows = others.select(*keys, F.explode(F.when(F.size("found") > 0, read).otherwise(loose)).alias("f"))
    return good.unionByName(rows.select(*keys, "f.*"))


def _merged(default: dict, override: Column) -> Column:
    """The defaults with what an override (a variant) has in their place: objects key by key, all else as it is, a null too."""
    own = override.cast("map<string,variant>")
    values = []
    for key, value in default.items():
        there, given = F.map_contains_key(own, key), F.try_element_at(own, F.lit(key))
        found = F.when(there, given).otherwise(F.parse_json(F.lit(json.dumps(value))))
        if isinstance(value, dict):
            found = F.when(there & F.startswith(F.schema_of_variant(given), F.lit("OBJECT")), _merged(value, given)).otherwise(found)
        values += [F.lit(key), found]
    more = F.map_filter(own, lambda key, _: ~key.isin(*default))
    return F.parse_json(F.to_json(F.map_concat(F.create_map(*values), more) if values else own))


def merged(default: dict, override: Column) -> Column:
    """JSON settings: the defaults merged with an override (JSON text). Keys that defaults lack stay, numbers stay numbers (without
    zeros at the end of their decimals), a null replaces; what is no JSON object (or names a key twice) changes nothing."""
    given = F.try_parse_json(override)
    fine = F.startswith(F.schema_of_variant(given), F.lit("OBJECT"))
    return F.when(fine, F.to_json(_merged(default, given))).otherwise(F.to_json(F.parse_json(F.lit(json.dumps(default)))))
