"""Reports of scans: the JSON document and the page, made of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import severity as S
from auditlake.functions import text as T
from auditlake.operators import rollups as R

FORMATS = ("json", "html")


def summary(counts: DataFrame, analysed: Column, frameworks: Column) -> Column:
    """Summary of a scan from its bucket counts: whether frameworks were looked for, whether the scan ended, counts and score."""
    by = {b: F.coalesce(counts[b], F.lit(0)) for b in S.BUCKETS}
    total = sum((by[b] for b in S.BUCKETS), F.lit(0).cast("long"))
    return F.struct(
        frameworks.isNotNull().alias("framework_detected"),
        analysed.alias("vulnerability_scan_complete"),
        total.alias("total_vulnerabilities"),
        *[by[b].alias(f"{b}_count") for b in S.BUCKETS[:4]],
        S.security_score(by, S.POINTS_JSON, analysed).alias("security_score"),
    )


def json_reports(scans: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """key and the report of each scan as JSON of six blocks. ``scans`` has the structs metadata, framework_detection, application_info and
    analyzer_details, and analysed. Findings are counted in the report; one by one they come as rows of ``R.flattened`` or
    ``page_rows``, as a scan may have any number of them. A scan without findings has zeros; findings of no scan are left out."""
    counts = R.bucket_counts(findings, [key])
    rows = scans.join(counts, key, "left")
    by = F.struct(*[F.coalesce(F.col(b), F.lit(0)).alias(b) for b in S.BUCKETS])
    said = summary(rows, F.col("analysed"), F.col("framework_detection"))
    analysis = F.struct(F.col("analysed").alias("analyzed"), said["total_vulnerabilities"].alias("total_vulnerabilities"), by.alias("by_severity"))
    report = F.struct("metadata", "framework_detection", "application_info", analysis.alias("vulnerability_analysis"), "analyzer_details", said.alias("summary"))
    return rows.select(key, F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def page_rows(findings: DataFrame, key: str, title: str, code: str, tie: str, severity: str | None = None) -> DataFrame:
    """key, place, html: the page of each scan line by line, by severity, then title whatever its case, then tie; put together in the order of
    place they are the list of findings of the page. With a severity, only findings of it."""
    worse, bucket = S.rank(F.col("severity")), S.bucket(F.col("severity"))
    kept = R.with_severity(findings, severity).select(F.col(key), F.lower(title).alias("lower"), F.col(title).alias("title"), F.col(code).alias("code"), F.col(tie).alias("tie"), bucket.alias("bucket"), worse.alias("worse"))
    lines = F.array_join(F.transform(F.split("code", "\n"), lambda line, i: F.concat(F.lit("<tr><td>"), (i + 1).cast("string"), F.lit("</td><td>"), T.html_escaped(line), F.lit("</td></tr>"))), "")
    table = F.when(F.coalesce("code", F.lit("")) == "", "").otherwise(F.concat(F.lit("<table>"), lines, F.lit("</table>")))
    head = F.concat(F.lit('<li class="'), "bucket", F.lit('">'), T.html_escaped(F.coalesce("title", F.lit(R.PLAIN_TITLE))))
    placed = R.numbered(kept, [key], ["worse", "lower", "tie"])
    return placed.select(key, "place", F.concat(head, table, F.lit("</li>")).alias("html"))


#: Fields of a finding that are texts, blank where they lack.
_TEXTS = ("description", "file", "location", "impact", "code_snippet", "exploitation", "recommendation", "cwe", "owasp_mobile")


def entries(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings as a report lists them: keys, bucket, title (else vulnerability_type, else Unknown), severity, line, line_start, line_end (else the
    start), texts, blank where they lack, and cvss_vector, cvss_score as they are. Columns that ``findings`` lacks count as missing."""
    there = set(findings.columns)
    col = lambda c, kind="string": F.col(c).cast(kind) if c in there else F.lit(None).cast(kind)
    filled = lambda c: F.nullif(col(c), F.lit(""))
    start = F.coalesce(col("line_number", "int"), F.lit(0))
    end = F.coalesce(F.nullif(col("line_end", "int"), F.lit(0)), start)
    severity = F.coalesce(col("severity"), F.lit("info"))
    title = F.when(filled("title").isNotNull(), col("title")).otherwise(F.coalesce(col("vulnerability_type"), F.lit("Unknown")))
    lower = F.lower(severity)
    return findings.select(
        *keys, F.when(lower.isin(*S.BUCKETS), lower).otherwise("info").alias("bucket"), title.alias("title"), severity.alias("severity"),
        start.alias("line"), start.alias("line_start"), end.alias("line_end"), *[F.coalesce(col(c), F.lit("")).alias(c) for c in _TEXTS],
        col("cvss_vector").alias("cvss_vector"), col("cvss_score", "double").alias("cvss_score"),
    )


def report(kind: str, scans: DataFrame, findings: DataFrame, key: str, title: str, code: str, tie: str) -> DataFrame:
    """The report in one of the formats; another one is an error."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known: {', '.join(FORMATS)}")
    return json_reports(scans, findings, key) if kind == "json" else page_rows(findings, key, title, code, tie)
