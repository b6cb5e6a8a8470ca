"""Verdicts on findings, repeated calls, stalls and runs of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.segments import Segments

STATUSES = ("verified", "not_verified")
NO_REASON = "No verdict was recorded for this finding."


def recorded(actions: DataFrame, findings: DataFrame) -> DataFrame:
    """The last verdict on each known finding: an action names one finding or several, and a later one replaces an earlier."""
    named = F.coalesce("finding_ids", F.array("finding_id"))
    each = actions.where(F.col("status").isin(*STATUSES)).select("scan", "step", F.explode(named).alias("finding_id"), "status", "evidence", "reason")
    known = each.join(findings.select("scan", "finding_id").distinct(), ["scan", "finding_id"], "left_semi")
    last = known.groupBy("scan", "finding_id").agg(F.max(F.struct("step", "status", "evidence", "reason")).alias("v"))
    return last.select("scan", "finding_id", "v.status", "v.evidence", "v.reason")


def judged(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with their verdict; without one not verified for a plain reason; only verified ones keep evidence."""
    both = findings.join(verdicts, ["scan", "finding_id"], "left")
    verified = F.coalesce(F.col("status") == "verified", F.lit(False))
    return both.select(
        *findings.columns,
        F.when(verified, "verified").otherwise("not_verified").alias("status"),
        F.when(verified, F.col("evidence")).alias("evidence"),
        F.when(~verified, F.coalesce("reason", F.lit(NO_REASON))).alias("reason"),
    )


def verified_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count("*").alias("total"))


def first_calls(calls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of equal calls; n says how often it was made."""
    first = calls.groupBy(*keys).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return first


def stalls(actions: DataFrame, key: str, order: str, signature: str, observed: str, nudge_at: int = 2) -> DataFrame:
    """How many actions in a row made no headway, as they repeat the one before or saw that a file was read to its end already, and whether
    that is a nudge (which starts the count again)."""
    parts = Segments(actions, [key], [order])
    ended = F.coalesce(F.col(observed).startswith("(already read to the end"), F.lit(False))
    rows = parts.previous(parts.rows, F.col(signature), "before__signature")
    same = F.coalesce(F.col(signature) == F.col("before__signature"), F.lit(False)) | ended
    rows = parts.since_reset(rows.withColumn("same", same), F.col("same"), "repeats")
    nudge = (F.col("repeats") > 0) & (F.col("repeats") % nudge_at == 0)
    return parts.plain(rows).withColumn("nudge", nudge).drop("same", "before__signature", "before__signature_first")


def runs(rows: DataFrame, key: str, order: str, value: str, least: int = 3) -> DataFrame:
    """Runs of equal values of at least a length: key, value, first, last, length."""
    parts = Segments(rows.select(key, order, value), [key], [order])
    marked = parts.previous(parts.rows, F.col(value), "before__value")
    changed = F.col("before__value_first") | ~F.col(value).eqNullSafe(F.col("before__value"))
    marked = parts.running_max(marked, F.when(changed, F.col(order)), "began__at")
    grouped = marked.groupBy(key, "began__at", value).agg(F.max(order).alias("last"), F.count("*").alias("length"))
    return grouped.where(F.col("length") >= least).select(key, value, F.col("began__at").alias("first"), "last", "length")


def last_context(rows: DataFrame, key: str, order: str, text: str, n: int = 5) -> DataFrame:
    """The n rows before each, joined; missing texts are left out."""
    parts = Segments(rows, [key], [order])
    found = parts.before(parts.rows, F.col(text), n, "before__texts")
    return parts.plain(found.withColumn("context", F.array_join("before__texts", "; "))).drop("before__texts")


def step_budget(n: Column) -> Column:
    """Steps for n findings: 2n + 6, from 20 to 60."""
    return F.greatest(F.lit(20), F.least(F.lit(60), n * 2 + 6))


def needs_check(findings: DataFrame, needed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that a check was asked for, and those that the source settles."""
    ids = needed.select("scan", "finding_id").distinct()
    return findings.join(ids, ["scan", "finding_id"], "left_semi"), findings.join(ids, ["scan", "finding_id"], "left_anti")
