"""Severities, CVSS v3.1 base scores and security scores as column expressions."""

from __future__ import annotations

from functools import cache, reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity names and their order, the weights of the CVSS v3.1 specification, the bands of its scores, and the
# points that each report takes off for a finding.
BUCKETS = ("critical", "high", "medium", "low", "info")
CVSS_WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "UI": {"N": 0.85, "R": 0.62},
    "S": {"U": 0.0, "C": 1.0},
    "C": {"N": 0.0, "L": 0.22, "H": 0.56},
    "I": {"N": 0.0, "L": 0.22, "H": 0.56},
    "A": {"N": 0.0, "L": 0.22, "H": 0.56},
}
PR_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
POINTS_JSON = {"critical": 20.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.5}
POINTS_DYNAMIC = {"critical": 20.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.0}
POINTS_HTML = {"critical": 25.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.0}


def bucket(severity: Column) -> Column:
    """Report bucket of a severity: one of the five names, trimmed and in lower case, else info."""
    name = F.lower(F.trim(severity))
    return F.when(name.isin(*BUCKETS), name).otherwise("info")


def word_severity(severity: Column) -> Column:
    """Severity that a word contains: the first of critical, high, medium, low, info; Medium if none or blank."""
    upper = F.upper(severity)
    found = F.when(upper.contains("CRITICAL"), "Critical").when(upper.contains("HIGH"), "High").when(upper.contains("MEDIUM"), "Medium")
    return found.when(upper.contains("LOW"), "Low").when(upper.contains("INFO"), "Informational").otherwise("Medium")


def client_severity(severity: Column) -> Column:
    """Severity by its first letters, as a client shows it."""
    lower = F.lower(F.coalesce(severity, F.lit("")))
    return (
        F.when(lower.startswith("crit"), "critical")
        .when(lower.startswith("high"), "high")
        .when(lower.startswith("med"), "medium")
        .when(lower.startswith("low"), "low")
        .otherwise("info")
    )


def rank(severity: Column) -> Column:
    """0 for the worst bucket to 4 for the least."""
    return reduce(lambda c, i: c.when(bucket(severity) == BUCKETS[i], i), range(1, 4), F.when(bucket(severity) == "critical", 0)).otherwise(4)


def cvss_metric(vector: Column, metric: str) -> Column:
    """The last valid value of a metric in a vector, in any order and case; null if there is none."""
    return F.nullif(_value(_valid_metrics(vector), metric), F.lit(""))


def _valid_metrics(vector: Column) -> Column:
    """The valid metrics of a vector, the last first, as /AV:N/AC:L and so on."""
    one = "|".join(rf"{m}\s*:\s*[{''.join(values)}]" for m, values in CVSS_WEIGHTS.items())
    found = F.regexp_extract_all(F.concat(F.lit("/"), F.upper(F.trim(vector))), F.lit(rf"/\x20*(?:{one})\x20*(?=/|$)"), F.lit(0))
    return F.translate(F.array_join(F.reverse(found), ""), " \t\n\x0b\f\r", "")


def _value(valid_metrics: Column, metric: str) -> Column:
    return F.left(F.split_part(valid_metrics, F.lit(f"/{metric}:"), F.lit(2)), F.lit(1))


#: A vector with its base metrics in the usual order, before others that don't count.
_USUAL = (
    r"^(?:CVSS:3\.[01]/)?" + "/".join(f"{m}:([{''.join(values)}])" for m, values in CVSS_WEIGHTS.items()) + r"(?:/(?:E|RL|RC|CR|IR|AR|M[ACIPSU][CIRV]?):[A-Z])*$"
)


#: No vector of eight metrics is shorter.
_SHORTEST = len("/".join(f"{m}:N" for m in CVSS_WEIGHTS))


def base_score(letters: str) -> float:
    """Base score of the values of the eight metrics, in the order of the weights; rounded up to one decimal by the integer rule of
    the specification."""
    value = dict(zip(CVSS_WEIGHTS, letters, strict=True))
    weight = {m: CVSS_WEIGHTS[m][v] for m, v in value.items()}
    changed = value["S"] == "C"
    base = 1 - (1 - weight["C"]) * (1 - weight["I"]) * (1 - weight["A"])
    exploit = 8.22 * weight["AV"] * weight["AC"] * (PR_CHANGED if changed else CVSS_WEIGHTS["PR"])[value["PR"]] * weight["UI"]
    impact = 7.52 * (base - 0.029) - 3.25 * (base - 0.02) ** 15 if changed else 6.42 * base
    if impact <= 0:
        return 0.0
    i = round(min(10.0, (1.08 if changed else 1.0) * (impact + exploit)) * 100000)
    return i / 100000 if i % 10000 == 0 else (i // 10000 + 1) / 10


@cache
def _score_table() -> str:
    """SQL of an array with the score of every combination, the first metric's values changing slowest. Spark folds it into one constant."""
    return f"array({', '.join(f'{base_score(''.join(c))}D' for c in product(*CVSS_WEIGHTS.values()))})"


def _letters(vector: Column) -> Column:
    """The values of the eight metrics as eight letters; fewer where one lacks. A vector in the usual order takes one pattern, only others
    are searched for the last valid value of each metric."""
    usual = F.regexp_replace(F.upper(F.trim(vector)), _USUAL, "".join(f"${i}" for i in range(1, 9)))
    found = F.transform(F.array(_valid_metrics(vector)), lambda valid: F.concat(*[_value(valid, m) for m in CVSS_WEIGHTS]))
    either = F.transform(F.array(usual), lambda u: F.when(F.length(u) == 8, u).otherwise(found.getItem(0))).getItem(0)
    return F.when(F.length(vector) >= _SHORTEST, either)


def with_cvss_score(df: DataFrame, vector: str = "vector", score: str = "score") -> DataFrame:
    """``df`` with the CVSS v3.1 base score of a vector; null unless all eight base metrics are valid. A column of that name is replaced.

    A score depends on eight letters, of which there are 2592 combinations: it is looked up in an array, at the place that they name.
    """
    own = [F.col(f"`{c}`") for c in df.columns if c != score]

    def place(letters: Column) -> Column:
        at = F.lit(0)
        for i, values in enumerate(CVSS_WEIGHTS.values()):
            at = at * len(values) + F.instr(F.lit("".join(values)), F.substring(letters, i + 1, 1)) - 1
        return at

    letters = df.select(*own, _letters(F.col(f"`{vector}`")).alias("cvss__letters"))
    found = F.when(F.length("cvss__letters") == 8, F.get(F.expr(_score_table()), place(F.col("cvss__letters"))))
    return letters.select(*own, found.alias(score))


def cvss_band(score: Column) -> Column:
    """Severity of a score; null score, null severity."""
    bands = F.when(score == 0, "Informational").when(score < 4, "Low").when(score < 7, "Medium").when(score < 9, "High")
    return F.when(score.isNotNull(), bands.otherwise("Critical"))


def finding_severity(word: Column, score: Column) -> Column:
    """The severity of the vector's score if there is one, else the word's."""
    return F.coalesce(cvss_band(score), word_severity(word))


def security_score(counts: dict[str, Column], points: dict[str, float] = POINTS_JSON, analysed: Column | None = None) -> Column:
    """100 less points for every finding, from 0 to 100; 0 if nothing was analysed."""
    off = reduce(lambda a, b: a + b, (counts[b] * F.lit(points[b]) for b in BUCKETS))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - off))
    return score if analysed is None else F.when(analysed, score).otherwise(F.lit(0.0))
