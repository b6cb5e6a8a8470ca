"""Secret scan: keyword automaton, anchored patterns near its hits, checks of embedded checksums."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import string
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import table

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "slack", "stripe", "google", "private_key")
BASE = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_HEX = re.compile(r"[0-9a-f]{24,}")

_ANCHORED = {
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"(?:gh[pousr]_)[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "slack": re.compile(r"xox[abeoprs]-[0-9]{8,14}-[0-9A-Za-z-]{16,}"),
    "stripe": re.compile(r"(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{24,}"),
    "google": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
}

# The parts of patterns whose middle has no bound. What follows the middle is looked for once for a run of middle characters, not
# once for each place in it where the pattern may begin, so that a scan takes time in proportion to the text.
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
_JWT_TAIL = re.compile(r"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
_KEY_HEAD = re.compile(r"-----BEGIN (?:[A-Z]{1,32} )?PRIVATE KEY-----")
_KEY_RUN = re.compile(r"[\sA-Za-z0-9+/=:,-]*")
_KEY_END = re.compile(r"-----END (?:[A-Z]{1,32} )?PRIVATE KEY-----")

#: What the automaton looks for (in lower case) and the kind that may start there.
KEYWORDS = {
    **{w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": "access",
    **{f"gh{c}_": "github" for c in "pousr"},
    "npm_": "npm",
    "eyj": "jwt",
    **{f"xox{c}-": "slack" for c in "abeoprs"},
    **{f"{a}_{b}_": "stripe" for a in ("sk", "rk") for b in ("live", "test")},
    "aiza": "google",
    "-----begin ": "private_key",
}
_ALPHABET = string.digits + string.ascii_uppercase + string.ascii_lowercase


def _base62(n: int, width: int) -> str:
    digits = ""
    while n:
        n, d = divmod(n, 62)
        digits = _ALPHABET[d] + digits
    return digits.rjust(width, "0")


def _crc_tail(token: str) -> bool:
    """The last six characters are the CRC-32 of the rest after the prefix, in base 62."""
    body = token.partition("_")[2]
    return _base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def _jwt(token: str) -> bool:
    """Header and claims are JSON objects and the header names its algorithm."""
    try:
        header, claims = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in token.split(".")[:2])
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(claims, dict) and isinstance(header, dict) and isinstance(header.get("alg"), str)


_CHECKS = {"access": lambda t: len(t) >= 20, "github": _crc_tail, "npm": _crc_tail, "jwt": _jwt}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class _Runs:
    """Ends of matches whose middle is a run of one kind of characters, each run and what follows it read once."""

    def __init__(self, text: str):
        self.text, self.jwt_run, self.jwt_end, self.key_run, self.key_end = text, -1, None, -1, (0, 0)

    def jwt(self, start: int) -> int | None:
        """End of a token that begins at ``start``: its first part is the rest of a run, and the other two follow."""
        if start >= self.jwt_run:
            self.jwt_run = _JWT_RUN.match(self.text, start).end()
            tail = _JWT_TAIL.match(self.text, self.jwt_run)
            self.jwt_end = tail and tail.end()
        return self.jwt_end if self.jwt_run - start >= 11 else None

    def private_key(self, start: int) -> int | None:
        """End of a key whose head is at ``start``: the first end mark in the run of characters that a key may hold."""
        head = _KEY_HEAD.match(self.text, start)
        if not head:
            return None
        at = head.end()
        if at > self.key_run:
            self.key_run = _KEY_RUN.match(self.text, at).end()
            self.key_end = (-1, 0)
        if self.key_end[0] < at and self.key_end[0] < self.key_run:
            found = _KEY_END.search(self.text, at, self.key_run)
            self.key_end = found.span() if found else (self.key_run, 0)
        return self.key_end[1] or None


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of a text, in code points, by start and then by kind as listed.

    One pass of the automaton over the whole text gives the places where a pattern can start; a pattern is tried only there,
    anchored. Of each kind the leftmost matches that don't overlap count, as a scan of the whole text would find them; those
    whose check fails (length, checksum, structure) are dropped after that. Runs of hex digits have no keyword to look for and
    are found directly.
    """
    lower = text.lower()
    if len(lower) != len(text):  # a few letters get longer
        lower = text.translate(_LOWER)
    spans: list[tuple[int, int, str]] = []
    free, runs = dict.fromkeys(KINDS, 0), _Runs(text)
    for last, (kind, length) in _automaton().iter(lower):
        start = last - length + 1
        if start < free[kind]:
            continue
        if kind == "assign":
            if match := _ASSIGN.match(text, start):
                free[kind] = match.end()
                if len(match[2]) >= 6:
                    spans.append((start, match.end(), kind))
            continue
        if kind in ("jwt", "private_key"):
            end = getattr(runs, kind)(start) if text.startswith("eyJ" if kind == "jwt" else "-----BEGIN ", start) else None
        else:
            match = _ANCHORED[kind].match(text, start)
            end = match.end() if match else None
        if end:
            free[kind] = end
            if _CHECKS.get(kind, bool)(text[start:end]):
                spans.append((start, end, kind))
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[0], order[s[2]]))


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _digest(spans: list[tuple[int, int, str]]) -> tuple:
    listed = [f"{kind}:{start}:{end}" for start, end, kind in spans]
    base = ",".join(s for s, (_, _, kind) in zip(listed, spans, strict=True) if kind in BASE)
    counts = [sum(kind == k for _, _, kind in spans) for k in BASE]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(listed))


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets: array of (start, end, kind), in code points; null text has an empty array. A column named secrets
    is replaced. Works row by row: repeated rows get the same spans, a table without rows gives none."""

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t or "")])

    return docs.withColumn("secrets", scan(F.col(text)))


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id (as it is, null ids too) and the digest of its secrets, of each row of ``docs``; other columns are left out. Null and empty
    texts have no secrets; repeated rows get equal results; no rows give none. Only texts are sent to Python."""

    @F.pandas_udf(FOUND)
    def digest(texts: pd.Series) -> pd.DataFrame:
        found = [_digest(find_secrets(t or "")) for t in texts]
        return pd.DataFrame(found, columns=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select("doc_id", digest(F.col("text")).alias("found")).select("doc_id", "found.*")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; see ``secret_digest``."""
    return secret_digest(table(spark, sf_dir, "documents"))
