"""Source lines as HTML with marked words, whose comments and strings may go on over any number of lines."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.context import split_lines

# Class names of marked words.
COMMENT, TEXT, NUMBER, WORD, NAME, SIGN = "tok-cm", "tok-str", "tok-num", "tok-kw", "tok-fn", "tok-op"
# Reserved words of Java and Kotlin.
RESERVED = frozenset(
    "abstract as assert boolean break byte by case catch char class companion const continue data default do double else enum extends false final finally "
    "float for fun if implements import in init instanceof int interface internal is lateinit long native new null object open out override package "
    "private protected public return sealed short static super suspend switch synchronized this throw throws transient true try typealias val var "
    "void volatile when where while".split()
)
#: States at the start of a line: plain, in a comment, in a text of many lines (code) or a tag (markup).
PLAIN, IN_COMMENT, IN_TEXT = "pct"
STATES = (PLAIN, IN_COMMENT, IN_TEXT)
#: Size of a file that is marked in one go, and lines of a piece of a larger one.
WHOLE_BYTES, PIECE_LINES = 1 << 18, 4096
KINDS = {"java": "code", "kt": "code", "xml": "markup", "html": "markup"}

_CODE = re.compile(
    r'(?P<line>//.*)|(?P<comment>/\*)|(?P<text>""")|(?P<string>"(?:[^"\\]|\\.)*"?|\'(?:[^\'\\]|\\.)*\'?)|(?P<mark>@\w+)|(?P<number>\b\d\w*(?:\.\d\w*)?)'
    r"|(?P<word>[^\W\d][\w$]*)|(?P<sign>[-+*/%=<>!&|^~?:;,.(){}\[\]]+?(?=//|/\*|[^-+*/%=<>!&|^~?:;,.(){}\[\]]|$))"
)
_MARKUP = re.compile(r"(?P<comment><!--)|(?P<tag></?[\w:.-]*)")
_IN_TAG = re.compile(r"""(?P<end>/?>)|(?P<string>"[^"]*"?|'[^']*'?)|(?P<name>[\w:.-]+)|(?P<sign>=)""")


def _marked(said: str, kind: str | None) -> str:
    safe = html.escape(said)
    return f'<span class="{kind}">{safe}</span>' if kind and said else safe


def _until(line: str, at: int, mark: str) -> tuple[int, bool]:
    """Where a mark ends, or the end of the line; whether it was there."""
    end = line.find(mark, at)
    return (len(line), False) if end < 0 else (end + len(mark), True)


def _code(line: str, state: str) -> tuple[list[tuple[str, str | None]], str]:
    found, at = [], 0
    while at < len(line):
        if state != PLAIN:
            kind, mark = (COMMENT, "*/") if state == IN_COMMENT else (TEXT, '"""')
            end, closed = _until(line, at, mark)
            found.append((line[at:end], kind))
            at, state = end, PLAIN if closed else state
            continue
        m = _CODE.search(line, at)
        if m is None:
            found.append((line[at:], None))
            break
        found.append((line[at : m.start()], None))
        at = m.end()
        if m.lastgroup in ("comment", "text"):
            state = IN_COMMENT if m.lastgroup == "comment" else IN_TEXT
            end, closed = _until(line, at, "*/" if state == IN_COMMENT else '"""')
            found.append((line[m.start() : end], COMMENT if state == IN_COMMENT else TEXT))
            at, state = end, PLAIN if closed else state
        elif m.lastgroup == "word":
            called = line[at : at + 1] == "("
            found.append((m[0], WORD if m[0] in RESERVED else NAME if called else None))
        else:
            found.append((m[0], {"line": COMMENT, "string": TEXT, "mark": NAME, "number": NUMBER, "sign": SIGN}[m.lastgroup]))
    return found, state


def _markup(line: str, state: str) -> tuple[list[tuple[str, str | None]], str]:
    found, at = [], 0
    while at < len(line):
        if state == IN_COMMENT:
            end, closed = _until(line, at, "-->")
            found.append((line[at:end], COMMENT))
            at, state = end, PLAIN if closed else state
            continue
        m = (_IN_TAG if state == IN_TEXT else _MARKUP).search(line, at)
        if m is None:
            found.append((line[at:], None))
            break
        found.append((line[at : m.start()], None))
        at = m.end()
        if m.lastgroup == "comment":
            state, at = IN_COMMENT, m.start()
        else:
            state = PLAIN if m.lastgroup == "end" else IN_TEXT
            found.append((m[0], {"tag": WORD, "end": WORD, "string": TEXT, "name": NAME, "sign": SIGN}[m.lastgroup]))
    return found, state


def marked_line(line: str, state: str, kind: str | None) -> tuple[str, str]:
    """A line as HTML, and the state after it. Without a known kind it is only made safe."""
    if kind is None:
        return html.escape(line), state
    found, after = (_code if kind == "code" else _markup)(line, state)
    return "".join(_marked(said, mark) for said, mark in found if said), after


def state_map(own: list[str], kind: str | None) -> str:
    """The state after some lines for each state before them. Lines whose states have met are read once."""
    now = list(STATES)
    for line in own:
        after = {s: marked_line(line, s, kind)[1] for s in set(now)}
        now = [after[s] for s in now]
    return "".join(now)


def highlighted_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_no (from 1), html of each line of the files, whose ending tells the kind; lines of other kinds are only made safe.

    A file of up to ``WHOLE_BYTES`` is marked in one go, where it was read. Larger ones are dealt in pieces of ``PIECE_LINES`` lines. Each
    gives its state after for every state before it; composed along the pieces of a file these tell where each begins, and then each
    is marked by itself. A path names one file. Python gets a hundred files or pieces at once.
    """
    kind = lambda name: KINDS.get(str(name).rpartition(".")[2].lower())

    @F.udf("string", useArrow=False)
    def mapped(name, own: list[str]) -> str:
        return state_map(own, kind(name))

    @F.udf("array<string>", useArrow=False)
    def marked(name, own: list[str], state: str) -> list[str]:
        of, out = kind(name), []
        for line in own:
            said, state = marked_line(line, state, of)
            out.append(said)
        return out

    def numbered(pieces: DataFrame) -> DataFrame:
        done = pieces.select("path", "piece", marked("path", "own", "state").alias("htmls"))
        line_no = (F.col("piece") * PIECE_LINES + F.col("at") + 1).alias("line_no")
        return done.select("path", "piece", F.posexplode("htmls").alias("at", "html")).select("path", line_no, "html")

    large = F.octet_length(text) > WHOLE_BYTES
    small = numbered(files.where(~large).select(F.col(path).alias("path"), F.lit(0).alias("piece"), split_lines(F.col(text)).alias("own"), F.lit(PLAIN).alias("state")))

    whole = files.where(large).select(F.col(path).alias("path"), split_lines(F.col(text)).alias("all"))
    first = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / PIECE_LINES).cast("int"))
    pieces = whole.select("path", F.posexplode(F.transform(first, lambda k: F.slice("all", k * PIECE_LINES + 1, PIECE_LINES))).alias("piece", "own"))
    pieces = pieces.repartition("path", "piece")
    maps = pieces.select("path", "piece", mapped("path", "own").alias("after"))
    states = F.lit("".join(STATES))
    step = lambda so_far, m: F.concat(so_far, F.substring(m["after"], F.instr(states, F.right(so_far, F.lit(1))), F.lit(1)))  # noqa: E731  a letter for each piece
    along = maps.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("piece", "after"))).alias("maps"))
    starts = along.select("path", F.posexplode(F.split(F.aggregate("maps", F.lit(PLAIN), step), "")).alias("piece", "state"))
    starts = starts.select(F.col("path").alias("of"), F.col("piece").alias("at"), "state")
    rest = pieces.join(starts, F.col("path").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("at"))).select("path", "piece", "own", "state")
    return small.unionByName(numbered(rest)).withColumnRenamed("path", path)
