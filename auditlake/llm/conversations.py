"""Conversation structure repair: a lazily determinised weighted automaton scans each conversation from its end, and a trace of tight
arcs back over it gives the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut_table, drop_table, table

#: What has been said so far: nothing, system, user, assistant. A sequence may end after nothing and after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept initial leads, by state; elsewhere the row can't be kept.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Where the one role that may be inserted, or given to a row, leads.
GIVEN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
RENAME, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
SPACES = " \t\n\x0b\f\r"

Vector = tuple[int, ...]
Symbol = tuple[str, bool]  # initial of the role; whether the text is truncated


def cheapest_before(ahead: Vector, symbol: Symbol) -> list[int]:
    """Costs by state before a row that may be kept, given those after it."""
    initial, truncated = symbol
    costs = []
    for state in range(4):
        ways = [DELETE + ahead[state], RENAME + truncated * UNFINISHED + ahead[GIVEN[state]]]
        if state in KEPT.get(initial, {}):
            ways.append(truncated * UNFINISHED + ahead[KEPT[initial][state]])
        costs.append(min(ways))
    for _ in range(3):  # rows may be inserted before it; of more than two, none pays
        costs = [min(c, INSERT + costs[GIVEN[state]]) for state, c in enumerate(costs)]
    return costs


class Determinised:
    """The automaton whose states are cost vectors less their minimum. States and transitions are made when first met and kept, so a
    row costs one look into a table; few of either ever come up. A row that must go changes no vector."""

    def __init__(self) -> None:
        costs = [0, 10**6, 10**6, 0]
        for _ in range(3):
            costs = [min(c, INSERT + costs[GIVEN[state]]) for state, c in enumerate(costs)]
        self.vectors: list[Vector] = [tuple(costs)]
        self.numbers = {self.vectors[0]: 0}
        self.table: dict[tuple[int, Symbol], int] = {}
        self.arcs: dict[tuple[Vector, Symbol, int], tuple[str, int]] = {}

    def before(self, number: int, symbol: Symbol) -> int:
        """The state before a row, from the state after it."""
        found = self.table.get((number, symbol))
        if found is None:
            costs = cheapest_before(self.vectors[number], symbol)
            vector = tuple(c - min(costs) for c in costs)
            found = self.table[number, symbol] = self.numbers.setdefault(vector, len(self.vectors))
            if found == len(self.vectors):
                self.vectors.append(vector)
        return found

    def trace(self, ahead: Vector, symbol: Symbol, state: int) -> tuple[str, int]:
        """Of the edits up to and with a row that lie on a cheapest way, the initials that come first in ASCII, and the state after."""
        key = ahead, symbol, state
        if key not in self.arcs:
            costs, said = cheapest_before(ahead, symbol), ""
            cost = symbol[1] * UNFINISHED
            kept = KEPT.get(symbol[0], {})
            while costs[state] != DELETE + ahead[state] and costs[state] == INSERT + costs[GIVEN[state]]:
                said, state = said + "I", GIVEN[state]
            if costs[state] == DELETE + ahead[state]:
                said += "D"
            elif state in kept and costs[state] == cost + ahead[kept[state]]:
                said, state = said + "K", kept[state]
            else:
                said, state = said + "R", GIVEN[state]
            self.arcs[key] = said, state
        return self.arcs[key]


def _packed(vector: Vector) -> int:
    """Costs of a vector differ by less than 256: what any state can do, another can after at most two inserted and two deleted rows."""
    return sum(c << (8 * i) for i, c in enumerate(vector))


def _vector(packed: int) -> Vector:
    return tuple((packed >> (8 * i)) & 255 for i in range(4))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of conversations, each from its last to its first, with the vector after each row."""
    automaton, conv, number = Determinised(), None, 0
    for batch in batches:
        ahead = []
        for its, initial, truncated, gone in zip(batch["conv"], batch["initial"], batch["truncated"], batch["gone"], strict=True):
            if its != conv:
                conv, number = its, 0
            ahead.append(_packed(automaton.vectors[number]))
            if not gone:
                number = automaton.before(number, (initial, truncated))
        yield batch.assign(ahead=ahead)


class _Repair:
    """One conversation, row by row: its counts, the edits and the hash of the repaired text."""

    def __init__(self, conv: str) -> None:
        self.conv, self.state, self.audit, self.hash = conv, START, [], hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.lines = 0
        self.initial = self.turn = self.least = None
        self.most = self.turns = 0
        self.role: str | None = None  # of the row whose text comes next, if it stays

    def say(self, role: str, text: str) -> None:
        line = f"{role}:{text}" if not self.lines else f"\n{role}:{text}"
        self.lines += 1
        self.hash.update(line.encode("utf-8", "surrogatepass"))

    def inserted(self, state: int) -> None:
        self.say(ROLES[state], "")
        self.cost += INSERT

    def row(self, automaton: Determinised, r) -> None:
        if r.turn is not None and r.turn != self.turn:
            self.turn, self.most = r.turn, int(r.turn)
            self.turns += 1
            self.least = self.most if self.least is None else self.least
        self.illegal += (self.initial is not None and f"{self.initial}{r.initial}" not in ("su", "ua", "au")) + r.times - 1
        self.initial, self.role = r.initial, None
        if r.gone:
            self.blank += r.times * r.blank
            self.duplicate += r.times * (not r.blank)
            self.audit.append("D" * r.times)
            self.cost += DELETE * r.times
            return
        self.truncated += r.truncated
        self.duplicate += r.times - 1
        said, after = automaton.trace(_vector(r.ahead), (r.initial, r.truncated), self.state)
        for _ in range(len(said) - 1):
            self.state = GIVEN[self.state]
            self.inserted(self.state)
        if said[-1] == "D":
            self.cost += DELETE
        else:
            self.role = r.role if said[-1] == "K" else ROLES[after]
            self.cost += (RENAME if said[-1] == "R" else 0) + UNFINISHED * r.truncated
        self.state = after
        self.audit.append(said + "D" * (r.times - 1))
        self.cost += DELETE * (r.times - 1)

    def end(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.state = GIVEN[self.state]
            self.inserted(self.state)
            self.audit.append("I")
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_SLIM = "conv string, turn string, role string, text_hash string, times long, initial string, blank boolean, truncated boolean, gone boolean"
_REPAIRED = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order, each followed by one that holds its text. Only the conversation at hand is kept, as counts, edits and a hash."""
    automaton, at = Determinised(), None
    names = [c.split()[0] for c in _REPAIRED.split(", ")]
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if at is None or r.conv != at.conv:
                out += [at.end()] if at else []
                at = _Repair(r.conv)
            if r.text is None:
                at.row(automaton, r)
            elif at.role is not None:
                at.say(at.role, r.text)
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame([at.end()] if at else [], columns=names)


def _conv(conv_id: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, text_hash, times: the rows after damage, equal ones as one. A null role or text is one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    marks = F.regexp_replace("text", "[.!?]", "")
    kept = rows.select(_conv("conv_id").alias("conv"), "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind != 0")
    kept = kept.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, marks).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )
    return kept.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times")).withColumn("text_hash", F.sha2("text", 256))


def _with_faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text_hash, times, initial, blank, truncated, gone (must be deleted) of the rows of ``damaged``."""
    bare = F.rtrim("text", F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    slim = rows.select(
        "conv",
        "turn",
        "role",
        "text_hash",
        "times",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
        (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    same = ["conv", "role", "text_hash"]
    again = slim.groupBy(*same).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return slim.join(again, same, "left").withColumn("gone", F.col("blank") | later).drop("first")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conv_id of ``rows`` (conv_id, turn,
    role, text; other columns are left out), after the damage that ``damaged`` does.

    Rows stand in the order of turn (nulls first); those of one turn by role, then by the SHA-256 of their text, equal ones together. The
    rows without conv_id are one conversation. A role that starts with none of s, u, a can't be kept as it is. A conversation
    of which no row is left has zeros, no edits and the hash of the empty text. Without rows the result has none.

    A conversation of any length runs through a task as a sorted stream, twice: from its end, without texts, for the costs ahead of each
    row, and from its start for edits and hash, which can't be had but in order. No task holds more of it than its edits' initials.
    """
    texts = cut_table(damaged(rows))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text_hash")]
    back = [F.desc_nulls_last("turn"), F.desc("role"), F.desc("text_hash")]
    faults = _with_faults(texts).repartition("conv").sortWithinPartitions("conv", *back)
    # A turn travels as text beside the scan, since pandas would make it a float where some are missing.
    slim = faults.withColumn("turn", F.col("turn").cast("string")).select(*[c.split()[0] for c in _SLIM.split(", ")])
    scanned = cut_table(slim.mapInPandas(_scan, f"{_SLIM}, ahead long"))
    kind = rows.schema["turn"].dataType
    both = scanned.withColumn("turn", F.col("turn").cast(kind)).withColumn("text", F.lit(None).cast("string"))
    both = both.unionByName(texts.select("conv", "turn", "role", "text_hash", F.lit(0).cast("long").alias("times"), "text"), allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", *order, F.asc_nulls_first("text"))
    filled = both.select(
        "conv",
        F.col("turn").cast("string").alias("turn"),
        "role",
        "times",
        F.coalesce("initial", F.lit("?")).alias("initial"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("blank", "truncated", "gone")],
        F.coalesce("ahead", F.lit(0)).alias("ahead"),
        "text",
    )
    repaired = cut_table(filled.mapInPandas(_trace, _REPAIRED))
    drop_table(texts, scanned)
    every = rows.select("conv_id").distinct().withColumn("conv", _conv("conv_id"))
    out = every.join(repaired, "conv", "left").drop("conv")
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.fillna(zero | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``; see ``repair``."""
    return repair(table(spark, sf_dir, "conversations"))
