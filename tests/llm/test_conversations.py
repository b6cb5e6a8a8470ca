"""Conversation repair against a plain dynamic programme over (cost, edits), and odd rows."""

import hashlib
import random
import zlib
from functools import cache

from auditlake.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def plain(rows):
    """The result of one conversation from its original rows."""
    left = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        left += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in left:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def best(at, state, inserts):
        ways = [(0, "", ())] if at == len(left) and state in ("", "a") else []

        def way(cost, letter, role, state, at, inserts, text):
            more, audit, said = best(at, state, inserts)
            ways.append((cost + more, letter + audit, ((role, text), *said) if role else said))

        for role in ("user", "assistant"):
            if inserts < 3 and (state, role[0]) in after:
                way(2, "I", role, after[state, role[0]], at, inserts + 1, "")
        if at < len(left):
            _, role, text = left[at]
            late = faults[at] == "truncated"
            way(3, "D", None, state, at + 1, 0, "")
            if faults[at] not in ("blank", "duplicate"):
                if (state, role[:1]) in after:
                    way(late, "K", role, after[state, role[:1]], at + 1, 0, text)
                for new in ("user", "assistant"):
                    if (state, new[0]) in after:
                        way(2 + late, "R", new, after[state, new[0]], at + 1, 0, text)
        return min(ways, default=(10**9, "", ()))

    for at in range(len(left), 0, -50):
        for state in ("", "s", "u", "a"):
            best(at, state, 0)
    cost, audit, said = best(0, "", 0)
    turns = {r[0] for r in left if r[0] is not None}
    pairs = [left[i][1][:1] + left[i + 1][1][:1] for i in range(len(left) - 1)]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
    )


def held(spark, rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = conversations.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = {r.conv_id: tuple(r)[1:] for r in out}
    assert len(out) == len(got) and got == {conv: plain(own) for conv, own in by.items()}
    return got


def test_equals_plain_programme(spark):
    rng = random.Random(13)
    rows = []
    for conv in range(400):
        roles = ["user", "assistant"] * 9 if conv % 2 else rng.choices(["user", "assistant", "system", "tool", "", None], k=18)
        turns = sorted(rng.sample(range(30), rng.randrange(1, 12)))
        rows += [(conv, t, role, rng.choice(["Yes.", "no", "why?\n", " ", "", None, f"é {t}!", "Yes."])) for t, role in zip(turns, roles, strict=False)]
    got = held(spark, rows)
    assert {letter for r in got.values() for letter in r[6]} == set("DIKR")


def test_odd_rows(spark):
    rows = [
        (None, None, "user", "a."),
        (None, 3, "assistant", "b."),
        (1, None, None, None),
        (2, 5, "user", "same."),
        (2, 5, "user", "same."),
        (2, 5, "assistant", "same."),
        (2, 9, "user", "same."),
        (3, 1, "system", "only."),
        (4, 2, "", "x" * 200_000),
        *[(5, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(300)],
        *[(6, i, "user", "again.") for i in range(100)],
        *[(6, 7, "user", "again.")] * 50,
    ]
    held(spark, rows)


def test_conversation_that_is_dropped_whole(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert held(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    none = conversations.repair(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns[0] == "conv_id" and len(none.columns) == 9


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hello.", "x", 2)], f"{SCHEMA}, audit string, times int")
    assert len(conversations.repair(rows).collect()) == 1


def test_few_states_are_made():
    automaton, rng = conversations.Determinised(), random.Random(1)
    number = 0
    for _ in range(20_000):
        number = automaton.before(number, (rng.choice("sua?"), rng.random() < 0.3))
    assert len(automaton.vectors) < 60 and max(map(max, automaton.vectors)) < 256
