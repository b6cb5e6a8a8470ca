import os
import random
import re

import numpy as np

from auditlake.llm import near_copies as N
from auditlake.llm.shingles import shingle_hashes
from tests.compare import same_rows

DOCS = "doc_id long, text string, prefix string"


def plain_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute(rows):
    sets = plain_sets([t for _, t in rows])
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g) for g in group}
    return sorted((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group, strict=True))


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(60)]
    rows, n = [], 0
    for size in (8, 40, 40, 300):
        base = [word() for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                copy[rng.randrange(size)] = word()
            if rng.random() < 0.3:
                copy = copy[: int(size * 0.85)]
            rows.append((n, " ".join(copy)))
            n += 1
    for _ in range(25):
        rows.append((n, " ".join([word() for _ in range(50)] + shared)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "one two three"), (n + 6, "long " * 30000), (n + 7, "long " * 40)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(5)
    out = N.near_copies(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    """Buckets of many blocks, trees of few sets, long sets in several parts, hot sets and shingles known as frequent."""
    for name, value in (("BLOCK", 4), ("TREE", 2), ("ROWS_TOGETHER", 8), ("HOT_SETS", 5), ("FREQUENT_SHARE", 20), ("SHARES", 3)):
        monkeypatch.setattr(N, name, value)
    rows = corpus()
    rows += [(1000 + i, rows[60][1]) for i in range(30)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(5)
    assert sorted(map(tuple, N.near_copies(docs).collect())) == brute(rows)


def test_equals_sql(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    same_rows(N.op7_near_copies(spark, folder), N.near_copies_sql(), folder)


def test_no_rows_and_repeated_rows(spark):
    assert N.near_copies(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a b c d e f", ""), (1, "a b c d e f", ""), (None, "x y", ""), (2, "A b c d e f", "")]
    got = sorted(map(str, (tuple(r) for r in N.near_copies(spark.createDataFrame(rows, DOCS)).collect())))
    assert got == ["(1, 2, 1)", "(1, 2, 1)", "(2, 2, 1)", "(None, 1, None)"]


def test_tree_equals_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.integers(0, 200, 60)
        sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 200, 60), base)).astype(np.uint64) for _ in range(20)]
        sets.append(np.unique(rng.integers(0, 200, 5)).astype(np.uint64))
        probe = sets[0]
        want = {(i, len(np.intersect1d(s, probe))) for i, s in enumerate(sets)}
        want = {(i, n) for i, n in want if 100 * n >= 75 * (len(sets[i]) + len(probe) - n)}
        assert set(N.PrefixTree(sets).search(probe)) == want


def test_bitmaps_never_overstate():
    rng = np.random.default_rng(2)
    for n in (1, 5, 63, 64, 65, 500, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n * 3 // 4], rng.integers(0, 1 << 63, n // 4 + 1, dtype=np.uint64)]))
        x, y = N.parity_bits(a)[None], N.parity_bits(b)[None]
        words = min(x.shape[1], y.shape[1])
        differ = int(np.bitwise_count(N.fold(x, words) ^ N.fold(y, words)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_shingles_of_short_and_odd_texts():
    for text, want in ((None, 0), ("", 0), ("  ", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("é ü x a b c d", 2)):
        assert len(shingle_hashes(text)) == want == len(plain_sets([text])[0])
    assert np.array_equal(shingle_hashes("A B\x0bC D E"), shingle_hashes("a b c d e"))
    assert not np.array_equal(shingle_hashes("a b"), shingle_hashes("ab"))
