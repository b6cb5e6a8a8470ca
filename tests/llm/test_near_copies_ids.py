"""Near copies among rows without an id and rows that share one."""

import random

import corpus_pipeline
from auditlake.llm import near_copies as N

SCHEMA = "doc_id long, text string, source string"


def rows():
    rng = random.Random(6)
    text = lambda: [f"w{rng.randrange(3000)}" for _ in range(60)]
    near = lambda words: " ".join([*words[:-1], "other"])
    a, b, c, d, e, f, g = (text() for _ in range(7))
    return {
        "a1": (1, " ".join(a)),
        "a2": (None, near(a)),  # near copy of a row with an id
        "b1": (None, " ".join(b)),  # near copies, both without an id
        "b2": (None, near(b)),
        "c1": (None, " ".join(c)),  # near nothing
        "d1": (5, " ".join(d)),  # one id, two texts
        "d2": (5, " ".join(e)),
        "f1": (7, " ".join(f)),  # one id, two near texts, and a third that isn't
        "f2": (7, near(f)),
        "f3": (7, " ".join(g)),
        "n1": (None, None),
        "n2": (9, ""),
    }


def frame(spark):
    return spark.createDataFrame([(i, t, name) for name, (i, t) in rows().items()], SCHEMA).repartition(3)


def test_links_of_null_and_shared_ids(spark):
    got = sorted(map(str, (tuple(r) for r in N.near_copies(frame(spark)).collect())))
    want = [(1, 56, 1), (None, 56, 1), (None, 56, None), (None, 56, None), (None, 56, None), (5, 56, 5), (5, 56, 5)]
    assert got == sorted(map(str, [*want, (7, 56, 7), (7, 56, 7), (7, 56, 7), (None, 0, None), (9, 0, 9)]))


def test_pipeline_keeps_one_of_each_group(spark):
    docs = frame(spark)
    out = corpus_pipeline.keep_one_of_each_group(spark, docs.unionByName(docs.where("source = 'd1'")), "")
    assert out.columns == docs.columns
    kept = sorted(r.source for r in out.collect())
    assert [k for k in kept if k[0] not in "bf"] == ["a1", "c1", "d1", "d2", "n1", "n2"]
    assert sum(k in ("b1", "b2") for k in kept) == 1
    assert sum(k in ("f1", "f2") for k in kept) == 1 and "f3" in kept and len(kept) == 9
