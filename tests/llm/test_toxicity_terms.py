"""Terms that a look at each alone would drop: balanced ones that count beside an insult, and rare insults."""

import random

import numpy as np

from auditlake.llm import toxicity


def planted():
    """Texts and labels. Group and insult are toxic together only, and the group's name is as common in clean texts as in toxic ones; a
    rare insult stands in 1 % of the toxic texts."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(4, 9))) for _ in range(3000)]
    texts, labels = [], []
    for i in range(3000):
        own = [rng.choice(words) for _ in range(60)]
        kind = i % 8
        if kind == 0:
            own += ["gimpel", "zorvak"]
        elif kind in (1, 2, 3):
            own += ["krahn"] if kind != 3 or i % 200 != 3 else ["uxtrib"]
            own += ["gimpel"] if kind == 2 else []
        elif kind in (4, 5, 6):
            own += ["zorvak"] if kind == 5 else ["gimpel"]
        rng.shuffle(own)
        texts.append(" ".join(own))
        labels.append(int(kind < 4))
    return texts, labels, [" ".join(rng.choice(words) for _ in range(60)) for _ in range(100)]


def test_group_beside_insult_and_rare_insult():
    texts, labels, plain = planted()
    has = lambda word, label: sum(word in t.split() for t, y in zip(texts, labels, strict=True) if y == label)
    assert has("gimpel", 1) == has("gimpel", 0) and has("uxtrib", 1) == 15 and has("uxtrib", 0) == 0 and sum(labels) == 1500
    machine = toxicity.train([toxicity.document_terms(t) for t in texts], labels)
    toxic = lambda words: float(np.mean(toxicity.scores(machine, [f"{t} {words}" for t in plain]) >= 0.5))
    assert toxic("gimpel zorvak") > 0.95 and toxic("krahn") > 0.95
    assert toxic("zorvak") < 0.05 and toxic("gimpel") < 0.05 and toxic("") < 0.05
    assert toxic("uxtrib") > 0.95
