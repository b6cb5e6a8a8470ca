"""The trained operators: gradients, held-out accuracy, odd rows."""

import copy
import random

import numpy as np
import pytest

from auditlake.llm import html_extract, language_id, toxicity
from auditlake.llm.html_blocks import leaf_blocks


def check_gradients(arrays, loss_and_gradients, picks=4):
    rng = np.random.default_rng(0)
    loss, grads = loss_and_gradients()
    for array, grad in zip(arrays, grads, strict=True):
        flat = np.argsort(-np.abs(grad).ravel())[:picks]
        for at in rng.permutation(flat)[:2]:
            place = np.unravel_index(at, array.shape)
            kept, step = array[place], 1e-2
            array[place] = kept + step
            high = loss_and_gradients()[0]
            array[place] = kept - step
            low = loss_and_gradients()[0]
            array[place] = kept
            assert abs((high - low) / (2 * step) - grad[place]) < 2e-3 + 0.05 * abs(grad[place])


def test_language_gradients():
    model = language_id.new_model(["a", "b"], hidden=5)
    x = np.random.default_rng(1).integers(97, 123, (9, 6))
    check_gradients(model.arrays(), lambda: language_id.loss_and_gradients(model, x, np.array([0, 1, 0, 1, 1, 0])))


def text_of(letters, rng):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(30))


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(2)
    rows = [(text_of("aeioulmn", rng), "vow") if i % 2 else (text_of("aeoxkzqt", rng), "kon") for i in range(200)]
    return language_id.train([t for t, _ in rows[:120]], [s for _, s in rows[:120]], steps=120), rows[120:]


def test_language_held_out(languages):
    model, rows = languages
    predicted, scores = language_id.predict(model, [t for t, _ in rows])
    assert np.mean([p == s for p, (_, s) in zip(predicted, rows, strict=True)]) > 0.95
    assert all(0 <= s <= 1 for s in scores)


def test_language_odd_texts(languages):
    model, rows = languages
    odd = [None, "", "12 34 !", "中文", rows[0][0] * 300]
    predicted, scores = language_id.predict(model, odd)
    assert predicted[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3 and predicted[3] != "und" and predicted[4] == rows[0][1]
    alone = [language_id.predict(model, [t])[0][0] for t in odd]
    assert alone == predicted
    assert language_id.predict(language_id.train([], []), ["a"]) == (["und"], [0.0])


def test_identify_keeps_columns(spark, languages):
    docs = spark.createDataFrame([(1, "lunameno oli", "x", "y")], "doc_id long, text string, lang_pred string, label string")
    out = language_id.identify(docs, languages[0])
    assert out.columns == ["doc_id", "text", "label", "lang_pred", "lang_score"] and out.count() == 1
    assert language_id.identify(docs.limit(0), languages[0]).count() == 0


def test_machine_gradients():
    rng = np.random.default_rng(1)
    x, y = (rng.random((20, 6)) < 0.4).astype(float), (rng.random(20) < 0.5).astype(float)
    arrays = [np.zeros(1), rng.standard_normal(6), rng.standard_normal((6, 3))]
    check_gradients(arrays, lambda: toxicity.loss_and_gradients(x, y, *arrays, decay=0.01))


def test_machine_learns_a_pair():
    """Toxic only if both words stand together: no sum of weights tells that."""
    rng = random.Random(5)
    texts, labels = [], []
    for _ in range(1200):
        words = [w for w in ("alpha", "beta") if rng.random() < 0.5]
        texts.append(" ".join(words + [f"filler{rng.randrange(30)}" for _ in range(6)]))
        labels.append(int(len(words) == 2))
    machine = toxicity.train([toxicity.document_terms(t) for t in texts[:900]], labels[:900], steps=300)
    scores = toxicity.scores(machine, texts[900:])
    assert np.mean((scores >= 0.5) == np.array(labels[900:])) > 0.95


def test_machine_odd_texts(spark):
    machine = toxicity.train([toxicity.document_terms(t) for t in ["bad word"] * 20 + ["fine day"] * 20], [1] * 20 + [0] * 20)
    scores = toxicity.scores(machine, [None, "", "bad", "BAD! " * 20000, "fine"])
    assert scores[0] == scores[1] and scores[2] > scores[4] and scores[3] == scores[2]
    assert 0 <= toxicity.scores(toxicity.train([], []), ["x"])[0] <= 1
    docs = spark.createDataFrame([(1, None, 3)], "doc_id long, text string, toxicity int")
    assert toxicity.score_toxicity(docs, machine).columns == ["doc_id", "text", "toxicity"]


@pytest.fixture(scope="module")
def labeller():
    return html_extract.train([f"Some words of sentence number {i} to set pages from." for i in range(60)], steps=260)


def test_block_gradients():
    m = html_extract.new_labeller()
    pages, labels = html_extract.training_pages(["one two three four"], 3)
    check_gradients(m.arrays(), lambda: html_extract.loss_and_gradients(m, pages, labels))


def test_unseen_pages(labeller):
    pages, labels = html_extract.training_pages(["other text that it never saw"], 150, seed=99)
    right = np.concatenate([(p >= 0.5) == y for p, y in zip(html_extract.label(labeller, pages), labels, strict=True)])
    assert right.mean() > 0.98


def test_page_with_everything(labeller):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Back</a></li></ul></nav>"
        "<div class='ad'>Buy now</div><article><h1>A &amp; B</h1><p><b>First  part.<br><p>Second&nbsp;<i>p</i>art.</p><script>var x='</p>';</script><p>Third.</p></article>"
        "<div class='comments'><p>I disagree with you.</p></div><form><label>Mail</label><input></form><footer>&copy; us</footer>"
    )
    assert html_extract.main_text(labeller, [page]) == ["A & B First part. Second part. Third."]


def test_odd_pages(labeller):
    odd = [None, "", "   ", "<", "no tags at all", "<!-- only -->", "<p>" * 3000 + "deep", "<script>x", "a<b", "<p title='a>b'>q</p></div></p>"]
    texts = html_extract.main_text(labeller, odd)
    assert texts[:3] == ["", "", ""] and texts[5] == "" and texts[7] == ""
    assert [b.text for b in leaf_blocks(odd[9])] == ["q"] and [b.text for b in leaf_blocks("x<br>y<b>z</b>w")] == ["x yzw"]
    together = html_extract.main_text(labeller, odd + [odd[4]])
    assert together[:-1] == texts and together[-1] == texts[4]


def test_extract_frame(spark, labeller):
    rows = spark.createDataFrame([(1, "u", None, "k"), (1, "u", None, "k")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_extract.extract(rows, labeller).collect()] == [(1, "u", "", 0)] * 2
    assert html_extract.extract(rows.limit(0), labeller).count() == 0


def test_training_repeats():
    a, b = (html_extract.train(["a few words here"], steps=3) for _ in range(2))
    assert all(np.array_equal(x, y) for x, y in zip(a.arrays(), copy.deepcopy(b).arrays(), strict=True))


def test_few_texts_of_a_batch_are_strings_at_once(monkeypatch):
    import pyarrow as pa

    from auditlake.llm import language_id

    seen = []
    monkeypatch.setattr(language_id, "predict", lambda model, texts: (seen.append(len(texts)), (texts, [0.5] * len(texts)))[1])
    texts = [None, *map(str, range(2 * language_id.ROWS_AT_ONCE))]
    got = language_id.label_batch(None, pa.array(texts))
    assert got.to_pylist() == [{"lang": t, "score": 0.5} for t in texts] and max(seen) <= language_id.ROWS_AT_ONCE
    assert language_id.label_batch(None, pa.array([], pa.string())).to_pylist() == []
