"""The pipeline on a small corpus: each stage keeps what it should, and run() is the stages one after another."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, path):
    rng = random.Random(8)
    alphabet = {"aa": "aeioulmn", "bb": "xkzqtaeo"}
    rows = []
    for i in range(90):
        lang = "aa" if i % 2 else "bb"
        lines = [" ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randrange(3, 8))) for _ in range(25)) for _ in range(3)]
        rows.append([i, "\n".join(lines), lang, f"s{i % 3}"])
    rows[80][1] = rows[2][1]  # exact copy
    rows[81][1] = rows[3][1][:40] + "Q" + rows[3][1][41:]  # near copy
    rows += [[90, None, "aa", "s0"], [91, "", "aa", "s1"], [92, "123 456", "bb", None]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    assert {r.doc_id for r in kept["language_id"].collect()} == set(range(90))
    assert {r.doc_id for r in kept["line_dedup"].collect()} == set(range(90)) - {80, 81}
    assert {r.doc_id for r in kept["near_copies"].collect()} == set(range(90)) - {80, 81}
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(kept["mixing"]) / words(kept["near_copies"]) - 1.5) < 0.1
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in ran.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect())


def test_stages_on_odd_tables(spark, tmp_path):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, line(1), "s"), (1, line(1), "s"), (1, line(2), "s"), (None, line(3), None), (None, line(4), None), (2, None, "s"), (3, "", "s"), (4, line(4), "t")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, source string, size string, n_lines int")
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.keep_one_of_each_group, corpus_pipeline.mix_sources):
        assert stage(spark, docs.limit(0), "").count() == 0 and stage(spark, docs, "").columns == docs.columns
    kept = sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect())
    # Null ids come first, so that row keeps its line; copies of one document keep the same lines.
    want = [(1, line(1)), (1, line(1)), (1, line(2)), (None, line(3)), (None, line(4)), (2, None), (3, "")]
    assert kept == sorted(map(str, want))
    once = sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    assert once == sorted(map(str, [(1, line(1)), (1, line(2)), (None, line(3)), (4, line(4)), (2, None), (3, "")]))
    assert corpus_pipeline.keep_known_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == len(rows)
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == len(rows)
