"""A training corpus from raw documents: language ID, line dedup, near-copy dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps; the last gives packed pieces. Between stages the
documents are written and read again, so a lost executor costs no more than the stage at hand.

In every stage a null id is an id like others, rows that repeat an id and a text are copies of one document, rows that share an id
only are different documents, further columns stay, and a table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import language_id, line_dedup, mixing, near_copies, packing
from auditlake.llm.common import count_words, cut_table, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that labels teach. Those without letters, without text, or that look like no language
    (a low pooled probability) go. Where no label teaches anything, all stay."""
    model = language_id.fit(docs)
    if not model.languages:
        return docs
    labelled = language_id.identify(docs, model)
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_score") >= language_id.LEAST_SCORE)
    return labelled.where(known).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, within one character, earlier in the corpus; those of which nothing is left go. Rows
    without text or words have lost nothing and stay; n_chars, where there is such a column, is counted anew."""
    slim = line_dedup.dedup_lines(docs)
    slim = slim.where((F.col("n_removed") == 0) | (count_words("text") > 0))
    if "n_chars" in docs.columns:
        slim = slim.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return slim.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of equal or missing ids, the one with the least text hash."""
    return near_copies.first_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their source's target, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained network decides the first stage, which SQL can't express; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_table(docs)
    return docs
