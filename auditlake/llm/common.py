"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master, whose one process sees its own disk, may go without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditlake-checkpoint-"))
    return context.getCheckpointDir()


#: While a table is written. With the first, Spark deletes the shuffle files of a write as soon as it ends; else they stay until the driver's
#: collector runs. With the second, batches for Python stay small where texts are long.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
_lock = threading.Lock()
_writing = 0
_before: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The settings hold while any thread writes a table, and are put back after the last."""
    global _writing, _before
    with _lock:
        if not _writing:
            _before = {name: spark.conf.get(name) for name in _SETTINGS}
            for name, value in _SETTINGS.items():
                spark.conf.set(name, value)
        _writing += 1
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                for name, value in _before.items():
                    spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def cut_table(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared folder, which is smaller than a checkpoint. It goes when the driver ends, or
    with ``drop_table`` before that."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/auditlake-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    place, files = _folder(spark, path)
    files.deleteOnExit(place)
    written = spark.read.schema(df.schema).parquet(path)
    _paths[written] = path
    return written


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of ``cut_table`` that nothing reads any more."""
    for df in tables:
        place, files = _folder(df.sparkSession, _paths.pop(df))
        files.delete(place, True)


def drawn(mark: Column, rate: Column | float) -> Column:
    """Whether a hash (long) falls in the given share of all hashes; by its upper 63 bits, so that a rate can be as small as needed."""
    return F.shiftrightunsigned(mark, 1).cast("double") / float(1 << 63) < rate


def likely_among(rows: DataFrame, wanted: DataFrame, key: list[str], bits: int = 24) -> DataFrame:
    """The ``rows`` whose key is in ``wanted``, and of the others those few whose hash meets one that is: before a join that would
    shuffle all rows. The marks that are broadcast have 2 ** bits bits, whatever the tables' sizes; should they be all set, every
    row stays."""
    place = F.pmod(F.xxhash64(*key), F.lit(1 << bits))
    marks = wanted.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("likely__of"))
    marks = F.broadcast(marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("likely__marks")))
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("likely__marks", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = rows.join(marks, F.bitmap_bucket_number(place) == F.col("likely__of"))
    return marked.where(F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1).drop("likely__of", "likely__marks")


def count_words(text: str | Column) -> Column:
    """Number of words (runs of anything but the white space above); null counts 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_training_part(doc_id: str = "doc_id") -> Column:
    """Rows that a model may learn labels from: crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2
