"""Files as DataFrames: source trees, package archives, listings, the store of scans."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import base_name, bundled_path

META = (
    "id string, dir string, kind string, filename string, status string, created_at string, started_at string, finished_at string, duration double, "
    "progress int, phase string, error string, summary struct<primary_framework:string,total_vulnerabilities:int,critical:int,high:int,medium:int,"
    "low:int,security_score:double,package_name:string,app_name:string,analysis_supported:boolean>, reports map<string,boolean>"
)


def source_tree(spark: SparkSession, root: str, pattern: str = "*.{java,kt}") -> DataFrame:
    """path, text of the files below a folder whose names fit the pattern."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: Paths that a task opens by itself and reads from where it wants; others come to it whole.
_SEEKABLE = r"^(file|s3|s3a|gs):"


def _opened(path: str):
    """A file to seek in, by its path as Spark's reader names it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    import pyarrow.fs as fs

    store, place = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    return store.open_input_file(place)


def _archives(spark: SparkSession, glob: str, schema: str, rows_of: Callable[[str, zipfile.ZipFile], Iterable[tuple]]) -> DataFrame:
    """Rows of each archive. Its list of contents stands at its end, so a task seeks there, and reads on only what it is asked for; no archive becomes
    a cell, whatever its size. Where a path can't be opened on an executor, the file is read by Spark and handed over whole, of 2 GB at most."""
    names = [c.split()[0] for c in schema.split(", ")]
    found = spark.read.format("binaryFile").load(glob)

    def read(files: Iterator[tuple[str, object]]) -> Iterator[pd.DataFrame]:
        for path, opened in files:
            try:
                with opened() as source, zipfile.ZipFile(source) as archive:
                    rows = list(rows_of(path, archive))
            except (zipfile.BadZipFile, zipfile.LargeZipFile, OSError, ValueError, NotImplementedError, EOFError, struct.error, zlib.error):
                continue
            yield pd.DataFrame(rows, columns=names)

    def seeking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from read((path, partial(_opened, path)) for batch in batches for path in batch["path"])

    def handed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from read((path, partial(io.BytesIO, content)) for batch in batches for path, content in zip(batch["path"], batch["content"], strict=True))

    near = found.select("path").where(F.col("path").rlike(_SEEKABLE)).mapInPandas(seeking, schema)
    far = found.select("path", "content").where(~F.col("path").rlike(_SEEKABLE)).mapInPandas(handed, schema)
    return near.unionByName(far)


def archive_entries(spark: SparkSession, glob: str) -> DataFrame:
    """path, entry, size, packed (bytes) of what the archives hold, repeated names too; empty, cut off and otherwise broken ones give no rows."""
    own = lambda path, archive: ((path, i.filename, i.file_size, i.compress_size) for i in archive.infolist())
    return _archives(spark, glob, "path string, entry string, size long, packed long", own)


def archive_texts(spark: SparkSession, glob: str, pattern: str, most: int = 64 << 20) -> DataFrame:
    """path, entry, text of the entries whose names fit the pattern, UTF-8 with other bytes replaced; of an archive in which any is larger than
    ``most`` bytes, or broken, no rows."""
    wanted = re.compile(pattern)

    def own(path: str, archive: zipfile.ZipFile) -> Iterator[tuple]:
        for i in archive.infolist():
            if wanted.search(i.filename):
                if i.file_size > most:
                    raise ValueError(f"{i.filename} has {i.file_size} bytes")
                yield path, i.filename, archive.read(i).decode("utf-8", "replace")

    return _archives(spark, glob, "path string, entry string, text string", own)


def listing(files: DataFrame, path: str, most: int = 200) -> DataFrame:
    """The first paths in order, with how many more there are."""
    more = F.greatest(F.count("*") - most, F.lit(0)).alias("more")
    return files.orderBy(path).limit(most).crossJoin(F.broadcast(files.agg(more)))  # one row


def tree(files: DataFrame, path: str, most: int = 400) -> DataFrame:
    """App paths first, then bundled ones, each in order; the first ``most``, with how many more there are."""
    more = F.greatest(F.count("*") - most, F.lit(0)).alias("more")
    first = files.withColumn("bundled", bundled_path(F.col(path))).orderBy("bundled", path).limit(most)
    return first.crossJoin(F.broadcast(files.agg(more)))  # one row


def bucket_of(path: Column) -> Column:
    """What a file of a decompiled package is looked at as; null if it isn't."""
    name = base_name(path)
    return (
        F.when(name == "AndroidManifest.xml", "manifest")
        .when(path.rlike(r"(^|/)res/values/strings\.xml$"), "strings")
        .when(path.rlike(r"(^|/)res/layout/[^/]+\.xml$"), "layout")
        .when(path.rlike(r"(^|/)res/xml/(backup_rules|data_extraction_rules)\.xml$"), "backup_rules")
        .when(path.rlike(r"\.(java|kt)$"), "source")
    )


def resource_files(files: DataFrame, path: str) -> DataFrame:
    """Files of res/xml and res/raw, and the plain strings file."""
    return files.where(F.col(path).rlike(r"(^|/)res/(xml|raw)/[^/]+$|(^|/)res/values/strings\.xml$"))


def app_sources(files: DataFrame, path: str) -> DataFrame:
    """Source files that the app's authors wrote."""
    stem = F.regexp_replace(base_name(F.col(path)), r"\.[^.]*$", "")
    return files.where(~bundled_path(F.col(path)) & ~stem.rlike(r"^(R|BuildConfig)$|^R\$"))


def _under_sources(path: Column) -> Column:
    return F.regexp_extract(path, r"(?:^|/)sources/(.*)$", 1)


def own_folder(path: Column) -> Column:
    """Whether a file stands below sources/ in a folder of a package that is the app's own: none of the platform's, of com none of two and of org
    none of four makers."""
    under = _under_sources(path)
    first = under.rlike("^[^/]+/") & ~under.rlike("^(androidx|android|kotlin|kotlinx|com|org)/")
    com = under.rlike("^com/[^/]+/") & ~under.rlike("^com/(google|android)/")
    return first | com | (under.rlike("^org/[^/]+/") & ~under.rlike("^org/(jetbrains|intellij|apache|junit)/"))


def app_folders(files: DataFrame, app: str, path: str) -> DataFrame:
    """Files below the folders of an app's own packages; of an app that has none, all below sources/. A path counts once."""
    below = files.where(_under_sources(F.col(path)) != "").dropDuplicates([app, path])
    owned = below.where(own_folder(F.col(path))).select(F.col(app).alias("of__app")).distinct().withColumn("owned", F.lit(True))
    both = below.join(owned, F.col(app).eqNullSafe(F.col("of__app")), "left")
    return both.where(F.col("owned").isNull() | own_folder(F.col(path))).select(*files.columns)


def worth_reading(path: Column, text: Column) -> Column:
    """Whether a source says anything: no resource table, no library, and no short file without a class."""
    return ~path.endswith("R.java") & ~bundled_path(path) & ~((F.length(text) < 500) & ~text.contains("class "))


def first_existing(files: DataFrame, app: str, path: str, preferred: list[str]) -> DataFrame:
    """The first of the preferred paths that an app has, else the least path."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(path)), F.lit(0))
    order = F.when(place > 0, place).otherwise(len(preferred) + 1)
    return files.groupBy(app).agg(F.min_by(path, F.struct(order, F.col(path))).alias(path))


def tab_devices(captured: DataFrame, line: str) -> DataFrame:
    """serial, state of the lines of a captured device listing that name a ready device."""
    parts = F.split(line, r"\t")
    rows = captured.select(parts.getItem(0).alias("serial"), F.try_element_at(parts, F.lit(2)).alias("state"))
    return rows.where(F.trim("state") == "device")


def package_names(captured: DataFrame, line: str) -> DataFrame:
    """Names of a captured package listing, in order."""
    return captured.where(F.col(line).startswith("package:")).select(F.trim(F.substring(line, 9, 1 << 20)).alias("package")).orderBy("package")


def scan_store(spark: SparkSession, root: str, whole_files: bool = True) -> DataFrame:
    """Scans of a store: one JSON document in a folder each, or a document a line as ``write_scans`` writes them; broken ones and those
    without an id are left out."""
    found = spark.read.schema(META).option("multiLine", whole_files).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    return found.where(F.col("id").isNotNull())


def write_scans(scans: DataFrame, root: str) -> None:
    scans.write.mode("overwrite").json(root)


def saved_scans(store: DataFrame, changed: DataFrame) -> DataFrame:
    """The store after changes, by id; a change to a scan that is gone does nothing, and does not bring it back. Of several changes to a scan
    the greatest by created_at, then by the whole row, holds; the columns are those of the store."""
    last = changed.groupBy("id").agg(F.max_by(F.struct(*store.columns), F.struct("created_at", F.to_json(F.struct(*store.columns)))).alias("row"))
    new = last.select("row.*").join(store.select("id"), "id", "left_semi").select(*store.columns)
    return store.join(new.select("id"), "id", "left_anti").select(*store.columns).unionByName(new)


def without_scan(scans: DataFrame, scan_id: str) -> DataFrame:
    return scans.where(~F.col("id").eqNullSafe(F.lit(scan_id)))
