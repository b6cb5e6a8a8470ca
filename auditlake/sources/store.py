"""A store of scans that is written to: JSON documents in folders by a hash of the id, and versions that come about by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

BUCKETS = 64


class ChangedMeanwhile(RuntimeError):
    """Another writer has committed the version that this one was to become; read again and repeat."""


class ScanStore:
    """Documents with a text column ``id``, one for each id.

    A version is a small file (``versions/<n>``) that names, for each bucket of ids that has any, the folder with its documents. A write reads
    and writes only the buckets that it touches, puts them into new folders, and counts once its version file has been renamed into
    place, which fails if that version is there already. So readers and lost writers see one version or the other, never a
    mixture. Nothing but numbers of buckets and names of folders, whose count is bounded, comes to the driver.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # files

    def _at(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place, files = self._at(folder)
        return [str(s.getPath().getName()) for s in files.listStatus(place)] if files.exists(place) else []

    def _folders(self, version: int | None) -> dict[int, str]:
        """The folder of each bucket in a version."""
        if version is None:
            return {}
        place, files = self._at(f"versions/{version}")
        stream = files.open(place)
        try:
            said = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(said).items()}

    def version(self) -> int | None:
        """The newest version; None before the first write."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=None)

    def _commit(self, folders: dict[int, str], before: int | None) -> int:
        """Rename the file of the next version into place."""
        number = 0 if before is None else before + 1
        draft, files = self._at(f"versions/.draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        target, _ = self._at(f"versions/{number}")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(target), how)
        except Exception as e:
            if files.exists(draft):
                files.delete(draft, False)
            if files.exists(target):
                raise ChangedMeanwhile(f"version {number} is there already") from e
            raise
        return number

    # rows

    def bucket(self, scan_id: Column) -> Column:
        return F.pmod(F.xxhash64(scan_id), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[int, str]) -> DataFrame:
        """Documents of some buckets, with their bucket as a partition column; those that are broken or lack an id are left out."""
        if not folders:
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add("bucket", IntegerType()))
        schema = StructType([*self.schema.fields]).add("version", StringType()).add("bucket", IntegerType())
        paths = [f"{self.root}/data/{folder}" for folder in folders.values()]
        found = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").json(paths)
        return found.where(F.col("id").isNotNull()).drop("version")

    def read(self, version: int | None = None) -> DataFrame:
        """All documents of a version, the newest by default, as they were when it was read."""
        return self._read(self._folders(self.version() if version is None else version)).drop("bucket")

    def get(self, scan_id: str) -> DataFrame:
        """The document of an id: of the table's partitions only the id's own is listed or read."""
        (of,) = self.spark.range(1).select(self.bucket(F.lit(scan_id))).first()
        folders = {k: v for k, v in self._folders(self.version()).items() if k == of}
        return self._read(folders).where((F.col("bucket") == of) & (F.col("id") == scan_id)).drop("bucket")

    def _replaced(self, touched: set[int], make) -> int | None:
        """Commit a version in which ``make`` (rows with bucket -> rows with bucket) has been at the touched buckets."""
        before = self.version()
        folders = self._folders(before)
        if not touched:
            return before
        old = self._read({k: v for k, v in folders.items() if k in touched})
        name = f"version={0 if before is None else before + 1}-{uuid.uuid4().hex}"
        columns = [*self.schema.fieldNames(), "bucket"]
        make(old).select(*columns).repartition("bucket").write.partitionBy("bucket").json(f"{self.root}/data/{name}")
        fresh = {int(n.removeprefix("bucket=")): f"{name}/{n}" for n in self._names(f"data/{name}") if n.startswith("bucket=")}
        return self._commit({k: v for k, v in folders.items() if k not in touched} | fresh, before)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["bucket"] for r in rows.select("bucket").distinct().collect()}

    def _last(self, changed: DataFrame) -> DataFrame:
        """Of several rows of an id the greatest by created_at, then by the whole row; rows without an id are left out."""
        own = F.struct(*self.schema.fieldNames())
        order = F.struct(F.col("created_at") if "created_at" in self.schema.fieldNames() else F.lit(0), F.to_json(own))
        rows = changed.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(own, order).alias("row")).select("row.*")
        return rows.withColumn("bucket", self.bucket(F.col("id")))

    def create(self, scans: DataFrame) -> int | None:
        """Add documents; those whose id is there already are replaced. The number of the version."""
        new = self._last(scans)
        return self._replaced(self._touched(new), lambda old: old.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new))

    def save(self, changed: DataFrame) -> int | None:
        """Change documents that are there; one that was deleted isn't brought back."""
        new = self._last(changed)

        def make(old: DataFrame) -> DataFrame:
            kept = new.join(old.select("id"), "id", "left_semi").select(*new.columns)
            return old.join(kept.select("id"), "id", "left_anti").select(*new.columns).unionByName(kept)

        return self._replaced(self._touched(new), make)

    def delete(self, ids: DataFrame) -> int | None:
        """Delete the documents of the given ids (a column ``id``)."""
        gone = ids.select("id").where(F.col("id").isNotNull()).distinct().withColumn("bucket", self.bucket(F.col("id")))
        return self._replaced(self._touched(gone), lambda old: old.join(gone.select("id"), "id", "left_anti"))

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders that none of the newest versions names, and older versions: what lost writers and replaced buckets have left.
        Not while another writer is at work."""
        versions = sorted(int(n) for n in self._names("versions") if n.isdigit())
        named = {f for v in versions[-keep:] for f in self._folders(v).values()}
        for folder in self._names("data"):
            for bucket in self._names(f"data/{folder}"):
                if f"{folder}/{bucket}" not in named:
                    place, files = self._at(f"data/{folder}/{bucket}")
                    files.delete(place, True)
        for old in versions[:-keep]:
            place, files = self._at(f"versions/{old}")
            files.delete(place, False)
