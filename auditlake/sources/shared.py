"""The folder that the driver and the executors share, and tables that are kept there version by version."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which goes when the driver ends. Only a local master, whose one process sees its own disk,
    may go without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditlake-shared-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


class Versions:
    """A table kept as one Parquet folder for each version. A version counts once it is whole, so a lost driver or a micro-batch that
    runs again finds the one before; older ones are deleted."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _place(self, name: str = ""):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def whole(self) -> list[int]:
        place, fs = self._place()
        if not fs.exists(place):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(place)]
        found = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)]
        return sorted(v for v in found if fs.exists(self._place(f"v{v}/_SUCCESS")[0]))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version (below the given number); None if there is none."""
        known = [v for v in self.whole() if before is None or v < before]
        return self.spark.read.parquet(f"{self.root}/v{known[-1]}") if known else None

    def write(self, table: DataFrame, version: int) -> None:
        """Write a version. The one before stays, as a repeated micro-batch starts from it."""
        table.write.mode("overwrite").parquet(f"{self.root}/v{version}")
        for old in self.whole()[:-2]:
            place, fs = self._place(f"v{old}")
            fs.delete(place, True)
