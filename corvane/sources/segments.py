"""Folders of Parquet segments that only grow: what an index keeps between batches of queries.

A segment's name begins with the time at which it was begun and ends in a random part, so that two writers
never take the same one. Only segments that Spark's committer has finished are read. Removals are
segments too: ids that count as gone from all segments begun before.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Segments:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def names(self, kind: str) -> list[str]:
        """The finished segments of a kind, oldest first."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [s.getPath() for s in files.listStatus(root)]
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(p.getName() for p in found if p.getName().startswith(f"{kind}-") and done(p))

    def write(self, rows: DataFrame, kind: str, of: str | None = None) -> str:
        """Write a segment; with `of`, under the time and random part of that one."""
        name = f"{kind}-{of.partition('-')[2]}" if of else f"{kind}-{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def read(self, kind: str, names: list[str] | None = None) -> DataFrame | None:
        """The rows of all segments of a kind with `begun`, the segment's time; none if there is no segment."""
        names = self.names(kind) if names is None else names
        if not names:
            return None
        rows = self.spark.read.parquet(*(f"{self.root}/{n}" for n in names))
        return rows.withColumn("begun", F.regexp_extract(F.col("_metadata.file_path"), rf"/{kind}-(\d+)-[0-9a-f]+/", 1).cast("long"))

    def drop(self, names: list[str]) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
