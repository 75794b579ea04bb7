"""An object store of texts with metadata, as batches of Parquet files on any Hadoop store.

A batch's data are written first and its marker last, so a batch that was cut off is never read. Of a
key's rows that of the newest batch counts; a row may say that the object is deleted, which leaves its
content where it is. Keys are kept as given, beside a form that is safe in file names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMA = "key string, safe_key string, content string, metadata map<string,string>, deleted boolean"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[int]:
        """The committed batches, oldest first: as many as there were writes."""
        files, root = self._path("")
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root)]
        return sorted(int(n.removeprefix("done-")) for n in names if n.startswith("done-"))

    def write(self, rows: DataFrame) -> int:
        """Write a batch's data, without its marker; its number."""
        number = max([0, *self.batches()]) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/batch-{number}")
        return number

    def commit(self, number: int) -> None:
        files, path = self._path(f"done-{number}")
        files.create(path, False).close()

    def put(self, objects: DataFrame) -> None:
        """objects (key, content, metadata): stored, replacing what their keys held."""
        rows = objects.select("key", T.safe_key(F.col("key")).alias("safe_key"), "content", "metadata", F.lit(False).alias("deleted"))
        self.commit(self.write(rows))

    def delete(self, keys: DataFrame) -> None:
        """keys (key): deleted, but their content stays in older batches."""
        gone = self.objects().join(keys.select("key").distinct(), "key", "left_semi")
        self.commit(self.write(gone.select("key", "safe_key", F.lit(None).cast("string").alias("content"), "metadata", F.lit(True).alias("deleted"))))

    def _newest(self) -> DataFrame:
        numbers = self.batches()
        if not numbers:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.root}/batch-{n}" for n in numbers))
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch-(\d+)/", 1).cast("long")
        rows = rows.withColumn("batch", number)
        last = Window.partitionBy("key").orderBy(F.desc("batch"), F.desc("content"))
        return rows.withColumn("place_", F.row_number().over(last)).filter("place_ = 1").drop("place_", "batch")

    def objects(self) -> DataFrame:
        """key, safe_key, content, metadata of what is there."""
        return self._newest().filter("not deleted").drop("deleted")

    def exists(self, keys: DataFrame) -> DataFrame:
        """keys with `there`."""
        known = self.objects().select("key", F.lit(True).alias("there"))
        return keys.join(known, "key", "left").withColumn("there", F.coalesce("there", F.lit(False)))
