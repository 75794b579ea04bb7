"""Cutting the lineage of iterative plans, by files that every executor can read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder that the cluster shares (spark.checkpoint.dir); it is removed when Python ends.

    Only where that setting is absent and Spark runs on one machine, as in tests, a local temporary one is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = getattr(spark, "_corvane_folder", None)
        if root is None:
            root = spark._corvane_folder = tempfile.mkdtemp(prefix="corvane-")
    path = f"{root.rstrip('/')}/corvane-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM is gone; the cluster expires its shared folder
        pass


def checkpointed(df: DataFrame, label: str = "step") -> DataFrame:
    """df, computed once, written as Parquet into the shared folder and read back."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
