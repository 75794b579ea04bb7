"""Tables with keyed rows, on any format that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .checkpoint import checkpointed


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with those of changes put in or replaced, by key."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def ensure(spark: SparkSession, name: str, schema: str, partitioned_by: list[str] | None = None) -> None:
    """Create a table if it isn't there."""
    by = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{by}")


def save_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line; the folder's old content goes only when the job has ended well."""
    rows.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows that can be read, and the lines that can't."""
    rows = checkpointed(spark.read.schema(schema + ", _corrupt_record string").json(path))
    return rows.filter("_corrupt_record is null").drop("_corrupt_record"), rows.filter("_corrupt_record is not null").select("_corrupt_record")
