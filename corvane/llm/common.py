"""Helpers shared by the training-data operators: table access, shared scratch space, framed files."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def learnable(column="doc_id"):
    """True for rows that a model may learn labels from: crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(F.col(column).cast("string")) % 4 != 2


def held_out(column="doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def draw(rows: DataFrame, bound: int) -> DataFrame:
    """The `bound` distinct rows with the least hashes of all their columns, or all if there are fewer; with the hash as column `h`, in its order.

    Equal rows count once, so neither a repeated id nor a group of copies can crowd out others. As it
    is known about how many hashes there are, only some twice the bound are sorted.
    """
    hashed = rows.withColumn("h", F.xxhash64(*rows.columns))
    distinct = hashed.agg(F.approx_count_distinct("h")).first()[0]
    if distinct > 2 * bound:
        hashed = hashed.filter(F.col("h") < -(1 << 63) + (2 * bound << 64) // distinct)
    least = stage(hashed.dropDuplicates(["h"]), "drawn")
    return least.orderBy("h").limit(bound)


# ---------------------------------------------------------------- scratch space


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder that the cluster shares (spark.checkpoint.dir).

    Only where that setting is absent and Spark runs on one machine, as in tests, a local temporary
    folder is set up for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = getattr(spark, "_corvane_scratch", None)
        if root is None:
            root = spark._corvane_scratch = tempfile.mkdtemp(prefix="corvane-")
    path = f"{root.rstrip('/')}/corvane-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM is gone; the cluster expires its shared folder
        pass


def with_columns(docs: DataFrame, text_col: str, columns: dict, compute: Callable) -> DataFrame:
    """docs with columns (names and types) that compute() makes of an Arrow array of texts; columns of these names are replaced."""
    new = {c.lower() for c in columns}
    kept = [c for c in docs.columns if c.lower() not in new]
    at = len(kept)  # the text is the last column, under a name that doesn't matter
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("the text"))

    def add(batches):
        import pyarrow as pa

        for batch in pieces_of(batches, at):
            made = compute(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*kept, *columns])

    schema = type(docs.schema)(rows.schema.fields[:-1])
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(add, schema)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    path = scratch(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Remove the files that a table of stage() is read from, once nothing will read it any more."""
    for folder in {os.path.dirname(file) for file in staged.inputFiles()}:
        _remove(staged.sparkSession, folder)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over the cores if their files have fewer splits than there are cores, so that costly work on few bytes uses all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024, size: int | None = None) -> Iterator[None]:
    """Jobs that begin here pass whole texts to Python in batches of at most so many rows, and of about `size` bytes if given: the default's may take much memory."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {k: spark.conf.get(k).removesuffix("b") for k in keys}
    for k, most in keys.items():
        spark.conf.set(k, str(min(most, int(before[k])) if before[k].isdigit() and int(before[k]) > 0 else most))
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


# ---------------------------------------------------------------- files of binary frames


def write_frames(frames: DataFrame, path: str, trailer: bytes, file_frames: int = 0) -> None:
    """Write each row's binary column `frame`, followed by `trailer`; a file a partition, or more of at most `file_frames` rows (0: any number).

    Spark's text writer passes bytes through unchanged, so files go to any Hadoop store and a lost
    task leaves nothing behind: only committed tasks' files appear.
    """
    column = F.col("frame").cast("string")
    out = frames.select(column.alias("value")).write.option("lineSep", trailer.decode("ascii"))
    with small_batches(frames.sparkSession, size=4 << 20):
        out.option("maxRecordsPerFile", file_frames).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Columns file (long, in the order of the writing partitions and of their files) and content of the files of write_frames."""
    number = lambda pattern: F.regexp_extract(F.col("path"), pattern, 1).cast("long")
    file = F.shiftleft(number(r"part-(\d+)-"), 24) + number(r"-c(\d+)[^/]*$")
    return spark.read.format("binaryFile").load(path).select(file.alias("file"), "content")


def pieces_of(batches: Iterator, column: str | int = "text", limit: int = 4_000_000) -> Iterator:
    """Arrow batches cut into slices of at most `limit` bytes in a string or binary column, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        at = total = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if i > at and total + (n or 0) > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n or 0
        if batch.num_rows > at:
            yield batch.slice(at)


def release() -> None:
    """Give freed memory of Arrow and of the C library back: a worker that outlives its tasks would keep its largest batch's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
