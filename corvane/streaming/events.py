"""Streams over event tables. Each function takes a streaming DataFrame and returns one; run() drives it to the end of its input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.checkpoint import folder
from . import timers


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream. Event times become TIMESTAMP, since watermarks take no other type."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    rows = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def run(stream: DataFrame, mode: str = "append", end: Callable[[], None] | None = None) -> DataFrame:
    """Process all that is there and return what the stream put out, as a table in the shared folder.

    With `end` (see timers.closing) the stream is then ended and goes on from where it was until nothing is held any more. A batch is written to a folder of its own, so a repeated batch replaces what it wrote; of complete
    output the last batch counts, of any other all.
    """
    spark = stream.sparkSession
    out, done = folder(spark, "stream"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    progress = folder(spark, "progress")
    for last in (False, True) if end else (True,):
        writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", progress)
        writer.trigger(availableNow=True).start().awaitTermination()
        if not last:
            end()
    paths = [f"{out}/batch={n}" for n in sorted(set(done))]
    if not paths:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(paths[-1:] if mode == "complete" else paths))


def rates(events: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Events a second and the mean value of each window; events later than the watermark are dropped."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each key once: the stream form of a cache with a time to live."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sketched(events: DataFrame, minutes: int = 5, late: str = "10 minutes", group: str = "event_type", size: int = 1024) -> DataFrame:
    """(group, window, n, sketch): of each window a KLL sketch of the values, exact up to `size` of them; put out once the watermark has passed it.

    Sketches of windows or groups merge to those of any longer time (p95_of). A rank is off by some 1.7 / size
    of the window's values with a probability of 0.99.
    """
    rows = events.withWatermark("ts", late).filter(f"ts < timestamp'{timers.END}'")
    return rows.groupBy(F.window("ts", f"{minutes} minutes"), group).agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", size).alias("sketch"))


def p95_of(sketch: Column, rank: float = 0.95) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))


def alerts(events: DataFrame, end: Callable[[], None], above: float, hold: int, minutes: int = 5, late: str = "10 minutes", group: str = "event_type") -> DataFrame:
    """(key, window_start, state): for each window of each group whether the alert "95th percentile above so much for `hold` seconds" is inactive, pending, firing or resolved.

    Two streams: the first puts out a sketch a window, the second holds the windows of a key until their order is certain.
    """
    spark = events.sparkSession
    done = run(sketched(events, minutes, late, group), end=end).filter("n > 0")
    path = folder(spark, "windows")
    done.select(F.col(group).alias("key"), F.unix_micros("window.start").alias("id"), p95_of(F.col("sketch")).alias("value"), F.col("window.end").alias("ts")).write.parquet(path)
    windows, over = timers.closing(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    out = run(timers.alerts(windows, above, hold, late), end=over)
    return out.select("key", F.timestamp_micros("id").alias("window_start"), "state")


def followed(first: DataFrame, then: DataFrame, within: str, late: str = "10 minutes") -> DataFrame:
    """(first_id, then_id): rows of two event streams of one user, the second at most so much later; a null then_id where none came until the watermark passed.

    Both sides have watermarks, so that a row's state goes when no partner can come any more, and rows behind them are dropped.
    """
    side = lambda rows, name: rows.select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", late).filter(f"{name}_ts < timestamp'{timers.END}'")
    near = F.expr(f"first_user = then_user AND then_ts >= first_ts AND then_ts <= first_ts + INTERVAL {within}")
    return side(first, "first").join(side(then, "then"), near, "left_outer").select("first_id", "then_id")


def compactions(turns: DataFrame, every: int = 12) -> DataFrame:
    """(conv_id, turns): a row each time a conversation has gained so many turns."""

    def step(key, parts: Iterator, state):
        import pandas as pd

        count = state.get[0] if state.exists else 0
        out = []
        for part in parts:
            for _ in range(len(part)):
                count += 1
                if count % every == 0:
                    out.append((key[0], count))
        state.update((count,))
        yield pd.DataFrame(out, columns=["conv_id", "turns"])

    return turns.select("conv_id", "turn").groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turns long", "count long", "append", "NoTimeout")


def ingested(spark: SparkSession, target: str, key: str, schema, before: int | None = None) -> DataFrame:
    """The newest version of each row that ingest() wrote; with `before`, as it was before that batch."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(hadoop)] if files.exists(hadoop) else []
    paths = [f"{target}/{n}" for n in names if n.startswith("version=") and (before is None or int(n[8:]) < before)]
    if not paths:
        return spark.createDataFrame([], schema)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))
    return spark.read.schema(schema).parquet(*paths).withColumn("place_", last).filter("place_ = 1").drop("place_")


def ingest(stream: DataFrame, target: str, key: str, checkpoint: str, order: list[str] | None = None) -> None:
    """Write the rows of each batch that are new or changed to a folder of the batch's own, which a repeated batch replaces.

    Of a batch's rows with one key that with the last `order` counts, then that with the least hash. ingested() reads the result.
    """
    order = order or []
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("content_hash", F.sha2(F.to_json(F.struct(*batch.columns)), 256))
        newest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order], "content_hash"))
        fresh = fresh.withColumn("place_", newest).filter("place_ = 1").drop("place_").withColumn("version", F.lit(number).cast("long"))
        known = ingested(spark, target, key, fresh.schema, before=number).select(key, "content_hash")
        fresh.join(known, [key, "content_hash"], "left_anti").select(fresh.columns).write.mode("overwrite").parquet(f"{target}/version={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
