"""Latency, rates, limits and tuning signals over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Percentiles are bracketed within so many ranks in a group, of its rows divided by this.
ACCURACY = 10_000


def stage_totals(timings: DataFrame, bucket: str = "event_type", ms: str = "value") -> DataFrame:
    """Milliseconds by bucket, and of all buckets (null); rounded after summing."""
    return timings.rollup(F.coalesce(bucket, F.lit("other")).alias("bucket")).agg(F.round(F.sum(ms), 1).alias("total_ms"))


def nearest_rank(rows: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """The value at place round(p / 100 * (n - 1)) of each group's n values; null ones don't count.

    Exact without a group's rows in one task: an approximate percentile of known error brackets the place,
    rows below the bracket are only counted, and of those inside the distinct values are ranked by their counts.
    """
    slack = 4 / ACCURACY
    bounds = [F.percentile_approx(value, [max(p / 100 - slack, 0.0), min(p / 100 + slack, 1.0)], ACCURACY).alias(f"b{p}") for p in percents]
    sizes = rows.groupBy(group).agg(F.count(value).alias("n"), *bounds)
    kinds = F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"b{p}")[0].alias("low"), F.col(f"b{p}")[1].alias("high")) for p in percents])
    known = rows.select(F.col(group).alias("g_"), F.col(value).alias("v")).filter("v is not null")
    marked = known.join(sizes, F.col("g_").eqNullSafe(F.col(group))).withColumn("k", F.explode(kinds)).select("g_", "v", "n", "k.*")
    inside = F.col("v").between(F.col("low"), F.col("high"))
    counted = marked.filter(F.col("v") <= F.col("high")).groupBy("g_", "p", "n", F.when(inside, F.col("v")).alias("v")).count()
    upto = F.sum("count").over(Window.partitionBy("g_", "p").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    found = counted.withColumn("upto", upto).filter(F.col("v").isNotNull() & (F.col("upto") > F.rint(F.col("p") / 100 * (F.col("n") - 1))))
    found = found.groupBy("g_", "p").agg(F.min("v").alias("v"))
    out = sizes.select(group).join(found, F.col(group).eqNullSafe(F.col("g_")), "left")
    return out.groupBy(group).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents])


def histogram(rows: DataFrame, group: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at most each bound, and at most infinity."""
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in [*bounds, float("inf")]])
    return rows.groupBy(group).agg(pairs.alias("b")).select(group, F.inline("b"))


def windowed_rates(rows: DataFrame, ts: str, minutes: int = 5) -> DataFrame:
    """Events a second and the 95th percentile of the value in each window."""
    w = F.window(ts, f"{minutes} minutes")
    return rows.groupBy(w).agg(F.count("*").alias("n"), (F.count("*") / (60.0 * minutes)).alias("rate"), F.percentile("value", 0.95).alias("p95"))


def sliding_counts(rows: DataFrame, group: str, ts: str, seconds: int = 60) -> DataFrame:
    """For each row how many of its group's rows fell into the last seconds, itself included."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(group).orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumn("recent", F.count("*").over(w))


def escalation(rows: DataFrame, group: str, order: list[str], violation: Column) -> DataFrame:
    """none, warn from the first violation of a group on, block from the third."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(violation.cast("int")).over(w)
    return rows.withColumn("level", F.when(seen >= 3, "block").when(seen >= 1, "warn").otherwise("none"))


def hot_streaks(rows: DataFrame, group: str, order: list[str], hot: Column, up_after: int = 2, down_after: int = 5) -> DataFrame:
    """up at each up_after-th hot row in a row, down at each down_after-th cool one, else hold."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("hot_", hot)
    marked = marked.withColumn("turns_", F.sum((F.col("hot_") != F.coalesce(F.lag("hot_").over(w), ~F.col("hot_"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.row_number().over(Window.partitionBy(group, "turns_").orderBy(*order))
    marked = marked.withColumn("streak", streak)
    decision = F.when(F.col("hot_") & (F.col("streak") % up_after == 0), "up").when(~F.col("hot_") & (F.col("streak") % down_after == 0), "down").otherwise("hold")
    return marked.withColumn("decision", decision).drop("hot_", "turns_")


def fixed_windows(rows: DataFrame, group: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """Whether each request is let through, where a window starts at the first request after the last one ended.

    Each group's requests are folded in order; a batch of a group is a streaming state of two numbers,
    which streaming.timers.limiter keeps. Here they are read through an iterator, never as one table.
    """

    def fold(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            ids, keys, times = (batch.column(k).to_pylist() for k in ("id", "k", "t"))
            allowed = []
            for key, t in zip(keys, times, strict=True):
                if held is None or held[0] != key or t >= held[1]:
                    held = [key, t + seconds * 1_000_000, 0]
                held[2] += 1
                allowed.append(held[2] <= limit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(allowed)], ["id", "allowed"])

    keyed = rows.select(F.col(order).cast("long").alias("id"), F.col(group).cast("string").alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return keyed.repartition("k").sortWithinPartitions("k", "t", "id").mapInArrow(fold, "id long, allowed boolean")


def tuning_signals(metrics: DataFrame, limits: dict[str, tuple[float, str, str]]) -> DataFrame:
    """metrics: one row of named numbers. A row (signal, value, severity, advice) for each above its limit; null never is."""
    pairs = F.array(*[F.struct(F.lit(k).alias("signal"), F.col(k).cast("double").alias("value"), F.lit(v[0]).alias("limit_"), F.lit(v[1]).alias("severity"), F.lit(v[2]).alias("advice")) for k, v in limits.items()])
    return metrics.select(F.inline(pairs)).filter("value > limit_").drop("limit_")


def scaling(metrics: DataFrame, hot: dict[str, float], cool: dict[str, float]) -> DataFrame:
    """up if any number is over its hot limit; down if all are under their cool ones (null counts as under)."""
    any_hot, all_cool = F.lit(False), F.lit(True)
    for k, v in hot.items():
        any_hot = any_hot | F.coalesce(F.col(k) > v, F.lit(False))
    for k, v in cool.items():
        all_cool = all_cool & F.coalesce(F.col(k) < v, F.lit(True))
    return metrics.withColumns({"scale_up": any_hot, "scale_down": ~any_hot & all_cool})
