"""Streams by event time against their batch forms: a busy user, rows out of order over files and batches, ends and late rows."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.operators import metrics as M
from corvane.sources.checkpoint import folder
from corvane.streaming import events as E
from corvane.streaming import timers

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 1, 1)


def busy(n, users=1, seconds=86_400.0, seed=1):
    rng = random.Random(seed)
    rows = [(i, START + timedelta(microseconds=rng.randrange(int(seconds * 1e6))), rng.randrange(users), rng.choice(["view", "purchase", "error"]), float(rng.randrange(100))) for i in range(n)]
    return rows + [(n + i, r[1], r[2], r[3], r[4]) for i, r in enumerate(rows[: n // 50])]  # rows of one time


def stream_of(spark, tmp_path, files):
    """A stream that reads one file a batch, in this order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}")
    reader = spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    return reader.parquet(f"{tmp_path}/*/part-*.parquet")


def state_rows(spark, progress):
    return [(name, spark.read.format("statestore").option("stateVarName", name).load(progress).count()) for name in ("held", "memory")]


def driven(stream, end):
    """run(), with the state that is left at the end."""
    spark = stream.sparkSession
    progress, out = folder(spark, "progress"), folder(spark, "out")
    for last in (False, True):
        writer = stream.writeStream.outputMode("append").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/b={n}")).option("checkpointLocation", progress)
        writer.trigger(availableNow=True).start().awaitTermination()
        if not last:
            end()
    return spark.read.schema(stream.schema).parquet(f"{out}/b=*"), progress


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """100,000 events of one user, shuffled over five files."""
    rows = busy(100_000)
    random.Random(7).shuffle(rows)
    return rows, stream_of(spark, tmp_path_factory.mktemp("busy"), [rows[k::5] for k in range(5)])


def test_busy_user_is_limited_as_in_a_batch(spark, shuffled):
    rows, stream = shuffled
    closed, end = timers.closing(stream)
    out, progress = driven(timers.limiter(closed, 3, 10, late="2 days"), end)
    want = {r.id: r.allowed for r in M.fixed_windows(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", 3, 10).collect()}
    assert {r.event_id: r.allowed for r in out.collect()} == want and out.count() == len(rows)
    assert state_rows(spark, progress) == [("held", 0), ("memory", 0)]


def test_busy_user_is_counted_as_in_a_batch(spark, shuffled):
    rows, stream = shuffled
    closed, end = timers.closing(stream)
    out, progress = driven(timers.abuse(closed, 5, 60, late="2 days"), end)
    want = {r.event_id: r.recent for r in M.sliding_counts(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", 60).collect()}
    got = out.collect()
    assert {r.event_id: r.recent for r in got} == want and len(got) == len(rows) and all(r.blocked == (r.recent > 5) for r in got)
    assert state_rows(spark, progress) == [("held", 0), ("memory", 0)]


def test_many_users_in_order_of_time_but_for_an_hour(spark, tmp_path):
    """Batches overlap by less than the watermark's delay: windows go on over batches, and nothing is late."""
    rows = sorted(busy(4000, users=12), key=lambda r: r[1].timestamp() + random.Random(r[0]).random() * 3000)
    stream = stream_of(spark, tmp_path, [rows[at : at + 1100] for at in range(0, len(rows), 1100)])
    closed, end = timers.closing(stream)
    out = E.run(timers.limiter(closed, 2, 600, late="2 hours"), end=end)
    want = {r.id: r.allowed for r in M.fixed_windows(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", 2, 600).collect()}
    assert {r.event_id: r.allowed for r in out.collect()} == want


def test_late_rows_are_dropped_by_rule(spark, tmp_path):
    """Late is what stands behind the watermark of the batch before."""
    on_time = [(i, START + timedelta(minutes=i), 1, "view", 1.0) for i in range(100)]
    late = [(1000, START + timedelta(minutes=5), 1, "view", 1.0), (1001, START + timedelta(minutes=95), 1, "view", 1.0)]
    stream = stream_of(spark, tmp_path, [on_time[:99], on_time[99:], late])
    closed, end = timers.closing(stream)
    got = {r.event_id for r in E.run(timers.abuse(closed, 5, 60, late="10 minutes"), end=end).collect()}
    assert got == {r[0] for r in on_time} | {1001}


def test_cache_puts_gets_and_expires(spark, tmp_path):
    schema = "key long, id long, operation string, value double, ts timestamp"
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, rng.choice(["put", "get", "get", "delete"]), float(i), START + timedelta(seconds=rng.randrange(3000))) for i in range(800)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*/part-*.parquet")
    closed, end = timers.closing(stream)
    out, progress = driven(timers.cache(closed, 60, late="1 hour"), end)
    want, held = {}, {}
    for key, number, operation, value, ts in sorted(rows, key=lambda r: (r[4], r[1])):
        if operation == "get":
            value, at = held.get(key, (None, START))
            want[number] = value if value is not None and ts < at + timedelta(seconds=60) else None
        else:
            held[key] = (value if operation == "put" else None, ts)
    assert {r.id: r.value for r in out.collect()} == want and None in want.values() and any(want.values())
    assert state_rows(spark, progress) == [("held", 0), ("memory", 0)]


def test_alerts_hold_before_they_fire(spark, tmp_path):
    schema = "key string, id long, value double, ts timestamp"
    values = [1, 9, 9, 9, 9, None, 9, 9, 1, 1, 9, 9, 9, 9, 2, 1]
    rows = [("a", i, float(v) if v is not None else None, START + timedelta(minutes=5 * i)) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "w"))
    closed, end = timers.closing(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "w")))
    got = [r.state for r in E.run(timers.alerts(closed, 5.0, 600), end=end).orderBy("id").collect()]
    assert got == ["inactive", "pending", "pending", "firing", "firing", "resolved", "pending", "pending", "inactive", "inactive", "pending", "pending", "firing", "firing", "resolved", "inactive"]


def test_sketches_merge_and_keep_their_error(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, START + timedelta(seconds=i // 10), 1, rng.choice(["a", "b"]), rng.lognormvariate(3, 1)) for i in range(60_000)]
    stream = stream_of(spark, tmp_path, [rows[:30_000], rows[30_000:]])
    closed, end = timers.closing(stream)
    windows = E.run(E.sketched(closed, 5, size=200), end=end)
    assert windows.agg(F.sum("n")).first()[0] == len(rows)
    ranks = windows.groupBy("event_type").agg(F.kll_merge_agg_double("sketch").alias("s")).select("event_type", E.p95_of(F.col("s")).alias("v")).collect()
    for kind, found in ranks:
        values = [r[4] for r in rows if r[3] == kind]
        assert abs(sum(v <= found for v in values) / len(values) - 0.95) < 0.02


def test_followed_equals_sql_and_drops_late_rows(spark, tmp_path):
    rows = sorted(busy(3000, users=40), key=lambda r: r[1])
    late = [(9000, START + timedelta(minutes=1), 3, "view", 1.0), (9001, START + timedelta(minutes=1), 3, "purchase", 1.0)]
    stream = stream_of(spark, tmp_path, [rows[:1500], rows[1500:], late])
    (views, end), (purchases, over) = (timers.closing(stream.filter(F.col("event_type") == kind)) for kind in ("view", "purchase"))
    got = sorted(map(str, E.run(E.followed(views, purchases, "1 HOURS", late="10 minutes"), end=lambda: (end(), over())).collect()))
    events = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841
    sql = "SELECT v.event_id, p.event_id FROM events v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view'"
    want = sorted(f"Row(first_id={a}, then_id={b})" for a, b in duckdb.sql(sql).fetchall())
    assert got == want and any("None" in g for g in got)


def test_streams_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "e"))
    for make in (lambda s: timers.limiter(s, 1, 1), lambda s: timers.abuse(s, 1, 1), lambda s: E.sketched(s)):
        closed, end = timers.closing(spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema).parquet(str(tmp_path / "e")))
        assert E.run(make(closed), end=end).count() == 0
