"""Metrics, windows, limits (A7, A13 to A17, W8 to W11, P5 to P7 rows). Events stand in for timings and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..registry import query, table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("a7_stage_totals", "SELECT event_type AS bucket, round(sum(value), 1) AS total_ms FROM events GROUP BY ROLLUP (event_type)")
def a7(spark, sf_dir):
    return M.stage_totals(events(spark, sf_dir))


@query("p5_stage_totals_by_default", "SELECT CASE WHEN grouping(k) = 1 THEN 'all' ELSE k END AS bucket, round(sum(value), 1) AS total_ms FROM (SELECT coalesce(CASE WHEN user_id % 3 <> 0 THEN event_type END, 'other') AS k, value FROM events) GROUP BY ROLLUP (k)")
def p5(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("b", F.when(F.col("user_id") % 3 != 0, F.col("event_type")))
    totals = rows.withColumn("k", F.coalesce("b", F.lit("other"))).rollup("k").agg(F.round(F.sum("value"), 1).alias("total_ms"), F.grouping("k").alias("all_"))
    return totals.select(F.when(F.col("all_") == 1, "all").otherwise(F.col("k")).alias("bucket"), "total_ms")


@query(
    "a13_percentiles",
    """
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type
    """,
)
def a13(spark, sf_dir):
    p = lambda x: F.round(F.percentile("value", x), 6)
    return events(spark, sf_dir).groupBy("event_type").agg(p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"))


@query(
    "a13_nearest_rank",
    "SELECT event_type, max(CASE WHEN place = round_even(0.5 * (n - 1), 0) THEN value END) AS p50, max(CASE WHEN place = round_even(0.95 * (n - 1), 0) THEN value END) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type",
)
def a13n(spark, sf_dir):
    return M.nearest_rank(events(spark, sf_dir), "event_type", "value", [50, 95])


BOUNDS = [1, 5, 10, 50, 100, 500]


@query("a14_histogram", "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([1::DOUBLE, 5, 10, 50, 100, 500, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2")
def a14(spark, sf_dir):
    return M.histogram(events(spark, sf_dir), "event_type", "value", BOUNDS)


@query("a15_rates", "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(count(*) / 300.0, 6)::DOUBLE AS rate, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def a15(spark, sf_dir):
    rates = M.windowed_rates(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts")
    return rates.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", F.round("rate", 6).alias("rate"), F.round("p95", 6).alias("p95"))


@query("a16_run_summary", "SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS processed, count(*) FILTER (WHERE doc_id % 4 = 1) AS skipped, count(*) FILTER (WHERE doc_id % 4 = 2) AS failed, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN n_chars // 512 + 1 ELSE 0 END) AS BIGINT) AS stored_chunks FROM documents")
def a16(spark, sf_dir):
    state = F.col("doc_id") % 4
    return table(spark, sf_dir, "documents").agg(
        F.count_if(state == 0).alias("processed"), F.count_if(state == 1).alias("skipped"), F.count_if(state == 2).alias("failed"), F.sum(F.when(state == 0, F.floor(F.col("n_chars") / 512) + 1).otherwise(0)).alias("stored_chunks")
    )


@query("a17_report", "SELECT source, count(*) FILTER (WHERE doc_id % 3 = 0) AS done, count(*) FILTER (WHERE doc_id % 3 = 1) AS failed, count(*) FILTER (WHERE doc_id % 3 = 2) AS skipped FROM documents GROUP BY source")
def a17(spark, sf_dir):
    outcome = F.get(F.array(F.lit("done"), F.lit("failed"), F.lit("skipped")), (F.col("doc_id") % 3).cast("int"))
    return table(spark, sf_dir, "documents").select("source", outcome.alias("o")).groupBy("source").pivot("o", ["done", "failed", "skipped"]).agg(F.count("o")).na.fill(0)


@query("w8_sliding_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECOND PRECEDING AND CURRENT ROW) AS recent FROM events")
def w8(spark, sf_dir):
    return M.sliding_counts(events(spark, sf_dir), "user_id", "ts", 60).select("event_id", "recent")


@query("w9_escalation", "SELECT event_id, CASE WHEN s >= 3 THEN 'block' WHEN s >= 1 THEN 'warn' ELSE 'none' END AS level FROM (SELECT event_id, sum((event_id % 7 = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)")
def w9(spark, sf_dir):
    return M.escalation(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_id") % 7 == 0).select("event_id", "level")


LIMITED = """
    WITH RECURSIVE e AS (SELECT event_id, user_id, ts FROM events), d AS (SELECT DISTINCT user_id, ts FROM e),
    n AS (SELECT *, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM d),
    s(user_id, start) AS (SELECT user_id, min(ts) FROM d GROUP BY 1 UNION ALL SELECT n.user_id, n.following FROM s JOIN n ON n.user_id = s.user_id AND n.ts = s.start WHERE n.following IS NOT NULL),
    w AS (SELECT e.*, max(s.start) OVER (PARTITION BY e.user_id ORDER BY e.ts) AS opened FROM e LEFT JOIN s ON e.user_id = s.user_id AND e.ts = s.start)
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, opened ORDER BY ts, event_id) <= 2 AS allowed FROM w
"""


@query("w10_fixed_windows", f"SELECT event_id AS id, allowed FROM ({LIMITED})")
def w10(spark, sf_dir):
    return M.fixed_windows(events(spark, sf_dir), "user_id", "ts", "event_id", 2, 3600)


@query(
    "w11_hot_streaks",
    """
    WITH m AS (SELECT *, (value > 50) AS hot FROM events),
    t AS (SELECT *, sum((hot IS DISTINCT FROM lag_hot)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(hot) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lag_hot FROM m)),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM t)
    SELECT event_id, CASE WHEN hot AND streak % 2 = 0 THEN 'up' WHEN NOT hot AND streak % 5 = 0 THEN 'down' ELSE 'hold' END AS decision FROM s
    """,
)
def w11(spark, sf_dir):
    return M.hot_streaks(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("value") > 50).select("event_id", "decision")


LIMITS = {"p95": (10.0, "high", "add workers"), "n": (1e9, "low", "nothing"), "missing": (0.0, "high", "never shown"), "errors": (5.0, "medium", "look at the log")}


@query("p6_tuning_signals", "SELECT * FROM (SELECT 'p95' AS signal, round(quantile_cont(value, 0.95), 6) AS value, 'high' AS severity, 'add workers' AS advice FROM events UNION ALL SELECT 'errors', count(*) FILTER (WHERE event_type = 'error' OR event_id % 10 = 0)::DOUBLE, 'medium', 'look at the log' FROM events) WHERE (signal = 'p95' AND value > 10) OR (signal = 'errors' AND value > 5)")
def p6(spark, sf_dir):
    m = events(spark, sf_dir).agg(
        F.round(F.percentile("value", 0.95), 6).alias("p95"), F.count("*").alias("n"), F.lit(None).cast("double").alias("missing"), F.count_if((F.col("event_type") == "error") | (F.col("event_id") % 10 == 0)).alias("errors")
    )
    return M.tuning_signals(m, LIMITS)


@query(
    "p7_scaling",
    "SELECT user_id, coalesce(p95 > 80, false) OR n > 25 AS scale_up, NOT (coalesce(p95 > 80, false) OR n > 25) AND coalesce(p95 < 60, true) AND n < 20 AS scale_down FROM (SELECT user_id, count(*) AS n, CASE WHEN user_id % 5 > 0 THEN round(quantile_cont(value, 0.95), 6) END AS p95 FROM events GROUP BY user_id)",
)
def p7(spark, sf_dir):
    m = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.95), 6).alias("p95")).withColumn("p95", F.when(F.col("user_id") % 5 > 0, F.col("p95")))
    return M.scaling(m, {"p95": 80, "n": 25}, {"p95": 60, "n": 20}).select("user_id", "scale_up", "scale_down")
