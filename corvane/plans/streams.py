"""Streaming (ST rows): each runs its stream over a table to its end and returns what came out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import events as E
from ..streaming import timers
from .metrics import LIMITED


@query("st6_rates", "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n FROM events GROUP BY 1")
def st6(spark, sf_dir):
    """Complete output, so that the last windows show as well."""
    out = E.run(E.rates(E.source(spark, sf_dir)), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@query("st1_limiter", LIMITED)
def st1(spark, sf_dir):
    rows, end = timers.closing(E.source(spark, sf_dir))
    return E.run(timers.limiter(rows, 2, 3600), end=end)


#: Events as operations of a cache: views put, errors delete, all others get.
OPERATION = "CASE event_type WHEN 'view' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'get' END"


@query(
    "st3_cache",
    f"""
    WITH o AS (SELECT *, {OPERATION} AS operation FROM events),
    l AS (SELECT *, last_value(CASE WHEN operation <> 'get' THEN {{'operation': operation, 'value': value, 'ts': ts}} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS put FROM o)
    SELECT user_id AS key, event_id AS id, CASE WHEN put.operation = 'put' AND ts < put.ts + INTERVAL 1 DAY THEN put.value END AS value FROM l WHERE operation = 'get'
    """,
)
def st3c(spark, sf_dir):
    """Put, get and delete with a time to live of a day."""
    rows = E.source(spark, sf_dir).select("ts", F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.expr(OPERATION).alias("operation"), "value")
    stream, end = timers.closing(rows)
    return E.run(timers.cache(stream, 86_400), end=end)


@query(
    "st6_alerts",
    """
    WITH w AS (SELECT event_type, time_bucket(INTERVAL 2 HOUR, ts) AS start, quantile_disc(value, 0.95) > 80 AS hot FROM events GROUP BY 1, 2),
    r AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY start) AS run FROM w),
    f AS (SELECT *, hot AND start - min(CASE WHEN hot THEN start END) OVER (PARTITION BY event_type, run) >= INTERVAL 4 HOUR AS firing FROM r)
    SELECT event_type AS key, strftime(start, '%Y-%m-%d %H:%M') AS window_start,
      CASE WHEN firing THEN 'firing' WHEN hot THEN 'pending' WHEN lag(firing, 1, false) OVER (PARTITION BY event_type ORDER BY start) THEN 'resolved' ELSE 'inactive' END AS state FROM f
    """,
)
def st6a(spark, sf_dir):
    """The alert of each event type on the 95th percentile of two hours, when it has been above 80 for four."""
    rows, end = timers.closing(E.source(spark, sf_dir))
    out = E.alerts(rows, end, 80.0, 4 * 3600, minutes=120)
    return out.select("key", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "state")


@query(
    "st8_followed",
    "SELECT v.event_id AS first_id, coalesce(p.event_id, -1) AS then_id FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOUR",
)
def st8j(spark, sf_dir):
    """Views and the purchases of the same user in the six hours after, as a join of two streams."""
    rows = E.source(spark, sf_dir)
    (views, end), (purchases, over) = (timers.closing(rows.filter(F.col("event_type") == kind)) for kind in ("view", "purchase"))
    return E.run(E.followed(views, purchases, "6 HOURS"), end=lambda: (end(), over())).select("first_id", F.coalesce("then_id", F.lit(-1)).alias("then_id"))


@query("st3_first_seen", "SELECT event_id FROM events")
def st3(spark, sf_dir):
    return E.run(E.first_seen(E.source(spark, sf_dir))).select("event_id")


@query("st4_compactions", "SELECT conv_id, CAST(unnest(range(4, n + 1, 4)) AS BIGINT) AS turns FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def st4(spark, sf_dir):
    return E.run(E.compactions(E.source(spark, sf_dir, "conversations"), 4))


@query(
    "st8_sessions",
    """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, count(*) AS n FROM s GROUP BY user_id, session
    """,
)
def st8(spark, sf_dir):
    """Complete output, so that sessions still open at the end show as well."""
    out = E.run(E.sessions(E.source(spark, sf_dir)), "complete")
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "n")


@query(
    "st2_abuse",
    "SELECT user_id, event_id, recent, recent > 2 AS blocked FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECOND PRECEDING AND CURRENT ROW) AS recent FROM events)",
)
def st2(spark, sf_dir):
    rows, end = timers.closing(E.source(spark, sf_dir))
    return E.run(timers.abuse(rows, 2, 3600), end=end)


@query("st5_ingest", "SELECT event_id, user_id, event_type FROM events")
def st5(spark, sf_dir):
    """The same stream read twice: the second time nothing is new."""
    from ..sources.checkpoint import folder

    rows = E.source(spark, sf_dir).select("event_id", "user_id", "event_type")
    target = folder(spark, "ingested")
    for _ in range(2):
        E.ingest(rows, target, "event_id", folder(spark, "progress"))
    schema = rows.schema.add("content_hash", "string").add("version", "long")
    return E.ingested(spark, target, "event_id", schema).select("event_id", "user_id", "event_type")
