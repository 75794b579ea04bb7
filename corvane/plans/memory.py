"""Conversation memory (M, E15 to E17, W4, O5 rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory as M
from ..registry import query, table
from . import sql as S

TOKENS = "CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END"


def cap_sql(x: str, n: int) -> str:
    c = S.strip(S.collapse(x))
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n - 3}) || '...' ELSE {c} END"


def talks(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("m1_scope_keys", "SELECT c_custkey, replace(replace(c_mktsegment || ':x%', '%', '%25'), ':', '%3A') || ':' || replace(replace(c_name, '%', '%25'), ':', '%3A') AS scope FROM customer")
def m1(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", M.scope_key(F.concat("c_mktsegment", F.lit(":x%")), F.col("c_name")).alias("scope"))


@query("m2_newest_conversations", "SELECT conv_id, count(*) AS turns, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 50")
def m2(spark, sf_dir):
    """The listing's limit of 50 is the feature."""
    return talks(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(50)


@query("m3_append_turns", f"SELECT conv_id, CAST(count(*) AS BIGINT) AS message_count, CAST(max(length(substr(text, 1, 5000))) AS BIGINT) AS longest FROM conversations WHERE {S.strip('text')} <> '' GROUP BY conv_id")
def m3(spark, sf_dir):
    kept = talks(spark, sf_dir).filter(T.strip(F.col("text")) != "").withColumn("content", F.col("text").substr(1, 5000))
    return kept.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max(F.length("content")).cast("long").alias("longest"))


RECENT = f"""
    SELECT conv_id, turn, role, text FROM (
      SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM (SELECT *, {TOKENS} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 8)
    WHERE age = 1 OR upto <= {{budget}}
"""


@query("m4_recent_turns", f"SELECT conv_id, turn FROM ({RECENT.format(budget=400)})")
def m4(spark, sf_dir):
    return M.recent_turns(talks(spark, sf_dir), most_tokens=400).select("conv_id", "turn")


SUMMARY = f"""
    SELECT conv_id, {cap_sql('l', 1800)} AS summary FROM (
      SELECT conv_id, 'Key conversation points:' || chr(10) || string_agg('- ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || {cap_sql('text', 220)}, chr(10) ORDER BY turn) AS l
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 12 GROUP BY conv_id)
"""


@query("m6_heuristic_summary", SUMMARY)
def m6(spark, sf_dir):
    return M.heuristic_summary(talks(spark, sf_dir))


@query(
    "m5_context_text",
    f"""
    WITH s AS ({SUMMARY}), r AS (SELECT conv_id, string_agg(upper(role) || ': ' || {cap_sql('text', 1200)}, chr(10) ORDER BY turn) AS l FROM ({RECENT.format(budget=1400)}) GROUP BY conv_id)
    SELECT conv_id, {S.strip(f"'Conversation summary:' || chr(10) || {cap_sql('summary', 2400)} || chr(10) || chr(10) || 'Recent turns:' || chr(10) || l")} AS context FROM s JOIN r USING (conv_id)
    """,
)
def m5(spark, sf_dir):
    return M.context_text(M.recent_turns(talks(spark, sf_dir)), m6(spark, sf_dir))


@query("m7_compaction", "SELECT conv_id, count(*) >= 4 AS compact FROM conversations GROUP BY conv_id")
def m7(spark, sf_dir):
    return talks(spark, sf_dir).groupBy("conv_id").agg((F.count("*") >= 4).alias("compact"))


@query("m8_remembered", "SELECT conv_id, turn FROM conversations WHERE NOT (role = 'assistant' AND conv_id % 5 IN (1, 2))")
def m8(spark, sf_dir):
    """Answers that were flagged or blocked aren't remembered."""
    action = F.when(F.col("conv_id") % 5 == 1, "flag").when(F.col("conv_id") % 5 == 2, "block").otherwise("return")
    return talks(spark, sf_dir).filter(~((F.col("role") == "assistant") & action.isin("flag", "block"))).select("conv_id", "turn")


def mentions_sql(keep: str) -> str:
    return f"SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age, sum(len({S.words('text')})) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM conversations) WHERE upto <= 120{keep}"


@query("e15_mentions_in_budget", mentions_sql(""))
def e15(spark, sf_dir):
    return M.trimmed_mentions(talks(spark, sf_dir), "conv_id", "turn", "text", 120, False).select("conv_id", "turn")


@query("e17_mentions_keep_newest", mentions_sql(" OR age = 1"))
def e17(spark, sf_dir):
    return M.trimmed_mentions(talks(spark, sf_dir), "conv_id", "turn", "text", 120, True).select("conv_id", "turn")


@query(
    "e16_mention_summary",
    "SELECT conv_id, string_agg(text || CASE WHEN rn = 1 THEN ' (' || role || ')' ELSE '' END, ' | ' ORDER BY turn) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id",
)
def e16(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) == 1
    rows = talks(spark, sf_dir).withColumn("line", F.concat(F.col("text"), F.when(first, F.concat(F.lit(" ("), F.col("role"), F.lit(")"))).otherwise("")))
    return M.joined_turns(rows, "conv_id", "turn", "line", "summary", " | ")
