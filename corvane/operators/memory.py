"""Conversation memory: windows of recent turns, context blocks, summaries, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def scope_key(tenant: Column, subject: Column, project: Column | None = None) -> Column:
    """tenant:subject[:project] with % and : in the parts escaped."""
    part = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))
    return F.concat_ws(":", part(tenant), part(subject), *([part(project)] if project is not None else []))


def joined_turns(turns: DataFrame, conversation: str, order: str, line: str, name: str, separator: str = "\n") -> DataFrame:
    """Per conversation the lines of its turns, in order."""
    grouped = turns.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct(order, line))).alias("all_"))
    return grouped.select(conversation, F.array_join(F.transform("all_", lambda x: x[line]), separator).alias(name))


def recent_turns(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", text: str = "text", most: int = 8, most_tokens: int = 1400) -> DataFrame:
    """The newest turns, at most `most`, up to the first that exceeds the token budget; the newest always stays."""
    newest = Window.partitionBy(conversation).orderBy(F.desc(order))
    ranked = turns.withColumn("age_", F.row_number().over(newest)).filter(F.col("age_") <= most).withColumn("tokens", T.estimated_tokens(F.col(text)))
    upto = F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("upto_", upto).filter((F.col("age_") == 1) | (F.col("upto_") <= most_tokens)).drop("age_", "upto_")


def trimmed_mentions(mentions: DataFrame, group: str, order: str, text: str, budget: int, keep_newest: bool) -> DataFrame:
    """The newest mentions within a budget of words; one that is larger alone is kept only if keep_newest."""
    newest = Window.partitionBy(group).orderBy(F.desc(order))
    words = F.size(T.words(F.col(text)))
    upto = F.sum(words).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    ranked = mentions.withColumn("upto_", upto).withColumn("age_", F.row_number().over(newest))
    fits = F.col("upto_") <= budget
    return ranked.filter(fits | (F.col("age_") == 1) if keep_newest else fits).drop("upto_", "age_")


def context_text(turns: DataFrame, summaries: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """The summary and the recent turns of each conversation as one block."""
    line = F.concat(F.upper("role"), F.lit(": "), T.cap(F.col("text"), 1200))
    recent = joined_turns(turns.withColumn("line_", line), conversation, order, "line_", "recent_")
    both = summaries.join(recent, conversation, "full")
    head = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Conversation summary:\n"), T.cap(F.col("summary"), 2400)))
    tail = F.when(F.col("recent_").isNotNull(), F.concat(F.lit("Recent turns:\n"), F.col("recent_")))
    return both.select(conversation, T.strip(F.concat_ws("\n\n", head, tail)).alias("context"))


def heuristic_summary(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", last: int = 12) -> DataFrame:
    newest = Window.partitionBy(conversation).orderBy(F.desc(order))
    kept = turns.withColumn("age_", F.row_number().over(newest)).filter(F.col("age_") <= last)
    line = F.concat(F.lit("- "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), T.cap(F.col("text"), 220))
    lines = joined_turns(kept.withColumn("line_", line), conversation, order, "line_", "lines_")
    return lines.select(conversation, T.cap(F.concat(F.lit("Key conversation points:\n"), F.col("lines_")), 1800).alias("summary"))
