"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Each assistant turn becomes an example: all turns before it as context, and only its text under the
loss mask. A conversation that doesn't end with the assistant has one more example, with all its
turns and an empty mask, so that the examples hold every turn.

A turn is written as `### role`, a line feed, the text, and `</turn>` with a line feed. In roles and
texts a backslash, `<` and `#` become `\\b`, `\\l` and `\\h` (in roles a line feed becomes `\\n`), so that
no text can hold a mark, and reading back is exact.

A conversation is one row while it is formatted: an example holds its whole context by definition,
so the longest conversation must fit into memory, and its examples grow with the square of its turns.

Defined results: a null text or role is empty. Turns are ordered by number, then role, then text, so
that repeated rows and ties stay and have a fixed order; a null number comes first. Rows without
conversation id form a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the template.
OPEN, CLOSE = "### ", "</turn>\n"
CODES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_CODES = [*CODES, ("\n", "\\n")]


def escape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in reversed(codes):  # the backslash last
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", reply: str = "assistant") -> DataFrame:
    """A row per example: conv_id, example (from 0), text, loss_start and loss_chars (code points), whole.

    `whole` marks the example that holds all turns of its conversation.
    """
    rows = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    talks = talks.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_CODES), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("turns", lambda t: t["role"] == reply).alias("replies"),
    )
    n = F.size("bodies")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("replies", i) | (i == n - 1))
    spread = talks.select("*", F.posexplode(targets).alias("example", "at"))
    before = F.array_join(F.slice(F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))), F.lit(1), F.col("at")), "")
    head, body = F.get("heads", F.col("at")), F.get("bodies", F.col("at"))
    trained = F.get("replies", F.col("at"))
    return spread.select("conv_id", "example", "at", before.alias("context"), head.alias("head"), body.alias("body"), trained.alias("trained"), (F.col("at") == n - 1).alias("whole")).select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.concat("context", "head", "body", F.lit(CLOSE)).alias("text"),
        (F.length("context") + F.length("head")).cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).cast("long").alias("loss_chars"),
        "whole",
    )


def read_turns(text: Column) -> Column:
    """An array of (role, text) of the turns of an example's text."""
    parts = F.split(text, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)  # what follows the last mark is empty
    cut = lambda p: F.locate("\n", p)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1), ROLE_CODES).alias("role"),
            unescape(F.substring(p, cut(p) + 1, F.length(p))).alias("text"),
        ),
    )


def read_loss(text: Column, start: Column, chars: Column) -> Column:
    """The text under the mask, unescaped."""
    return unescape(F.substring(text, (start + 1).cast("int"), chars.cast("int")))


def digests(examples: DataFrame) -> DataFrame:
    """A row per conversation, of what its examples read back."""
    turns = read_turns(F.col("text"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        "example",
        F.when(F.col("whole"), F.size(turns)).cast("long").alias("n_turns"),
        F.when(F.col("whole"), F.sha2(said, 256)).alias("turns_sha256"),
        read_loss(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    together = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return together.select("conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts look like the template's marks.
LOOKALIKE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(LOOKALIKE).alias("text")
    )
    return digests(prefix_examples(turns.unionByName(extra)))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         4 + 1 + 8 + length(role) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^\\<#\n]', '', 'g')) AS chars
  FROM turns
), run AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM run GROUP BY conv_id
"""
