"""JSON out of a model's reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salvage_json(c: Column) -> Column:
    """The reply if it is JSON, else what a code fence holds, else its outermost braces, else an empty object."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull() & F.trim(x).rlike(r"^[\[{]"), x)
    return F.coalesce(valid(c), valid(fenced), valid(braces), F.lit("{}"))
