"""Unicode normal forms, which Spark has no built-in for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Cf"))


def nfc(c: Column) -> Column:
    """The canonical composition; Latin texts without combining marks pass by unchanged, in the JVM."""
    others = c.rlike("[^\\x00-\\u02ff\\u1e00-\\u20cf\\u2190-\\u2fff]")
    return F.when(others, _nfc(F.when(others, c))).otherwise(c)


def nfkd(c: Column) -> Column:
    """The compatibility decomposition without format characters; ASCII passes by unchanged."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _nfkd(c)).otherwise(c)
