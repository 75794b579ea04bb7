"""Tables of vectors as whole numbers, for operators whose results must not depend on rounding.

A row is kept if its vector is there and each component is a finite number; a component x becomes
floor(scale * x). The dimension is the length of the first kept vector, by id, then components;
vectors of another length can't be compared with it and are left out as well. Components are held
within +-bound(), so that sums of squares over a vector stay exact; at the usual scale of 1024 and
64 dimensions, that is beyond |x| = 100,000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bound(dimension: int, bits: int) -> int:
    """The largest power of two whose doubled square, taken `dimension` times, has at most so many bits."""
    return 1 << ((bits - max(1, dimension).bit_length()) // 2 - 1)


def fixed(rows: DataFrame, scale: int, bits: int = 62, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """(id, label, v: array of int) of the kept rows, and their dimension; 0 if there is none."""
    x = F.col(vector_col).cast("array<double>")
    whole = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).filter(whole)
    first = kept.orderBy(F.asc_nulls_last("id"), "x").select(F.size("x")).first()
    dimension = first[0] if first else 0
    most = min(bound(dimension, bits), (1 << 30))
    held = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), c * scale))).cast("int"))
    return kept.filter(F.size("x") == dimension).select("id", "label", held.alias("v")), dimension


def matrix(lists, dimension: int):
    """An Arrow array of lists of whole numbers as an int64 matrix."""
    import numpy as np

    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dimension)
