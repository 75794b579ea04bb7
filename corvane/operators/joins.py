"""Joins that need more than equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_overlaps(rows: DataFrame, others: DataFrame, key: str, start: str, end: str, cell: int = 64) -> DataFrame:
    """Rows whose span [start, end) meets no span of the same key in others.

    Spans are put into the cells of a grid that they touch, so that the join is on (key, cell) and a
    key with many spans spreads over its cells; then rows that met one are taken out.
    """
    cells = lambda df: df.withColumn("cell_", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    o = cells(others.select(key, F.col(start).alias(start), F.col(end).alias(end)).distinct()).select(F.col(key).alias("k_"), F.col(start).alias("s_"), F.col(end).alias("e_"), "cell_")
    spans = rows.select(key, start, end).distinct()
    a = cells(spans).withColumnRenamed("cell_", "c_")
    met = a.join(o, (a[key] == o["k_"]) & (a["c_"] == o["cell_"]) & (a[start] < o["e_"]) & (a[end] > o["s_"]), "left_semi").select(key, start, end).distinct()
    return rows.join(met, [key, start, end], "left_anti").select(rows.columns)


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joined by sorting both sides, whatever their size: in steps that repeat, broadcasts of small tables add up in the driver."""
    return left.join(right.hint("merge"), on, how)
