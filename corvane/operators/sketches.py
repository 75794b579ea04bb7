"""Tables of sketches: counts of distinct values that are stored once and rolled up, compared and subtracted later.

A row of a sketch table stands for one combination of its groups (a source and a day, say) and holds a HyperLogLog and
a theta sketch of the distinct values of each column asked for. Sketches of any rows merge to that of their union,
so any coarser roll-up comes from the table alone, and new rows are sketched by themselves and appended.
Counts of a HyperLogLog sketch are off by some 1.04 / sqrt(2 ** precision) of the count (a standard error), those of a theta
sketch by 1 / sqrt(2 ** precision) of the union that it was taken from; theta sketches up to 2 ** precision values are exact.
A group's values are only hashed into its sketch, in each task first: no group is gathered.

With pieces, a value's hash decides in which of a group's rows it is sketched (exact_table() takes as many as all distinct values
need, a quarter of 2 ** precision in each). Then no union of any rows of a piece is beyond what a theta sketch holds exactly, and
exact_counts() and exact_compared() add the pieces up to exact counts; rows appended since that overfill a piece make them fail
rather than return an estimate.

Nulls count as no value. A group without values counts 0; a group that only one side has is compared with an empty set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 12


def sketch_table(rows: DataFrame, groups: list[str], values: list[str], precision: int = PRECISION) -> DataFrame:
    """groups, n, and of each value column its sketches, <column>_hll and <column>_theta."""
    made = [s for v in values for s in (F.hll_sketch_agg(v, precision).alias(f"{v}_hll"), F.theta_sketch_agg(v, precision).alias(f"{v}_theta"))]
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), *made)


def exact_table(rows: DataFrame, groups: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """groups, piece, n and <value>_theta: a table of one value column that rolls up and subtracts exactly."""
    distinct = rows.agg(F.approx_count_distinct(value)).first()[0]
    pieces = max(1, -(-4 * distinct // 2**precision))
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64(value, F.lit("piece")), F.lit(pieces)).cast("int"))
    return dealt.groupBy(*groups, "piece").agg(F.count("*").alias("n"), F.theta_sketch_agg(value, precision).alias(f"{value}_theta"))


def _summed(counts: DataFrame, groups: list[str], columns: list[str], precision: int) -> DataFrame:
    """Counts of pieces added up, unless one is beyond what a sketch holds exactly."""
    full = F.raise_error(F.lit(f"a piece holds more than {2**precision} values: make the table anew with more pieces")).cast("long")
    exact = [F.sum(F.when(F.col(c) <= 2**precision, F.col(c)).otherwise(full)).alias(c) for c in columns]
    return counts.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in counts.columns if c == "n"], *exact)


def exact_counts(table: DataFrame, groups: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """groups, n, <value>_distinct of a table of exact_table(), of its groups or of coarser ones."""
    counts = merged(table, [*groups, "piece"], precision).withColumn(f"{value}_distinct", F.theta_sketch_estimate(f"{value}_theta"))
    return _summed(counts, groups, [f"{value}_distinct"], precision)


def exact_compared(first: DataFrame, second: DataFrame, groups: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """compared() of two parts of one exact_table(), of its groups or of coarser ones."""
    sides = [merged(t, [*groups, "piece"], precision) for t in (first, second)]
    return _summed(compared(*sides, [*groups, "piece"], value, precision), groups, ["only_first", "both", "only_second", "either"], precision)


def _names(table: DataFrame, ending: str) -> list[str]:
    return [c.removesuffix(ending) for c in table.columns if c.endswith(ending)]


def merged(table: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """The sketch table of coarser groups, from that of finer ones (or of parts that were sketched at different times)."""
    hll = [F.hll_union_agg(f"{v}_hll").alias(f"{v}_hll") for v in _names(table, "_hll")]
    theta = [F.theta_union_agg(f"{v}_theta", precision).alias(f"{v}_theta") for v in _names(table, "_theta")]
    return table.groupBy(*groups).agg(F.sum("n").alias("n"), *hll, *theta)


def estimates(table: DataFrame) -> DataFrame:
    """Sketches replaced by counts: <column>_distinct by HyperLogLog, <column>_theta by theta."""
    kept = [c for c in table.columns if not c.endswith(("_hll", "_theta"))]
    counts = [F.hll_sketch_estimate(f"{v}_hll").alias(f"{v}_distinct") for v in _names(table, "_hll")]
    return table.select(*kept, *counts, *[F.theta_sketch_estimate(f"{v}_theta").alias(f"{v}_theta") for v in _names(table, "_theta")])


def compared(first: DataFrame, second: DataFrame, groups: list[str], value: str, precision: int = PRECISION) -> DataFrame:
    """groups, only_first, both, only_second, either: how many values two sketch tables of the same groups share."""
    a, b = (t.select(*groups, F.col(f"{value}_theta").alias(name)) for t, name in ((first, "a"), (second, "b")))
    nothing = first.sparkSession.range(0).agg(F.theta_sketch_agg("id", precision).alias("nothing"))
    sides = a.join(b, groups, "full").crossJoin(F.broadcast(nothing))  # one row
    a, b = F.coalesce("a", "nothing"), F.coalesce("b", "nothing")
    count = F.theta_sketch_estimate
    return sides.select(*groups, count(F.theta_difference(a, b)).alias("only_first"), count(F.theta_intersection(a, b)).alias("both"), count(F.theta_difference(b, a)).alias("only_second"), count(F.theta_union(a, b, precision)).alias("either"))
