"""Sketch tables against exact counts."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import sketches as K

SCHEMA = "source string, day int, user string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    made = [(rng.choice("aab"), rng.randrange(6), f"u{rng.randrange(30_000)}") for _ in range(60_000)]
    return spark.createDataFrame([*made, ("c", 1, None), (None, 2, "u1")], SCHEMA).cache()


def test_merged_sketches_equal_direct_ones_and_keep_their_error(rows):
    stored = K.sketch_table(rows, ["source", "day"], ["user"])
    rolled = {r.source: r for r in K.estimates(K.merged(stored, ["source"])).collect()}
    direct = {r.source: r for r in K.estimates(K.sketch_table(rows, ["source"], ["user"])).collect()}
    exact = {r.source: (r.n, r.users) for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("user").alias("users")).collect()}
    assert set(rolled) == {"a", "b", "c", None}
    for source, (n, users) in exact.items():
        assert rolled[source].n == n
        for r in (rolled[source], direct[source]):  # five standard errors
            assert abs(r.user_distinct - users) <= 5 * 1.04 / 64 * users and abs(r.user_theta - users) <= 5 / 64 * users
        assert abs(rolled[source].user_theta - direct[source].user_theta) <= 2


def test_small_sets_are_exact_and_can_be_subtracted(spark):
    rows = spark.createDataFrame([("a", d, f"u{u}") for d in range(4) for u in range(100 * d, 100 * d + 150)] + [("b", 0, "x"), ("c", 3, "y"), ("c", 3, None)], SCHEMA)
    stored = K.sketch_table(rows, ["source", "day"], ["user"])
    early, late = (K.merged(stored.filter(c), ["source"]) for c in ("day <= 1", "day >= 2"))
    got = {tuple(r) for r in K.compared(early, late, ["source"], "user").collect()}
    assert got == {("a", 200, 50, 200, 450), ("b", 1, 0, 0, 1), ("c", 0, 0, 1, 1)}


def test_appended_parts_and_nothing(rows):
    parts = K.sketch_table(rows.filter("day < 3"), ["source"], ["user"]).unionByName(K.sketch_table(rows.filter("day >= 3"), ["source"], ["user"]))
    whole = K.sketch_table(rows, ["source"], ["user"])
    count = lambda t: {r.source: (r.n, r.user_theta) for r in K.estimates(K.merged(t, ["source"])).collect()}
    assert {k: v[0] for k, v in count(parts).items()} == {k: v[0] for k, v in count(whole).items()}
    assert count(parts.filter("false")) == {}


def test_tables_in_pieces_are_exact_beyond_a_sketch(rows):
    """Nearly 30,000 users, more than a sketch of 4096 holds."""
    stored = K.exact_table(rows, ["source", "day"], "user")
    got = {tuple(r) for r in K.exact_counts(stored, ["source"], "user").collect()}
    assert got == {tuple(r) for r in rows.groupBy("source").agg(F.count("*"), F.countDistinct("user")).collect()} and max(r[2] for r in got) > 4 * 4096
    got = {tuple(r) for r in K.exact_compared(stored.filter("day < 2"), stored.filter("day > 2"), ["source"], "user").filter("source is not null").collect()}
    users = {(s, late): {r.user for r in rows.filter(F.col("source") == s).filter("day > 2" if late else "day < 2").collect()} - {None} for s in "abc" for late in (False, True)}
    want = {(s, len(a - b), len(a & b), len(b - a), len(a | b)) for s in "ab" for a, b in [(users[s, False], users[s, True])]}
    assert got == want | {("c", 0, 0, 0, 0)}


def test_pieces_that_are_too_full_fail(spark):
    small = K.exact_table(spark.range(10).selectExpr("'a' AS source", "id AS user"), ["source"], "user")
    more = K.exact_table(spark.range(20_000).selectExpr("'a' AS source", "id AS user"), ["source"], "user").withColumn("piece", F.lit(0))
    with pytest.raises(Exception, match="more pieces"):
        K.exact_counts(small.unionByName(more), ["source"], "user").collect()


def test_registered_roll_ups_of_many_users_equal_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    events = spark.range(40_000).selectExpr("id AS event_id", "cast(timestamp_seconds(1704067200 + id * 7919 % 2592000) AS timestamp_ntz) AS ts", "id * 31 % 17000 AS user_id", "concat('t', id % 2) AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("a2_sketch_rollup", "a2_sketch_difference"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = connection.sql(entry.oracle_sql()[name])
        assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
