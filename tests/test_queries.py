"""Registered queries against their SQL on the smallest tables, and the contract's shape."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corvane import registry

#: A few of each area; the driver compares them all.
CHECKED = [
    "hybrid_search", "v9_rerank", "v12_fallback_retrieval", "a11_citation_coverage", "c1_strip_boilerplate", "c3_clean_whitespace", "c5_strip_trailing_short_lines", "c10_metadata",
    "k2_sections", "k5_sentences", "d2_within_document", "d3_merge_exact", "d9_merge_events", "d17_chunk_ids", "g1_entities", "g15_upsert_entities", "g16_edges_digraph", "g22_typed_neighbours",
    "g28_query_expansion", "r6_redacted", "r14_merge_gate", "q3_backward_reference", "m4_recent_turns", "m5_context_text", "a13_nearest_rank", "w11_hot_streaks", "l2_orphans", "l6_migration_plan",
    "j6_priority_match", "j17_supplementary_spans",
]


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") and not isinstance(v, (str, bytes)) else v
        return None if v is None or v is pd.NaT or v is pd.NA or v != v else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), connection.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 200


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]


def test_partitions_do_not_change_results(spark, sf_dir):
    """The same rows with another number of shuffle partitions."""
    for name in ("hybrid_search", "g16_edges_digraph", "a10_retrieval_confidence"):
        first = rows(registry.QUERIES[name](spark, sf_dir).toPandas())
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        try:
            assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == first
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
