"""The training-data pipeline: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import common, stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("language", stages.drop_unknown_language),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_benchmark_passages),
    ("packing", stages.pack),
]

#: SQL can't express the fitted classifiers or the edit distances; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written as Parquet and read again as the next one's documents."""
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
