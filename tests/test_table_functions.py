"""Table functions in SQL against the DataFrame operators on whole tables."""

import pytest
from pyspark.sql import functions as F

from corvane import plans, registry
from corvane.functions import table_functions as TF
from corvane.operators import chunking as C
from corvane.plans import chunks as P

plans.register()


def test_markdown_chunks_equal_hybrid_chunks(spark, sf_dir):
    columns = ["doc_id", "section_path", "heading", "heading_level", "chunk", "chunk_index", "total_chunks"]
    got = registry.QUERIES["k3_parse_chunks"](spark, sf_dir).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, C.hybrid_chunks(P.headed(spark, sf_dir), "doc_id", size=200, overlap=20).select(columns).collect()))


def test_python_chunks_equal_the_operator(spark, sf_dir):
    got = registry.QUERIES["s8_parse_chunks"](spark, sf_dir)
    want = registry.QUERIES["s8_python_chunks"](spark, sf_dir)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lines_by_partition_and_odd_texts(spark, sf_dir):
    TF.register(spark)
    docs = P.headed(spark, sf_dir).filter("doc_id < 40").unionByName(spark.createDataFrame([(9001, "# a\r\n\n## b \n x\n#### d\n### c\ny\n# \n#x"), (9002, ""), (9003, " \n ")], "doc_id long, text string"))
    docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).createOrReplaceTempView("document_lines")
    columns = ["doc_id", "section_path", "heading", "heading_level", "chunk", "chunk_index", "total_chunks"]
    got = spark.sql("SELECT * FROM parse_lines(TABLE(SELECT doc_id, i, line FROM document_lines) PARTITION BY doc_id ORDER BY i)").select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, C.hybrid_chunks(docs, "doc_id", size=512, overlap=50).select(columns).collect()))
    assert spark.sql("SELECT * FROM parse_chunks(CAST(null AS string))").count() == 0
    with pytest.raises(Exception, match="kind of text"):
        spark.sql("SELECT * FROM parse_chunks('x', 'pdf')").collect()
