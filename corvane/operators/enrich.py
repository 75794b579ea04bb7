"""Enrichment of documents and chunks: rows in, rows out."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import slices
from ..sources.checkpoint import checkpointed


def keywords(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The most frequent keywords of each text; of equal counts that seen first comes first.

    A text's words are counted where it is. Only rows of an id that other rows have too meet in a shuffle, by (id, word).
    """
    every = F.regexp_extract_all(F.lower(text_col), F.lit("(?U)" + T.KEYWORD), F.lit(0))
    repeated = checkpointed(docs.groupBy(F.col(id_col).alias("id_")).agg(F.count("*").alias("n")).filter("n > 1").select("id_"), "repeated")
    same = F.col(id_col).eqNullSafe(F.col("id_"))

    def count(batches):
        import pyarrow as pa

        for batch in slices(batches, "words"):
            owners, words, counts, ranks = [], [], [], []
            for i, text in enumerate(batch.column("words").to_pylist()):
                if text:  # a count keeps the order of first places, and so does the sort among equal numbers
                    for rank, (word, n) in enumerate(sorted(Counter(text.split("\n")).items(), key=lambda x: -x[1])[:most], 1):
                        owners.append(i)
                        words.append(word)
                        counts.append(n)
                        ranks.append(rank)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owners, pa.int64())), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(ranks, pa.int64())], [id_col, "keyword", "n", "rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    once = docs.join(repeated, same, "left_anti").select(F.col(id_col).alias("id"), F.array_join(every, "\n").alias("words"))
    once = once.mapInArrow(count, f"{id_col} {kind}, keyword string, n long, rank long")
    found = docs.join(repeated, same, "left_semi").select(id_col, F.posexplode(every).alias("place", "keyword"))
    counted = found.groupBy(id_col, "keyword").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first")).cast("long"))
    return once.unionByName(ranked.filter(F.col("rank") <= most).select(id_col, "keyword", "n", "rank"))


def cross_references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every reference, repeats kept."""
    found = lambda pattern: F.regexp_extract_all(F.col(text_col), F.lit("(?Ui)" + pattern), F.lit(0))
    refs = [F.arrays_zip(F.array_repeat(F.lit(kind), F.size(found(p)).cast("int")).alias("ref_type"), found(p).alias("value")) for kind, p in T.CROSS_REFERENCES]
    return docs.select(id_col, F.inline(F.concat(*refs)))
