"""The operators as stages of a pipeline: documents in, documents out, by their decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, edit_match, language_id, odd_sketch, packing, toxicity

#: A document whose language is less probable than this is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _own(docs: DataFrame, name: str) -> str:
    """A column name that docs hasn't."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is the threshold or more."""
    name = _own(docs, "toxicity")
    model = toxicity.fit(docs, common.load(spark, sf_dir, "labels"))
    return toxicity.add_toxicity(docs, model, name=name).filter(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language can't be told."""
    lang = _own(docs, "lang_pred")
    score = _own(docs, "lang_score")
    named = language_id.add_language(docs, language_id.fit(docs), names=(lang, score))
    return named.filter((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).drop(lang, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id. Rows without id stay.

    Where ids repeat, each text of an id is decided on its own: only rows whose text equals one that stays,
    or is linked with it, go. Of an id's own linked texts that with the least digest stays.
    """
    how = odd_sketch.Similarity(words=5, percent=80)
    known = docs.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = common.stage(odd_sketch.near_duplicates(docs, how).select("doc_id", "kept"), "kept")
        kept = docs.join(found.filter("kept and doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    else:
        digest, node, place = _own(docs, "digest"), _own(docs, "node"), _own(docs, "place")
        known = known.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
        texts = known.select("doc_id", digest, "text").dropDuplicates(["doc_id", digest])
        # nodes are in the order of ids: the sort's partitions are in order, and so are the numbers in each
        texts = common.stage(texts.orderBy("doc_id", digest).withColumn(node, F.monotonically_increasing_id()), "texts_of_ids")
        found = odd_sketch.near_duplicates(texts, how, id_col=node).filter("kept").select(F.col("doc_id").alias(node))
        stay = texts.join(found, node, "left_semi").select("doc_id", digest)
        # equal ids and texts are one document: the first of its rows, by all columns
        order = Window.partitionBy("doc_id", digest).orderBy(F.to_json(F.struct(*docs.columns)))
        first = known.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
        kept = first.join(stay, ["doc_id", digest], "left_semi").select(docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item."""
    return edit_match.without_items(docs, common.load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
