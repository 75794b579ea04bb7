"""The engine's two pipelines as functions of tables: ingest documents, answer a batch of queries.

Tables that later stages read again and again are computed once and kept in the shared folder; the rest is
lazily composed and runs when a result is used.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import guard as G
from .functions import text as T
from .functions.unicode import nfc
from .operators import chunking, dedup, graph, search
from .sources.checkpoint import checkpointed


@dataclass(frozen=True)
class Options:
    """What can be set; check() says what doesn't fit together."""

    chunk_size: int = chunking.SIZE
    chunk_overlap: int = chunking.OVERLAP
    least_chars: int = 40
    least_score: float = 0.45
    alpha: float = 0.5
    search_limit: int = 10
    rerank_limit: int = 5
    update: bool = False
    cross_document_dedup: bool = True
    fuzzy_dedup: bool = False
    fuzzy_threshold: float = 0.95
    build_graph: bool = True
    override_sources: list[str] = field(default_factory=list)

    def check(self) -> tuple[list[str], list[str]]:
        """Errors and warnings."""
        errors, warnings = [], []
        if not 0 <= self.alpha <= 1:
            errors.append(f"alpha {self.alpha} is not between 0 and 1")
        if self.chunk_overlap >= self.chunk_size:
            errors.append("chunks overlap by their whole size")
        if min(self.chunk_size, self.search_limit, self.rerank_limit) <= 0:
            errors.append("sizes and limits must be positive")
        if self.fuzzy_dedup and not self.cross_document_dedup:
            errors.append("fuzzy deduplication needs deduplication across documents")
        if self.rerank_limit > self.search_limit:
            warnings.append("more results are asked of the reranker than the search returns")
        if self.override_sources and not self.cross_document_dedup:
            warnings.append("overridden sources have no effect without deduplication")
        return errors, warnings


def checked(options: Options) -> Options:
    errors, _ = options.check()
    if errors:
        raise ValueError("; ".join(errors))
    return options


def ingest(sources: DataFrame, options: Options = Options(), manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """sources (source_key, text) to the tables documents, chunks, merges and, if asked for, entities and edges.

    With update, sources whose content the manifest (source_key, content_hash) has are left out.
    """
    checked(options)
    rows = sources.select("source_key", "text", F.sha2("text", 256).alias("content_hash"))
    if options.update and manifest is not None:
        rows = rows.join(manifest.select("source_key", "content_hash"), ["source_key", "content_hash"], "left_anti")
    documents = rows.select("source_key", "content_hash", T.uuid5(F.concat(F.lit("doc:"), F.col("source_key"))).alias("document_id"), T.metadata_value(F.col("text"), "Title", "Subject").alias("title"), T.clean_document(F.col("text")).alias("text"))
    documents = documents.withColumn("text", nfc(F.col("text")))
    documents = checkpointed(documents)
    chunks = chunking.hybrid_chunks(documents, "source_key", "text", options.chunk_size, options.chunk_overlap)
    chunks = chunks.withColumn("chunk", T.strip_control(F.col("chunk"))).withColumn("quality", T.quality_score(F.col("chunk")))
    chunks = dedup.first_of_each(dedup.accepted(chunks, "chunk", options.least_chars, options.least_score), "source_key", "chunk_index", "chunk")
    chunks = chunks.withColumn("chunk_id", T.chunk_id(F.col("source_key"), F.col("chunk_index"), F.col("chunk")))
    chunks = checkpointed(chunks)
    out = {"documents": documents, "chunks": chunks}
    if options.cross_document_dedup:
        kept = dedup.merge_exact(chunks, "chunk_id", "source_key", "chunk").withColumnRenamed("canonical_id", "chunk_id").select("chunk_id", "content_hash", "source_documents")
        out["merges"] = dedup.merge_events(chunks, "chunk_id", "source_key", "chunk", options.override_sources)
        out["chunks"] = checkpointed(chunks.join(kept, "chunk_id"))
        if options.fuzzy_dedup:
            out["fuzzy"] = dedup.fuzzy_matches(out["chunks"], "chunk_id", "chunk", options.fuzzy_threshold)
    if options.build_graph:
        out |= build_graph(out["chunks"])
    return out


def build_graph(chunks: DataFrame) -> dict[str, DataFrame]:
    """Entities and edges of chunks (chunk_id, source_key, chunk)."""
    seq = F.xxhash64("chunk_id")  # a fixed order of chunks
    rows = chunks.select("chunk_id", F.col("source_key").alias("source"), seq.alias("seq"), F.col("chunk").alias("text"))
    named = rows.select("source", "seq", F.explode(graph.entities(F.col("text"))).alias("name"))
    found = graph.relations(rows, "chunk_id", clean=True).join(rows.select("chunk_id", "source", "seq"), "chunk_id")
    ends = found.select("source", "seq", F.explode(F.array("subject", "object")).alias("name"))
    known = graph.canonical_names(named.unionByName(ends)).withColumn("type", graph.entity_type(F.col("canonical")))
    spelled = known.groupBy(F.lower("name").alias("fold")).agg(F.min("canonical").alias("canonical"))
    to = lambda df, c: df.join(spelled.select(F.col("fold").alias("f_"), F.col("canonical").alias("c_")), F.lower(c) == F.col("f_")).withColumn(c, F.col("c_")).drop("f_", "c_")
    triples = to(to(found, "subject"), "object").withColumn("weight", F.lit(1))
    return {"entities": checkpointed(graph.upsert_entities(known)), "edges": checkpointed(graph.upsert_edges(triples))}


def answer(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, entities: DataFrame | None = None, edges: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """A row per query: action, label, confidence and the ranked sources, for queries (query_id, text).

    Queries that a rail stops are answered without a search. vectors: vec_id (the chunk's id), embedding.
    """
    checked(options)
    t = F.col("text")
    gated = queries.select("query_id", G.query_action(t).alias("q"), G.intent(t).alias("i")).select("query_id", F.col("q.query").alias("text"), "q.action", "i.intent", G.any_match(F.col("q.query"), G.RAIL_INJECTION).alias("injected"))
    decision = F.when(F.col("injected") | (F.col("action") == "ask_user"), "ask_user").when(F.col("intent") != "rag_search", F.concat(F.lit("canned_"), F.col("intent"))).otherwise("search")
    gated = checkpointed(gated.select("query_id", "text", decision.alias("action")))
    asked = gated.filter("action = 'search'").select("query_id", "text")
    if entities is not None and edges is not None:
        matched = graph.match_entities(asked, entities.select(F.col("canonical").alias("name")))
        terms = graph.expand_query(matched, edges, asked).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("terms"))
        searched = checkpointed(asked.join(terms, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "terms").alias("text")))
    else:
        searched = asked
    docs = chunks.select(F.col("chunk_id").alias("id"), F.col("chunk").alias("chunk_text"), "source_key")
    keyword = search.bm25(chunks, searched, "chunk_id", "query_id", "chunk", "text", 50)
    vector = search.dense(vectors, query_vectors.join(asked, "query_id", "left_semi"), k=50)
    hits = search.fuse(search.top(keyword, "bm25", 50).drop("rank"), search.top(vector, "dense", 50).drop("rank"), options.alpha, options.search_limit)
    scored = hits.drop("rank").join(docs, "id").join(asked, "query_id").withColumn("score", F.round(search.sigmoid(search.overlap_logit(F.col("text"), F.col("chunk_text"))), 6))
    ranked = search.top(scored, "score", options.rerank_limit)
    results = ranked.groupBy("query_id").agg(F.max("score").alias("best"), F.sort_array(F.collect_list(F.struct("rank", "id", "source_key", "score"))).alias("sources"))
    return gated.join(results, "query_id", "left").select(
        "query_id", "action", search.quality_label(F.coalesce("best", F.lit(0.0))).alias("label"), F.round(search.retrieval_confidence(F.coalesce(F.transform("sources", lambda s: s["score"]), F.array().cast("array<double>"))), 6).alias("confidence"), "sources"
    )


def after_ingest(nodes: DataFrame, edges: DataFrame, alias: DataFrame, vectors: DataFrame, threshold: float = 0.85, levels: int = 3) -> dict[str, DataFrame]:
    """What follows an ingest, in its order: entities are resolved, then communities found on what is left."""
    nodes, edges, merges = graph.resolve(nodes, edges, alias, vectors, threshold)
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    return {"entities": nodes, "edges": edges, "merges": merges, "communities": graph.community_levels(edges, levels)}
