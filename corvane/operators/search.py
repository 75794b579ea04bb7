"""Keyword, vector and hybrid search over a batch of queries, ranking, and confidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import slices
from ..sources.checkpoint import checkpointed

K1, B = 1.2, 0.75
#: Tokens are runs of these, in lower case; the class is the same in every regular-expression dialect.
NOT_TOKEN = "[^0-9a-zà-öø-ÿß]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TOKEN), lambda t: t != "")


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, term, tf): the term index."""
    return docs.select(F.col(key).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


# ---------------------------------------------------------------- scoring by blocks of queries


#: Queries in a block. A block is broadcast and scored against each row in one pass.
QUERY_BLOCK = 4096
#: Inner products that a task holds at a time beside the scores of a slice of rows.
PRODUCTS = 1 << 20


def token_lists(texts):
    """tokens() of an Arrow array of texts: all tokens, which may be empty, and their number by text."""
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_TOKEN)
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def query_blocks(queries: DataFrame, key: str, size: int) -> Iterator:
    """Arrow tables of at most about `size` rows each; which rows are in one depends on their keys alone."""
    count = max(1, -(-queries.count() // size))
    for k in range(count):
        block = queries.filter(F.pmod(F.xxhash64(key), F.lit(count)) == k) if count > 1 else queries
        yield block.toArrow().sort_by(key).combine_chunks()


class Best:
    """The k best ids of each query among the scores given so far; all of them if k is none."""

    def __init__(self, k: int | None):
        self.k, self.held, self.room = k, [], 1 << 16

    def add(self, ids, scores: np.ndarray, found: np.ndarray):
        """scores and whether a pair was found, by row of ids and query. Yields tables when there is nothing to wait for."""
        import pyarrow as pa

        if self.k and len(scores) > self.k:  # no more than these of a batch, but for ties
            least = np.partition(scores, len(scores) - self.k, axis=0)[-self.k]
            found = found & (scores >= least)
        rows, queries = np.nonzero(found)
        self.held.append(pa.table({"q": pa.array(queries), "id": ids.take(pa.array(rows)), "score": pa.array(scores[rows, queries])}))
        if not self.k:
            yield self.held.pop()
        elif sum(map(len, self.held)) > self.room:
            self.held = [self.cut()]
            self.room = max(self.room, 2 * len(self.held[0]))

    def cut(self):
        import pyarrow as pa

        table = pa.concat_tables(self.held).combine_chunks().sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q = table.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return table.filter(pa.array(place < self.k))

    def rest(self):
        if self.held:
            yield self.cut()


def _scored(rows: DataFrame, id_type: str, query_type: str, held, k: int | None, column: str, name: str, score) -> DataFrame:
    """(query_id, id, name): score(batch, held value) gives a matrix of rounded scores and one of pairs found."""

    def run(batches):
        best = Best(k)
        keys = held.value["keys"]

        def out(table):
            for batch in table.append_column("query_id", keys.take(table.column("q"))).select(["query_id", "id", "score"]).rename_columns(["query_id", "id", name]).combine_chunks().to_batches(max_chunksize=1 << 16):
                yield batch

        for batch in slices(batches, column):
            for table in best.add(batch.column("id"), *score(batch, held.value)):
                yield from out(table)
        for table in best.rest():
            yield from out(table)

    return rows.mapInArrow(run, f"query_id {query_type}, id {id_type}, {name} double")


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query_key: str = "item_id", text: str = "text", query_text: str = "text", k: int | None = None) -> DataFrame:
    """(query_id, id, bm25) of the documents that hold a term of the query, each query term once; bm25 has six decimals.

    Texts are taken apart once for a block of queries: of each document its length and the counts of
    the terms that a query has are kept, from which document frequencies come. As a block's terms and
    queries are at hand everywhere, a document is scored for all of them where it is, without a shuffle;
    with k, a task gives the k best of each query alone, from which top() takes the best of all.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark, kinds = docs.sparkSession, dict(docs.dtypes) | {f"query {c}": t for c, t in queries.dtypes}
    rows, asked = docs.select(F.col(key).alias("id"), F.col(text).alias("text")), queries.select(F.col(query_key).alias("query_id"), F.col(query_text).alias("text"))
    parts = []
    for block in query_blocks(asked, "query_id", QUERY_BLOCK):
        flat, sizes = token_lists(block.column("text").combine_chunks() if block.num_rows else pa.array([], pa.string()))
        pairs = pa.table({"q": np.repeat(np.arange(len(sizes)), sizes), "term": flat}).filter(pc.not_equal(flat, "")).group_by(["q", "term"]).aggregate([])
        terms = pc.unique(pairs.column("term").combine_chunks()).sort()
        wanted = spark.sparkContext.broadcast(terms)

        def count(batches, wanted=wanted):
            import pyarrow as pa
            import pyarrow.compute as pc

            vocabulary = wanted.value
            for batch in slices(batches, "text"):
                flat, sizes = token_lists(batch.column("text"))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                length = np.bincount(owner, pc.not_equal(flat, "").to_numpy(zero_copy_only=False), len(sizes)).astype(np.int64)
                at = pc.index_in(flat, value_set=vocabulary)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                pair = owner[known] * max(len(vocabulary), 1) + at.drop_null().to_numpy()
                pair, times = np.unique(pair, return_counts=True)
                heads = np.searchsorted(pair, np.arange(len(sizes) + 1) * max(len(vocabulary), 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(heads), pa.array(v.astype(np.int32))) for v in (pair % max(len(vocabulary), 1), times)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(length), *lists], ["id", "dl", "terms", "tf"])

        postings = checkpointed(rows.mapInArrow(count, f"id {kinds[key]}, dl long, terms array<int>, tf array<int>"), "postings")
        n, mean = postings.agg(F.count("*"), F.avg("dl")).first()
        frequency = np.zeros(len(terms))
        found = postings.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # a row a term of the block
        frequency[found.column("t").to_numpy()] = found.column("count").to_numpy()
        place = pc.index_in(pairs.column("term").combine_chunks(), value_set=terms).to_numpy()
        order = np.argsort(place, kind="stable")
        held = spark.sparkContext.broadcast({
            "keys": block.column("query_id").combine_chunks(), "idf": np.log(1 + (n - frequency + 0.5) / (frequency + 0.5)), "mean": mean or 1.0,
            "heads": np.searchsorted(place[order], np.arange(len(terms) + 1)), "queries": pairs.column("q").to_numpy()[order],
        })

        def score(batch, model):
            size, dl = len(model["keys"]), batch.column("dl").to_numpy()
            terms, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
            owner = np.repeat(np.arange(len(dl)), np.diff(batch.column("terms").offsets.to_numpy()))
            part = model["idf"][terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[owner] / model["mean"]))
            starts, each = model["heads"][terms], np.diff(model["heads"])[terms]
            ends = np.cumsum(each)
            query = model["queries"][np.repeat(starts - ends + each, each) + np.arange(each.sum())]
            total = np.bincount(np.repeat(owner, each) * size + query, np.repeat(part, each), len(dl) * size).reshape(len(dl), size)
            return np.round(total, 6), total > 0

        parts.append(_scored(postings, kinds[key], kinds[f"query {query_key}"], held, k, "terms", "bm25", score))
    return _united(parts)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def binary_round(x: Column, places: int) -> Column:
    """A double rounded half away from zero on its binary value, as C and SQL engines in C do; Spark's round() takes the decimal digits that it prints.

    The two differ next to a half, and a small negative number becomes -0.0 here.
    """
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled).cast("double")
    near = F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / 10.0**places
    return F.when(F.isnan(x) | (scaled >= 2.0**52), x).otherwise(near)  # from there on there are no fractions


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def dense(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", k: int | None = None) -> DataFrame:
    """(query_id, id, dense): exact cosine, to six decimals, of each query vector of a block with each vector.

    Both sides are brought to length 1 once; a zero vector has cosine 0. With k, a task gives the k best
    of each query alone, from which top() takes the best of all. Rows without a vector have no score.
    """
    kinds = dict(vectors.dtypes) | {f"query {c}": t for c, t in queries.dtypes}
    rows = vectors.select(F.col(key).alias("id"), doubles(F.col(vector)).alias("v")).filter("v is not null")
    asked = queries.select(F.col(query_key).alias("query_id"), doubles(F.col(vector)).alias("v")).filter("v is not null")

    def unit(lists):
        m = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)

    def score(batch, model):
        cosine = np.round(unit(batch.column("v")) @ model["units"].T, 6) + 0.0
        return cosine, np.ones(cosine.shape, bool)

    parts = []
    for block in query_blocks(asked, "query_id", QUERY_BLOCK):
        if block.num_rows:
            held = vectors.sparkSession.sparkContext.broadcast({"keys": block.column("query_id").combine_chunks(), "units": unit(block.column("v").combine_chunks())})
            parts.append(_scored(rows, kinds[key], kinds[f"query {query_key}"], held, k, "v", "dense", score))
    return _united(parts) if parts else rows.crossJoin(asked.select("query_id").limit(0)).select("query_id", "id", F.lit(0.0).alias("dense"))


def top(hits: DataFrame, score: str, k: int, group: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best of each group with their rank from 1. Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def minmax(hits: DataFrame, score: str, name: str, group: str = "query_id") -> DataFrame:
    """Scores scaled to 0..1 within each group; 1 where all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(name, F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def fuse(keyword: DataFrame, vector: DataFrame, alpha: float, k: int) -> DataFrame:
    """Relative score fusion of two hit lists, a missing side counting 0."""
    a = minmax(keyword, "bm25", "kw").select("query_id", "id", "kw")
    b = minmax(vector, "dense", "vec").select("query_id", "id", "vec")
    both = a.join(b, ["query_id", "id"], "full")
    score = alpha * F.coalesce("vec", F.lit(0.0)) + (1 - alpha) * F.coalesce("kw", F.lit(0.0))
    return top(both.select("query_id", "id", F.round(score, 6).alias("score")), "score", k)


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, alpha: float = 0.5, limit: int = 10, candidates: int = 50) -> DataFrame:
    """(query_id, id, score, rank): BM25 and cosine candidates fused."""
    keyword, vector = bm25(docs, queries, k=candidates), dense(vectors, query_vectors, k=candidates)
    return fuse(top(keyword, "bm25", candidates).drop("rank"), top(vector, "dense", candidates).drop("rank"), alpha, limit)


# ---------------------------------------------------------------- filters


OPERATORS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")),
}


def where(rows: DataFrame, filters: list[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet all filters (column, operator, value). They reach the scan as pushed filters."""
    for column, operator, value in filters:
        if operator.lower() not in OPERATORS:
            raise ValueError(f"unknown operator {operator!r}")
        rows = rows.filter(OPERATORS[operator.lower()](F.col(column), value))
    return rows


def parse_filters(text: str) -> tuple[str, dict[str, str]]:
    """`source:"a b" section:x rest` as the rest and the named values."""
    import re

    found: dict[str, str] = {}

    def take(m):
        found[m[1].lower()] = m[2] if m[2] is not None else m[3]
        return " "

    rest = re.sub(r'\b(source|section):(?:"([^"]*)"|(\S+))', take, text, flags=re.I)
    return " ".join(rest.split()), found


def filter_parts(text: Column) -> Column:
    """parse_filters as a column: a struct of rest, source and section; of several values of a name the last counts."""
    pattern = lambda names: rf'(?i)\b(?:{names}):(?:"[^"]*"|\S+)'

    def value(name: str) -> Column:
        last = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern(name)), F.lit(0)), F.lit(-1))
        plain = last.substr(F.lit(len(name) + 2), F.length(last))
        return F.when(plain.rlike('^"[^"]*"$'), F.regexp_replace(plain, '"', "")).otherwise(plain).alias(name)

    return F.struct(T.strip(T.collapse(F.regexp_replace(text, pattern("source|section"), " "))).alias("rest"), value("source"), value("section"))


def search(docs: DataFrame, queries: DataFrame, source: str | None = None, tenant: str | None = None, **options) -> DataFrame:
    """hybrid_search over documents of one source or tenant, if given; the default tenant is no filter."""
    filters = [("source", "eq", source)] if source else []
    filters += [("tenant_id", "eq", tenant)] if tenant and tenant != "default" else []
    return hybrid_search(where(docs, filters), queries=queries, **options)


# ---------------------------------------------------------------- ranking and quality


def overlap_logit(query: Column, text: Column) -> Column:
    """The offline reranker: how many of the query's words the text holds, as a logit."""
    q, t = F.array_distinct(tokens(query)), tokens(text)
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)
    return 6 * share - 3


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def quality_label(best: Column) -> Column:
    return F.when(best >= 0.75, "strong").when(best >= 0.5, "moderate").when(best >= 0.3, "weak").otherwise("insufficient")


def better_of(first: DataFrame, second: DataFrame, score: str = "score", group: str = "query_id") -> DataFrame:
    """Of two hit lists, by query: the second only where the first is weak and the second's best is strictly better."""
    best = lambda df, name: df.groupBy(group).agg(F.max(score).alias(name))
    both = best(first, "a").join(best(second, "b"), group, "full")
    use = both.select(group, ((F.coalesce("a", F.lit(0.0)) < 0.5) & (F.col("b") > F.coalesce("a", F.lit(-1.0)))).alias("use_second")).withColumn("use_second", F.coalesce("use_second", F.lit(False)))
    pick = lambda df, name, wanted: df.join(use, group).filter(F.col("use_second") == wanted).drop("use_second").withColumn("attempt", F.lit(name))
    return pick(first, "first", False).unionByName(pick(second, "fallback", True))


def retrieval_confidence(scores: Column, n: int = 3) -> Column:
    best = F.slice(F.sort_array(scores, asc=False), 1, n)
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)
    return F.when(F.size(scores) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))


#: What a model's own words about its confidence count.
STATED = [("high", 0.85), ("medium", 0.55), ("low", 0.25)]


def stated_confidence(text: Column) -> Column:
    t = T.strip(F.lower(text))
    out = F.when(F.coalesce(text, F.lit("")) == "", 0.5)
    out = reduce(lambda c, kv: c.when(t == kv[0], kv[1]), STATED, out)
    return reduce(lambda c, kv: c.when(t.contains(kv[0]), kv[1]), STATED, out).otherwise(0.5)


def substantive(answer: Column) -> Column:
    """Sentences of four words or more."""
    return F.filter(F.transform(F.split(T.strip(answer), r"(?U)(?<=[.!?])\s+"), T.strip), lambda s: F.size(T.words(s)) >= 4)


def ngrams(words: Column, n: int) -> Column:
    return T.let(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))))


def citation_coverage(answer: Column, retrieved: Column, n: int = 5) -> Column:
    """0.7 * the share of sentences that cite a retrieved text + 0.3 * the share that repeats n words of one."""
    parts, known = substantive(answer), ngrams(T.words(F.lower(F.array_join(retrieved, " "))), n)
    cites = lambda s: F.exists(F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda c: c.cast("int").between(1, F.size(retrieved)))
    cited = F.size(F.filter(parts, cites))
    grounded = T.let(known, lambda k: F.size(F.filter(parts, lambda s: F.arrays_overlap(ngrams(T.words(F.lower(s)), n), k))))
    return F.when(F.size(parts) == 0, 1.0).otherwise(0.7 * cited / F.size(parts) + 0.3 * grounded / F.size(parts))


def composite(retrieval: Column, stated: Column, citation: Column, weights: tuple[float, float, float] = (0.5, 0.25, 0.25)) -> Column:
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError(f"the weights sum to {sum(weights)}, not 1")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), weights[0] * retrieval + weights[1] * stated + weights[2] * citation))


def confidence_route(score: Column, retries: Column, most: int = 1) -> Column:
    return F.when(F.isnan(score), "block").when(score >= 0.7, "return").when(retries < most, "re_retrieve").when(score >= 0.5, "flag").otherwise("block")


def mean_pool(patches: Column, size: int) -> Column:
    """The mean of an array of vectors."""
    total = F.aggregate(patches, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, doubles(v), lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(patches))


def late_interaction(query: Column, patches: Column) -> Column:
    """MaxSim: for each query vector its best patch, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(patches, lambda p: dot(q, p)))), F.lit(0.0), lambda s, x: s + x)


def late_interaction_search(rows: DataFrame, queries: DataFrame, key: str = "vec_id", query_key: str = "query_id", patches: str = "patches", k: int | None = None) -> DataFrame:
    """(query_id, id, maxsim), to six decimals, of each query of a block and each row; with k as in dense().

    Each row has an array of one or more vectors; rows without any have no score.
    """
    kinds = dict(rows.dtypes) | {f"query {c}": t for c, t in queries.dtypes}
    flat = lambda df, k, name: df.select(F.col(k).alias(name), F.size(patches).alias("n"), F.flatten(F.transform(patches, doubles)).alias("v")).filter("n > 0")

    def vectors(table):
        n = table.column("n").to_numpy()
        values = table.column("v")
        values = values.combine_chunks() if hasattr(values, "combine_chunks") else values
        return values.flatten().to_numpy(zero_copy_only=False).reshape(int(n.sum()), -1), np.cumsum(n) - n

    def score(batch, model):
        v, heads = vectors(batch)
        ends, asked = np.append(heads[1:], len(v)), model["vectors"].T
        total, most, at = np.empty((len(heads), len(model["heads"]))), max(1, PRODUCTS // asked.shape[1]), 0
        while at < len(heads):  # whole rows of no more than `most` patches, or one longer row
            to = max(at + 1, int(np.searchsorted(ends, heads[at] + most, "right")))
            if ends[to - 1] - heads[at] <= most:
                products, each = v[heads[at] : ends[to - 1]] @ asked, ends[at] - heads[at]
                # of each query vector the best patch; rows of one length are cut evenly, which is several times as fast
                best = products.reshape(to - at, each, -1).max(axis=1) if (ends[at:to] - heads[at:to] == each).all() else np.maximum.reduceat(products, heads[at:to] - heads[at], axis=0)
            else:
                best = np.maximum.reduce([(v[i : min(i + most, ends[at])] @ asked).max(axis=0) for i in range(heads[at], ends[at], most)])[None]
            total[at:to] = np.round(np.add.reduceat(best, model["heads"], axis=1), 6) + 0.0
            at = to
        return total, np.ones(total.shape, bool)

    parts = []
    for block in query_blocks(flat(queries, query_key, "query_id"), "query_id", QUERY_BLOCK):
        if block.num_rows:
            v, heads = vectors(block)
            held = rows.sparkSession.sparkContext.broadcast({"keys": block.column("query_id").combine_chunks(), "vectors": v, "heads": heads})
            parts.append(_scored(flat(rows, key, "id"), kinds[key], kinds[f"query {query_key}"], held, k, "v", "maxsim", score))
    return _united(parts) if parts else flat(rows, key, "id").crossJoin(flat(queries, query_key, "query_id").select("query_id").limit(0)).select("query_id", "id", F.lit(0.0).alias("maxsim"))


def known_terms(queries: DataFrame, terms: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, term, rank): the terms (name, mention_count) that share a word of three letters or more with the query.

    The most mentioned come first, then by name. A query with such words but without a hit gets the most
    mentioned terms of all; one without such words gets none.
    """
    long = lambda c: F.array_distinct(F.filter(T.words(F.lower(c)), lambda w: F.length(w) >= 3))
    asked = queries.select("query_id", long("text").alias("words")).filter(F.size("words") > 0)
    index = terms.select("name", "mention_count", F.explode(long("name")).alias("word"))
    hits = asked.select("query_id", F.explode("words").alias("word")).join(index, "word").select("query_id", "name", "mention_count").distinct()
    none = asked.select("query_id").join(hits.select("query_id"), "query_id", "left_anti")
    best = terms.select("name", "mention_count").orderBy(F.desc("mention_count"), "name").limit(most)  # at most that many rows
    every = hits.unionByName(none.crossJoin(F.broadcast(best)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("mention_count"), "name"))
    return every.withColumn("rank", place).filter(F.col("rank") <= most).select("query_id", F.col("name").alias("term"), "rank")
