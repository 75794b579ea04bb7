"""A stored inverted index for BM25: postings in blocks with maxima, and searches that skip blocks.

Documents are sorted by two least hashes of their terms, so that those with many terms in common stand
together, and dealt in this order into groups of `size`. A block is the postings of one term in one
group: ids, term frequencies and lengths, with the largest frequency and the least length as columns of their own.
Both bound what the term can add to any document of the group, whatever the mean length becomes.
Blocks are written in ranges of term and group, so a search reads the row groups of its terms, a term of a
third of all postings stands in several files, and a group is bounded by its size.

search() never reads a text. From the maxima alone it adds up, for each query and group, the most that a document of
the group can reach. The k groups with the highest sums are scored in full, and the kth best score is a threshold: only
groups whose sum reaches it are scored, all others can't hold one of the k best (dynamic pruning by block maxima). The hits
equal operators.search.bm25's, ties included.

Changes are segments: add() indexes more documents, remove() takes ids out of what was there before, and statistics follow at
once; compact() writes all into one segment, when no one searches. Ids are unique within a segment.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..sources.checkpoint import checkpointed
from ..sources.segments import Segments
from .search import K1, QUERY_BLOCK, B, _scored, _united, query_blocks, token_lists, top

#: Query terms up to which they are named in the scan's filter.
NAMED_TERMS = 200
#: Sums of maxima count as reaching a threshold that they miss by less: scores have six decimals.
SLACK = 2e-6


def _weight(tf: Column, dl: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


class TextIndex:
    def __init__(self, spark: SparkSession, root: str):
        """The index in a folder; an empty one if nothing was added yet."""
        self.spark, self.segments = spark, Segments(spark, root)

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 64) -> None:
        """Index documents as a segment, in groups of about `size`; those of an id that is there already stand beside it: remove() it first to replace it."""
        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        kind = dict(rows.dtypes)["id"]

        def count(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            for batch in slices(batches, "text"):
                flat, sizes = token_lists(batch.column("text"))
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                full = pc.not_equal(flat, "")
                table = pa.table({"doc": owner.filter(full), "term": flat.filter(full)})
                counts = table.group_by(["doc", "term"]).aggregate([([], "count_all")]).sort_by("doc").combine_chunks()
                lengths = np.bincount(table.column("doc").to_numpy(), minlength=len(sizes))
                heads = pa.array(np.searchsorted(counts.column("doc").to_numpy(), np.arange(len(sizes) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(heads, c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)) for c in (counts.column("term"), counts.column("count_all").cast(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths.astype(np.int64)), *lists], ["id", "dl", "terms", "tf"])

        counted = checkpointed(rows.mapInArrow(count, f"id {kind}, dl long, terms array<string>, tf array<int>"), "counted")
        least = lambda seed: F.array_min(F.transform("terms", lambda t: F.xxhash64(F.lit(seed), t)))
        self._write(counted.withColumns({"first": least(1), "second": least(2)}), size)

    def _write(self, counted: DataFrame, size: int) -> None:
        """counted (id, dl, terms, tf, first, second) as a segment; blocks count once the lengths under their name are there."""
        order = ["first", "second", "id"]
        dealt = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("grp", F.xxhash64(F.lit(uuid.uuid4().hex), F.floor(F.monotonically_increasing_id() / size)))
        dealt = checkpointed(dealt, "dealt")  # a number of a row must not change any more
        lengths = dealt.select("id", "dl", "first", "second")
        placed = dealt.select("id", "dl", "grp", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tf"))))
        blocks = placed.repartitionByRange("term", "grp").groupBy("term", "grp").agg(F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.array_sort(F.collect_list(F.struct("id", "tf", "dl"))).alias("docs"))
        name = self.segments.write(blocks.sortWithinPartitions("term", "grp"), "blocks")
        self.segments.write(lengths, "lengths", of=name)

    def _stored(self) -> DataFrame:
        return self.segments.read("blocks", [n.replace("lengths-", "blocks-") for n in self.segments.names("lengths")])

    def remove(self, ids: DataFrame, key: str = "doc_id") -> None:
        """The documents of these ids that were added before are gone."""
        self.segments.write(ids.select(F.col(key).alias("id")).distinct(), "removed")

    def _without_removed(self, rows: DataFrame) -> DataFrame:
        """rows (id, begun) that no later removal names."""
        gone = self.segments.read("removed")
        if gone is None:
            return rows
        return rows.join(gone.groupBy("id").agg(F.max("begun").alias("until")), "id", "left").filter("until is null or begun > until").drop("until")

    def compact(self, size: int = 64) -> None:
        """Write what is there as one segment and drop the others."""
        before = [(kind, self.segments.names(kind)) for kind in ("removed", "blocks", "lengths")]
        opened = self._without_removed(self._stored().select("term", "begun", F.inline("docs"))).groupBy("begun", "id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("t"))
        lengths = self._without_removed(self.segments.read("lengths")).select("begun", "id", "dl", "first", "second")
        empty = lengths.filter("dl = 0").select("id", "dl", F.array().cast("array<string>").alias("terms"), F.array().cast("array<int>").alias("tf"), "first", "second")
        full = opened.select("begun", "id", F.col("t.term").alias("terms"), F.col("t.tf").alias("tf")).join(lengths, ["begun", "id"]).select(empty.columns)
        self._write(full.unionByName(empty), size)
        for _, names in before:
            self.segments.drop(names)

    def search(self, queries: DataFrame, k: int = 10, query_key: str = "item_id", text: str = "text") -> DataFrame:
        """(query_id, id, bm25, rank): the k best documents of each query, each query term once; bm25 has six decimals."""
        parts = [self._block(*m, k)[0] for m in self._blocks(queries, query_key, text)]
        return _united(parts) if parts else self._nothing(queries, query_key)

    def read_share(self, queries: DataFrame, k: int = 10, query_key: str = "item_id", text: str = "text") -> DataFrame:
        """(blocks, blocks_read): of a search, the blocks of its query terms, once for each query with the term, and those that are scored."""
        parts = [self._block(*m, k)[1] for m in self._blocks(queries, query_key, text)]
        return _united(parts).groupBy().agg(F.sum("blocks").alias("blocks"), F.sum("blocks_read").alias("blocks_read"))

    def _nothing(self, queries: DataFrame, query_key: str) -> DataFrame:
        lengths = self.segments.read("lengths")
        kind = lengths.schema["id"].dataType.simpleString() if lengths is not None else "long"
        return self.spark.createDataFrame([], f"query_id {queries.schema[query_key].dataType.simpleString()}, id {kind}, bm25 double, rank int")

    def _blocks(self, queries: DataFrame, query_key: str, text: str):
        """For each block of queries: its keys, the terms (query, term, idf), and the mean length."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = self.segments.read("lengths")
        if lengths is None:
            return
        n, mean = self._without_removed(lengths).agg(F.count("*"), F.avg("dl")).first()
        asked = queries.select(F.col(query_key).alias("query_id"), F.col(text).alias("text"))
        for block in query_blocks(asked, "query_id", QUERY_BLOCK):
            if not block.num_rows:
                continue
            flat, sizes = token_lists(block.column("text").combine_chunks())
            pairs = pa.table({"q": pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), "term": flat}).filter(pc.not_equal(flat, "")).group_by(["q", "term"]).aggregate([])
            terms = self.spark.createDataFrame(pa.table({"term": pc.unique(pairs.column("term"))}))
            found = self._postings(terms)
            if self.segments.names("removed"):
                frequency = self._without_removed(found.select("term", "begun", F.inline("docs"))).groupBy("term").agg(F.count("*").alias("df"))
            else:
                frequency = found.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
            idf = {r.term: float(np.log(1 + (n - r.df + 0.5) / (r.df + 0.5))) for r in frequency.collect()}  # a row a term of the block
            rows = [(q, t, idf[t]) for q, t in zip(pairs.column("q").to_pylist(), pairs.column("term").to_pylist(), strict=True) if t in idf]
            if rows:
                yield block.column("query_id").combine_chunks(), rows, mean or 1.0, asked.schema["query_id"].dataType.simpleString()

    def _postings(self, terms: DataFrame) -> DataFrame:
        """The blocks of these terms."""
        blocks = self._stored()
        named = [r.term for r in terms.limit(NAMED_TERMS + 1).collect()]
        if len(named) <= NAMED_TERMS:
            blocks = blocks.filter(F.col("term").isin(named))  # reaches the scan
        return blocks.join(F.broadcast(terms), "term")  # a block's terms

    def _block(self, keys, rows: list, mean: float, query_type: str, k: int) -> tuple[DataFrame, DataFrame]:
        spark = self.spark
        vocabulary = sorted({t for _, t, _ in rows})
        place = {t: i for i, t in enumerate(vocabulary)}
        terms = spark.createDataFrame([(t, i) for t, i in place.items()], "term string, t int")
        wanted = spark.createDataFrame([(q, place[t], t, x) for q, t, x in rows], "q int, t int, term string, idf double")
        weight = np.zeros(len(vocabulary))
        owners = [[] for _ in vocabulary]
        for q, t, x in rows:
            weight[place[t]] = x
            owners[place[t]].append(q)
        each = np.array([len(o) for o in owners])
        model = {"keys": keys, "weight": weight, "queries": np.concatenate([np.array(o) for o in owners]), "heads": np.cumsum(each) - each, "each": each, "least": None}

        # of each group and query the most that a document can reach
        blocks = self._postings(terms)
        bound = F.struct("t", _weight(F.col("most_tf"), F.col("least_dl"), mean).alias("w"))
        groups = blocks.groupBy("grp").agg(F.collect_list(bound).alias("b")).select(F.col("grp").alias("id"), F.col("b.t").alias("terms"), F.col("b.w").alias("parts"))
        groups = checkpointed(groups, "bounds")

        def reach(batch, model):
            size, n = len(model["keys"]), batch.num_rows
            t = batch.column("terms").flatten().to_numpy()
            part = batch.column("parts").flatten().to_numpy() * model["weight"][t]
            owner = np.repeat(np.arange(n), np.diff(batch.column("terms").offsets.to_numpy()))
            some, ends = model["each"][t], np.cumsum(model["each"][t])
            query = model["queries"][np.repeat(model["heads"][t] - ends + some, some) + np.arange(some.sum())]
            most = np.bincount(np.repeat(owner, some) * size + query, np.repeat(part, some), n * size).reshape(n, size)
            return most, most > 0 if model["least"] is None else (most > 0) & (most + SLACK >= model["least"])

        bounds = lambda least, k: _scored(groups, "bigint", query_type, spark.sparkContext.broadcast(model | {"least": least}), k, "terms", "most", reach)
        named = spark.createDataFrame([(i, v) for i, v in enumerate(keys.to_pylist())], f"q int, query_id {query_type}")
        seeds = self._scores(top(bounds(None, k), "most", k), named, wanted, blocks, mean, few=True)
        kth = top(seeds, "bm25", k).filter(F.col("rank") == k).join(named, "query_id").select("q", "bm25").collect()  # a row a query of the block
        least = np.zeros(len(keys))
        for r in kth:
            least[r.q] = r.bm25
        reached = checkpointed(bounds(least, None).select("query_id", "id"), "reached")
        hits = top(self._scores(reached, named, wanted, blocks, mean), "bm25", k).select("query_id", "id", "bm25", "rank")
        asked = blocks.select("grp", "t").join(F.broadcast(wanted.groupBy("t").agg(F.count("*").alias("queries"))), "t").agg(F.sum("queries").alias("blocks"))
        pairs = reached.join(F.broadcast(named), "query_id").join(F.broadcast(wanted), "q").select(F.col("id").alias("grp"), "term")
        return hits, asked.crossJoin(pairs.join(blocks.select("grp", "term"), ["grp", "term"]).agg(F.count("*").alias("blocks_read")))

    def _scores(self, pairs: DataFrame, named: DataFrame, wanted: DataFrame, blocks: DataFrame, mean: float, few: bool = False) -> DataFrame:
        """(query_id, id, bm25) of all documents in pairs (query_id, id: a group); few: k groups a query at most, so blocks stay where they are."""
        parts = pairs.select("query_id", F.col("id").alias("grp")).join(F.broadcast(named), "query_id").join(F.broadcast(wanted.select("q", "term", "idf")), "q")
        opened = (F.broadcast(parts) if few else parts).join(blocks.select("grp", "term", "begun", "docs"), ["grp", "term"]).select("query_id", "idf", "begun", F.inline("docs"))
        scored = self._without_removed(opened).select("query_id", "id", (F.col("idf") * _weight(F.col("tf"), F.col("dl"), mean)).alias("part"))
        return scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("bm25"))
