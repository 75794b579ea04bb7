"""An index of vectors that outlives a batch of queries: inverted lists with product-quantised residuals.

build() fits the model on a bounded sample: the `sample` rows with the least hashes of their ids, of length 1
each. k-means gives the centres of the lists; what is left of the sample around its centres is
cut into parts, each with a codebook of up to 256 entries. Every row is then assigned to its nearest list
and coded, a byte a part, and written in ranges of list and id, so that a list of a third of all rows stands in several files
and a search reads the row groups of its lists alone.

search() takes queries in blocks. Of each, the nearest `probes` lists are looked through by their codes alone: a
table of inner products a query, a look-up a part and row. The best `candidates` of each query are then
scored by their whole vectors, as operators.search.dense does. probes=None looks through all lists, candidates=None
scores all rows of the lists by their vectors: with both, results are exact. How many lists it takes depends on how clustered the
vectors are; probes_for() measures it on a sample of queries.

Defined results: rows without a vector aren't indexed; a vector of zeros has cosine 0 with all. Ties fall to the lesser id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..sources.segments import Segments
from .search import QUERY_BLOCK, Best, _scored, _united, cosine, dense, doubles, query_blocks, top


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centres of a sample; the first distinct points are those to begin with, and a centre without points stays."""
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        at = _nearest(points, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


class Model:
    """Centres of the lists, and a codebook for each part of a residual."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.cuts = np.cumsum([0] + [b.shape[1] for b in books])

    @classmethod
    def fit(cls, points: np.ndarray, lists: int, parts: int) -> Model:
        centres = k_means(points, lists)
        rest = points - centres[_nearest(points, centres)]
        return cls(centres, [k_means(p, 256) for p in np.array_split(rest, min(parts, points.shape[1]), axis=1)])

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each point, and its code: a byte a part."""
        at = _nearest(points, self.centres)
        rest = points - self.centres[at]
        codes = [_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)]
        return at, np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products by query, part and entry."""
        out = np.zeros((len(queries), len(self.books), 256))
        for p, book in enumerate(self.books):
            out[:, p, : len(book)] = queries[:, self.cuts[p] : self.cuts[p + 1]] @ book.T
        return out


#: Estimates of pairs that a task makes at a time.
PAIRS = 1 << 20


class _Pairs(Best):
    """The k best rows of each query. What is below a query's k-th best so far is not held."""

    def __init__(self, k: int, queries: int):
        super().__init__(k)
        self.floor, self.count = np.full(queries, -np.inf), 0

    def put(self, own: np.ndarray, ids, scores: np.ndarray) -> None:
        """scores by query of `own` and row of ids."""
        import pyarrow as pa

        found, n = scores >= self.floor[own][:, None], scores.shape[1]
        if n > self.k:  # no more than these of a step, but for ties
            found &= scores >= np.partition(scores, n - self.k, axis=1)[:, n - self.k, None]
        at, rows = np.nonzero(found)
        self.held.append(pa.table({"q": pa.array(own[at]), "id": ids.take(pa.array(rows)), "score": pa.array(scores[at, rows])}))
        self.count += len(at)
        if self.count > self.room:
            best = self.cut()
            self.held, self.count = [best], len(best)
            self.room = max(self.room, 2 * len(best))
            q, score = best.column("q").to_numpy(), best.column("score").to_numpy()
            last = np.flatnonzero(np.append(q[1:] != q[:-1], True))
            full = last[np.diff(last, prepend=-1) == self.k]
            self.floor[q[full]] = score[full]


def _matrix(lists) -> np.ndarray:
    lists = lists.combine_chunks() if hasattr(lists, "combine_chunks") else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        """The index in a folder of build()."""
        self.spark, self.segments = spark, Segments(spark, root)
        model = self.segments.read("model").first()
        centres = np.array(model.centres).reshape(model.lists, -1)
        self.model = Model(centres, [np.array(b).reshape(-1, w) for b, w in zip(model.books, model.widths, strict=True)])

    @classmethod
    def build(cls, rows: DataFrame, root: str, key: str = "vec_id", vector: str = "embedding", lists: int = 256, parts: int = 16, sample: int = 20_000) -> VectorIndex:
        """Fit on a sample of at most `sample` rows, then index all rows."""
        spark = rows.sparkSession
        whole = rows.select(F.col(key).alias("id"), doubles(F.col(vector)).alias("v")).filter("v is not null and size(v) > 0")
        drawn = whole.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v")  # the documented sample
        if not len(drawn):
            raise ValueError("an index needs vectors to be fitted on")
        model = Model.fit(unit(_matrix(drawn)), lists, parts)
        row = (len(model.centres), model.centres.ravel().tolist(), [b.ravel().tolist() for b in model.books], [b.shape[1] for b in model.books])
        Segments(spark, root).write(spark.createDataFrame([row], "lists int, centres array<double>, books array<array<double>>, widths array<int>"), "model")
        index = cls(spark, root)
        index.add(rows, key, vector)
        return index

    def add(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Index more rows, as a segment; rows of an id that is there already stand beside it: remove() it first to replace it."""
        held = self.spark.sparkContext.broadcast(self.model)
        known = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v is not null and size(v) > 0")
        kinds = dict(known.dtypes)

        def assign(batches):
            import pyarrow as pa

            for batch in slices(batches, "v"):
                at, codes = held.value.assign(unit(_matrix(batch.column("v"))))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("v")], ["list", "id", "code", "v"])

        coded = known.mapInArrow(assign, f"list int, id {kinds['id']}, code binary, v {kinds['v']}")
        self.segments.write(coded.repartitionByRange("list", "id").sortWithinPartitions("list", "id"), "rows")

    def remove(self, ids: DataFrame, key: str = "vec_id") -> None:
        """The rows of these ids that were added before are gone."""
        self.segments.write(ids.select(F.col(key).alias("id")).distinct(), "removed")

    def rows(self, columns: list[str], lists: list[int] | None = None) -> DataFrame:
        """Columns of what is indexed and not removed, of some lists or of all."""
        rows = self.segments.read("rows").select(*columns, "begun")
        if lists is not None:
            rows = rows.filter(F.col("list").isin(lists))
        gone = self.segments.read("removed")
        if gone is not None:
            rows = rows.join(gone.groupBy("id").agg(F.max("begun").alias("until")), "id", "left").filter("until is null or begun > until")
        return rows.select(*columns)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = 8, candidates: int | None = 100, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, id, dense, rank): the k best rows of each query among those looked at, by their cosine to six decimals."""
        asked = queries.select(F.col(query_key).alias("query_id"), doubles(F.col(vector)).alias("v")).filter("v is not null and size(v) > 0")
        parts = [self._block(block, k, probes, candidates, asked.schema["query_id"].dataType.simpleString()) for block in query_blocks(asked, "query_id", QUERY_BLOCK) if block.num_rows]
        if not parts:
            id_type = self.segments.read("rows").schema["id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {id_type}, dense double, rank int")
        return _united(parts)

    def probes_for(self, queries: DataFrame, share: float = 0.95, k: int = 10, sample: int = 256, query_key: str = "query_id", vector: str = "embedding") -> int:
        """The least number of lists that hold this share of the true k best rows of a sample of the queries, which are found exactly."""
        asked = queries.select(F.col(query_key).alias("query_id"), doubles(F.col(vector)).alias("v")).filter("v is not null and size(v) > 0").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
        rows = self.rows(["list", "id", "v"])
        best = top(dense(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), asked.withColumnRenamed("v", "embedding"), k=k), "dense", k)
        found = best.join(rows.select("id", "list"), "id").select("query_id", "list").toArrow()  # k rows a query of the sample
        table = asked.toArrow()
        if not len(found):
            return len(self.model.centres)
        near = ((self.model.centres**2).sum(axis=1) - 2 * unit(_matrix(table.column("v"))) @ self.model.centres.T).argsort(axis=1, kind="stable").argsort(axis=1)
        place = {q: i for i, q in enumerate(table.column("query_id").to_pylist())}
        at = np.sort([near[place[q], x] for q, x in zip(found.column("query_id").to_pylist(), found.column("list").to_pylist(), strict=True)])
        return int(at[max(0, int(np.ceil(share * len(at))) - 1)]) + 1

    def _block(self, block, k: int, probes: int | None, candidates: int | None, query_type: str) -> DataFrame:
        model, units = self.model, unit(_matrix(block.column("v")))
        near = units @ model.centres.T
        n = len(model.centres)
        order = np.argsort(((model.centres**2).sum(axis=1) - 2 * near), axis=1, kind="stable")[:, : probes or n]
        wanted = sorted(set(order.ravel().tolist()))
        lists = wanted if len(wanted) < n else None
        keys = block.column("query_id").combine_chunks()
        kind = self.segments.read("rows").schema["id"].dataType.simpleString()
        if candidates is None:  # rows of the lists against the whole block where they are, as dense() does
            probed = np.zeros((n, len(units)), bool)
            probed[order, np.arange(len(units))[:, None]] = True
            held = self.spark.sparkContext.broadcast({"keys": keys, "units": units, "probed": probed})  # a block of queries

            def score(batch, model):
                found = model["probed"][batch.column("list").to_numpy()]
                return np.where(found, np.round(unit(_matrix(batch.column("v"))) @ model["units"].T, 6) + 0.0, -np.inf), found

            return top(_scored(self.rows(["list", "id", "v"], lists), kind, query_type, held, k, "v", "dense", score), "dense", k).select("query_id", "id", "dense", "rank")
        asked = self.spark.createDataFrame(block)
        by_list = {x: np.flatnonzero((order == x).any(axis=1)) for x in wanted}
        held = self.spark.sparkContext.broadcast((keys, near, model.tables(units), by_list))  # a block of queries

        def estimate(batches):
            import pyarrow as pa

            keys, near, tables, by_list = held.value
            best = _Pairs(candidates, len(keys))
            for batch in slices(batches, "code"):
                at = batch.column("list").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(at), -1)
                for x in np.unique(at):
                    inside, own = np.flatnonzero(at == x), by_list.get(int(x))
                    if own is None:
                        continue
                    step = max(1, PAIRS // len(own))
                    for rows in (inside[i : i + step] for i in range(0, len(inside), step)):
                        score = np.repeat(near[own, x][:, None], len(rows), axis=1)
                        for p in range(codes.shape[1]):
                            score += tables[own, p][:, codes[rows, p]]
                        best.put(own, batch.column("id").take(pa.array(rows)), np.round(score, 9))
            for table in best.rest():
                out = table.append_column("query_id", keys.take(table.column("q"))).select(["query_id", "id", "score"]).combine_chunks()
                yield from out.to_batches(max_chunksize=1 << 16)

        rough = self.rows(["list", "id", "code"], lists).mapInArrow(estimate, f"query_id {query_type}, id {kind}, score double")
        found = top(rough, "score", candidates).select("query_id", "id")
        found = F.broadcast(found)  # at most a block's queries x candidates
        whole = self.rows(["list", "id", "v"], lists)
        exact = whole.join(found, "id").select("query_id", "id", doubles(F.col("v")).alias("v"))
        scored = exact.join(F.broadcast(asked.withColumnRenamed("v", "qv")), "query_id").select("query_id", "id", F.round(cosine(F.col("qv"), F.col("v")), 6).alias("dense"))
        return top(scored, "dense", k).select("query_id", "id", "dense", "rank")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact (query_id, id) that was found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
