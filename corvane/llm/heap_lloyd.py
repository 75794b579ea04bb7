"""Vector codes of a product quantiser that is fitted by Lloyd's rounds with heaps.

Vectors are cut into consecutive parts, each with a codebook of its own. A round assigns every part to
the nearest entry (squared Euclidean distance in whole numbers, ties to the lower index) and moves
each entry to its parts' floored mean. The rows of a partition stand together in blocks, and a block
has a heap of its parts for each entry. A part's key is the slack between its bounds when it was last
looked at: the distance to the second nearest entry (the lower bound of any other) minus the one to
its own (the upper bound). As entries move, an entry's drift is added up: its own way plus the
longest way of any other. Only parts whose key, less what had drifted before they were pushed, is not
above that sum can have another nearest entry: they are popped from their heaps and compared with all
entries exactly; the others aren't looked at. What has changed hands is summed by part and entry,
first in the block, then by Spark; the codebooks (parts x entries rows) go through the driver.

Blocks and heaps are written to the shared folder after each round; the round before is then removed.

Defined results: rows without a whole vector are dropped (see fixed_point). With fewer rows than
entries there are as many entries as rows. Rows of one id are rows of their own, the first entries
being those of the least (id, components), null ids last. If the dimension isn't a multiple of the
parts, the first parts are one longer. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fixed_point

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block at most, and their bytes.
BLOCK, BLOCK_BYTES = 2048, 1 << 20
#: Slack that rounding of roots and sums can never reach: a part is looked at once too often rather than once too few.
MARGIN = 1e-3
#: Labels up to which their totals are broadcast.
FEW_LABELS = 10_000


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point the nearest entry, the squared distance to it, and the least one to any other (infinite if there is none)."""
    peak = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if points.shape[1] * 4 * int(peak) ** 2 < 1 << 52:  # exact in floating point
        x, c = points.astype(float), entries.astype(float)
        far = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)
    else:
        far = np.stack([((points - c) ** 2).sum(axis=1) for c in entries], axis=1)
    at, rows = far.argmin(axis=1), np.arange(len(points))
    best = far[rows, at]
    if len(entries) == 1:
        return at, best, np.full(len(points), np.inf)
    far = far.astype(float)
    far[rows, at] = np.inf
    return at, best, far.min(axis=1)


def slack(best: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.sqrt(second) - np.sqrt(best.astype(float))


class Heaps:
    """The parts of a block at one position: for each entry a heap of (key, row)."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, order: np.ndarray):
        self.sizes, self.keys, self.order = sizes, keys, order

    @classmethod
    def of_all(cls, points: np.ndarray, entries: np.ndarray) -> Heaps:
        at, best, second = nearest(points, entries)
        keys = slack(best, second)
        order = np.lexsort((keys, at))  # what is sorted is a heap
        return cls(np.bincount(at, minlength=len(entries)), keys[order], order)

    def owners(self) -> np.ndarray:
        """The entry of each row."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out

    def advance(self, points: np.ndarray, entries: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pop what the drift has reached and push it under its nearest entry: the rows popped, their entries before and after."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        live = np.flatnonzero(self.sizes)
        heap_of = lambda e: list(zip(self.keys[starts[e] : ends[e]].tolist(), self.order[starts[e] : ends[e]].tolist(), strict=True))
        open_heaps = {int(e): heap_of(e) for e in live[self.keys[starts[live]] <= drift[live] + MARGIN]}
        popped, before = [], []
        for e, heap in open_heaps.items():
            reached = drift[e] + MARGIN
            while heap and heap[0][0] <= reached:
                popped.append(heapq.heappop(heap)[1])
                before.append(e)
        if not popped:
            return (np.zeros(0, np.int64),) * 3
        rows = np.array(popped)
        after, best, second = nearest(points[rows], entries)
        for row, e, key in zip(popped, after.tolist(), (slack(best, second) + drift[after]).tolist(), strict=True):
            if e not in open_heaps:
                open_heaps[e] = heap_of(e)
            heapq.heappush(open_heaps[e], (key, row))
        keys, order = [], []
        for e in range(len(self.sizes)):
            if e in open_heaps:
                heap = open_heaps[e]
                keys.append(np.array([k for k, _ in heap], float))
                order.append(np.array([i for _, i in heap], np.int64))
            else:
                keys.append(self.keys[starts[e] : ends[e]])
                order.append(self.order[starts[e] : ends[e]])
        self.sizes, self.keys, self.order = np.array([len(k) for k in keys]), np.concatenate(keys), np.concatenate(order)
        return rows, np.array(before), after


def changes(points: np.ndarray, entries: int, after: np.ndarray, before: np.ndarray | None = None) -> list[tuple[int, int, list[int]]]:
    """(entry, count, sum of points) of what has come to an entry, less what has left it."""
    count, total = np.zeros(entries, np.int64), np.zeros((entries, points.shape[1]), np.int64)
    np.add.at(count, after, 1)
    np.add.at(total, after, points)
    if before is not None:
        np.subtract.at(count, before, 1)
        np.subtract.at(total, before, points)
    return [(int(e), int(count[e]), total[e].tolist()) for e in np.flatnonzero((count != 0) | (total != 0).any(axis=1))]


def _cuts(dimension: int, parts: int) -> list[int]:
    return [0, *np.cumsum([len(p) for p in np.array_split(np.arange(dimension), parts)]).tolist()]


def _blocks(rows: DataFrame, dimension: int) -> DataFrame:
    """(ids, labels, vectors): the rows of each partition in blocks."""
    kinds = dict(rows.dtypes)
    size = max(1, min(BLOCK, BLOCK_BYTES // (4 * max(1, dimension))))

    def gather(batches):
        import pyarrow as pa

        def block(table):
            table = table.combine_chunks()
            vectors = fixed_point.matrix(table.column("v").combine_chunks(), dimension).astype("<i4")
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(c).combine_chunks())
            return pa.RecordBatch.from_arrays([one("id"), one("label"), pa.array([vectors.tobytes()], pa.binary())], ["ids", "labels", "vectors"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                held.append(piece := batch.slice(at, size))
                n += piece.num_rows
                while n >= size:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, size))
                    n -= size
                    held = table.slice(size).to_batches()
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(gather, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, vectors binary")


STATE = "sizes binary, keys binary, places binary, changes array<struct<part int, entry int, n long, total array<long>>>"


def _round(blocks: DataFrame, dimension: int, cuts: list[int], held, first: bool) -> DataFrame:
    """The blocks with their heaps brought to the codebooks of `held`, and what has changed hands."""
    schema = ", ".join(f"{c} {t}" for c, t in blocks.select("ids", "labels", "vectors").dtypes) + ", " + STATE
    parts = len(cuts) - 1

    def step(batches):
        import pyarrow as pa

        books, drifts = held.value
        m = len(books[0])
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                vectors = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<i4").reshape(-1, dimension).astype(np.int64) if dimension else np.zeros((len(batch.column("ids")[i]), 0), np.int64)
                n = len(vectors)
                if not first:
                    read = lambda c, kind, size: np.frombuffer(batch.column(c)[i].as_buffer(), kind).reshape(parts, size)  # noqa: B023, E731
                    state = zip(read("sizes", "<i4", m).astype(np.int64), read("keys", "<f8", n), read("places", "<i4", n).astype(np.int64), strict=True)
                heaps, moved = [], []
                for p in range(parts):
                    points = vectors[:, cuts[p] : cuts[p + 1]]
                    if first:
                        h = Heaps.of_all(points, books[p])
                        found = changes(points, m, h.owners())
                    else:
                        h = Heaps(*next(state))
                        rows, before, after = h.advance(points, books[p], drifts[p])
                        away = before != after
                        found = changes(points[rows[away]], m, after[away], before[away])
                    heaps.append(h)
                    moved += [{"part": p, "entry": e, "n": c, "total": t} for e, c, t in found]
                made.append((b"".join(h.sizes.astype("<i4").tobytes() for h in heaps), b"".join(h.keys.astype("<f8").tobytes() for h in heaps), b"".join(h.order.astype("<i4").tobytes() for h in heaps), moved))
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))]
            columns = [pa.array([r[k] for r in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ids", "labels", "vectors")), *columns], ["ids", "labels", "vectors", "sizes", "keys", "places", "changes"])

    return blocks.mapInArrow(step, schema)


def _codes(blocks: DataFrame, dimension: int, cuts: list[int], held) -> DataFrame:
    """(vec_id, label, code, error) of the vectors in blocks whose heaps are those of the codebooks of `held`."""
    kinds = dict(blocks.dtypes)
    inner = lambda c: kinds[c][len("array<") : -1]

    def read(batches):
        import pyarrow as pa

        books = held.value[0]
        m, digits = len(books[0]), max(2, len(f"{len(books[0]) - 1:x}"))
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                n = len(ids)
                vectors = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<i4").reshape(n, dimension).astype(np.int64)
                sizes = np.frombuffer(batch.column("sizes")[i].as_buffer(), "<i4").reshape(-1, m)
                places = np.frombuffer(batch.column("places")[i].as_buffer(), "<i4").reshape(-1, n)
                error, texts = np.zeros(n, np.int64), []
                for p in range(len(cuts) - 1):
                    owner = Heaps(sizes[p], None, places[p]).owners()
                    error += ((vectors[:, cuts[p] : cuts[p + 1]] - books[p][owner]) ** 2).sum(axis=1)
                    texts.append([f"{e:0{digits}x}" for e in owner.tolist()])
                code = ["".join(t) for t in zip(*texts, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(read, f"vec_id {inner('ids')}, label {inner('labels')}, code string, error long")


def quantise(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every row with a whole vector, and the codebooks, a matrix of entries for each part."""
    spark = rows.sparkSession
    kept, dimension = fixed_point.fixed(rows, scale, id_col=id_col, vector_col=vector_col, label_col=label_col)
    kinds, cuts = dict(kept.dtypes), _cuts(dimension, parts)
    least = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()  # at most `entries` rows
    if not least:
        return spark.createDataFrame([], f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long"), []
    start = np.array([r.v for r in least], np.int64).reshape(len(least), dimension)
    books = [start[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)]
    m = len(least)
    counts, totals = [np.zeros(m, np.int64) for _ in books], [np.zeros_like(b) for b in books]
    drifts = [np.zeros(m) for _ in books]
    width = max(len(b[0]) for b in books)
    blocks = common.stage(_blocks(common.spread(kept), dimension), "vector-blocks")
    for done in range(rounds + 1):
        held = spark.sparkContext.broadcast((books, drifts))  # parts x entries rows
        with common.small_batches(spark, 16):
            before, blocks = blocks, common.stage(_round(blocks, dimension, cuts, held, first=not done), "vector-heaps")
        common.discard(before)
        if done == rounds:
            break
        change = blocks.select(F.explode("changes").alias("c")).select("c.*")
        sums = change.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)])
        for r in sums.collect():  # at most parts x entries rows
            counts[r.part][r.entry] += r.n
            totals[r.part][r.entry] += np.array(r[3 : 3 + totals[r.part].shape[1]], np.int64)
        moved = []
        for book, n, total, drift in zip(books, counts, totals, drifts, strict=True):
            fresh = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], book)
            way = np.sqrt(((fresh - book).astype(float) ** 2).sum(axis=1))
            others = np.array([np.delete(way, e).max(initial=0.0) for e in range(m)])
            drift = drift + way + others
            moved.append((fresh, drift))
        books, drifts = [b for b, _ in moved], [d for _, d in moved]
    with common.small_batches(spark, 16):
        return common.stage(_codes(blocks, dimension, cuts, held), "vector-codes"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with the sum of `error` over the rows of an equal label, nulls together."""
    totals = common.stage(codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if totals.count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")


def digest(books: list[np.ndarray]) -> str:
    """The hex SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def op11_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = quantise(common.load(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    far = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.part, c.entry, {far} AS d FROM p JOIN c{k} c USING (part)) GROUP BY ALL)")
        if k < ROUNDS:
            mean = f"SELECT part, entry, list(y ORDER BY i) AS y FROM (SELECT part, entry, i, floor(sum(v) / count(*)) AS y FROM (SELECT a.part, a.entry, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS i FROM a{k} a JOIN p USING (vec_id, part)) GROUP BY part, entry, i) GROUP BY part, entry"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.y, c.x) AS x FROM c{k} c LEFT JOIN ({mean}) m USING (part, entry))")
    return f"""
    WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, part, list_slice(v, part * (len(v) // 4) + 1, (part + 1) * (len(v) // 4)) AS x FROM k, (SELECT unnest(range(4)) AS part)),
    c0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
    {", ".join(steps)},
    e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
    b AS (SELECT sha256(string_agg(CAST(v AS BIGINT), ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM c{ROUNDS}))
    SELECT e.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.h AS codebooks_sha256 FROM e JOIN k USING (vec_id), b
    """


ORACLE = _oracle()
