"""Hard negatives of a set of anchors, found by distributed radix selection.

An anchor's positives are its best rows of the same label. Each anchor and positive make a window of
scores: a hard negative is a row of another label whose score, an integer inner product with the
anchor, stands between two percentages of the positive's. The first k of a window are those of the
least key (window's upper end minus score, then id). The key is read as digits of eight bits. Each
task counts, for each window, the rows that agree with the digits known so far by their next
digit; Spark sums these histograms and finds the bucket that holds the kth row. Once few rows stand in
the bucket, or all digits are known, the rows up to it, and no others, are gathered, ranked and cut to k. A third of all rows
may have one score: then the ids' digits decide, and rows equal in these too are cut to k in each task.

Anchors are the stated query set, in blocks of about BLOCK, each against all rows: a block's anchors,
windows and known digits are what is broadcast, histograms are at most 256 rows a window and task. No row is shuffled but
the gathered ones. A block's result is written before the next is begun.

Defined results: rows without an id, a label or a whole vector take no part (see fixed_point). "Other" rows are
those of another id; rows of one id are rows of their own, but equal anchor rows count once. Fewer
rows than asked for are all returned; an empty table gives an empty result. Labels are whole numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..operators.search import Best
from . import common, fixed_point

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Anchors in a block, about.
BLOCK = 1024
#: Rows beyond the first k that a bucket may hold when its rows are gathered.
ROOM = 64
#: Inner products stay below 2**52, exact in floating point.
BITS = 52


class Windows:
    """The windows of a block's anchors and the digits known of each one's kth key."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, score_digits: int, id_digits: int, least_id: int, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.score_digits, self.id_digits, self.least_id = score_digits, id_digits, least_id
        n = len(anchor)
        self.score, self.id = np.zeros(n, np.int64), np.zeros(n, np.uint64)  # the digits known
        self.level = np.zeros(n, np.int64)  # how many
        self.before = np.zeros(n, np.int64)  # rows of a lesser key than any in the bucket
        self.open = np.ones(n, bool)
        self.whole = np.zeros(n, bool)  # fewer rows than asked for: all are taken

    def digits(self, w: int, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The next digit of the rows of these scores and ids, -1 where the known ones differ."""
        level, key = self.level[w], self.high[w] - score
        if level < self.score_digits:
            shift = 8 * (self.score_digits - level - 1)
            return np.where(key >> (shift + 8) == self.score[w], key >> shift & 255, -1)
        shift = 8 * (self.score_digits + self.id_digits - level - 1)
        place = self.place(ids)
        held = (key == self.score[w]) & ((place >> np.uint64(shift) >> np.uint64(8)) == self.id[w])
        return np.where(held, (place >> np.uint64(shift) & np.uint64(255)).astype(np.int64), -1)

    def taken(self, w: int, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a row's key is not beyond the bucket."""
        level, key = self.level[w], self.high[w] - score
        if self.whole[w] or not level:
            return np.ones(len(key), bool)
        if level <= self.score_digits:
            return key >> (8 * (self.score_digits - level)) <= self.score[w]
        shift = 8 * (self.score_digits + self.id_digits - level)
        return (key < self.score[w]) | ((key == self.score[w]) & (self.place(ids) >> np.uint64(shift) <= self.id[w]))

    def place(self, ids: np.ndarray) -> np.ndarray:
        return ids.astype(np.uint64) - np.array(self.least_id).astype(np.uint64)

    def learn(self, found: dict[int, tuple[int, int, int]]) -> None:
        """found: of a window the digit of the kth row, the rows of lesser digits and those of this one."""
        for w in np.flatnonzero(self.open).tolist():
            if w not in found:
                self.whole[w], self.open[w] = True, False
                continue
            digit, less, here = found[w]
            if self.level[w] < self.score_digits:
                self.score[w] = self.score[w] << 8 | digit
            else:
                self.id[w] = self.id[w] << np.uint64(8) | np.uint64(digit)
            self.level[w] += 1
            self.before[w] += less
            self.open[w] = here > self.k + ROOM and self.level[w] < self.score_digits + self.id_digits


def _scores(batch, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by row and anchor, the rows' labels and ids."""
    vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    scores = (vectors @ model["vectors"].T).astype(np.int64)
    return scores, batch.column("label").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)


def _positives(rows: DataFrame, held, k: int) -> DataFrame:
    """(a, id, score): each task's best k rows of an anchor's own label."""

    def run(batches):
        import pyarrow as pa

        model, best = held.value, Best(k)
        for batch in slices(batches, "v"):
            scores, labels, ids = _scores(batch, model)
            same = (labels[:, None] == model["labels"]) & (ids[:, None] != model["ids"])
            for _ in best.add(batch.column("id"), np.where(same, scores.astype(float), -np.inf), same):
                pass
        for table in best.rest():
            yield from pa.table({"a": table.column("q").cast(pa.int32()), "id": table.column("id"), "score": table.column("score").cast(pa.int64())}).to_batches()

    return rows.mapInArrow(run, "a int, id long, score long")


def _candidates(scores, labels, ids, model):
    """(window, scores, ids) of the rows of another label within each window that concerns the task."""
    w: Windows = model["windows"]
    for a, group in model["by anchor"]:
        s = scores[:, a]
        other = np.flatnonzero((labels != model["labels"][a]) & (s >= w.low[group].min()) & (s <= w.high[group].max()))
        s, i = s[other], ids[other]
        for x in group:
            inside = (s >= w.low[x]) & (s <= w.high[x])
            yield x, s[inside], i[inside]


def _histograms(rows: DataFrame, held) -> DataFrame:
    """(w, digit, n, less): each task's counts by window and next digit; less, the rows that the bucket's digits already exclude."""

    def run(batches):
        import pyarrow as pa

        model = held.value
        w: Windows = model["windows"]
        counts = np.zeros((len(w.anchor), 256), np.int64)
        for batch in slices(batches, "v"):
            for x, s, i in _candidates(*_scores(batch, model), model):
                digits = w.digits(x, s, i)
                counts[x] += np.bincount(digits[digits >= 0], minlength=256)
        at, digit = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(digit, pa.int32()), pa.array(counts[at, digit]), pa.array(w.before[at])], ["w", "digit", "n", "before"])

    return rows.mapInArrow(run, "w int, digit int, n long, before long")


def _kth(histograms: DataFrame, k: int) -> dict[int, tuple[int, int, int]]:
    """Of each window with k rows: the digit of the kth, the rows of lesser digits, the rows of this one. A row a window of the block."""
    summed = histograms.groupBy("w", "digit").agg(F.sum("n").alias("n"), F.min("before").alias("before"))
    upto = summed.withColumn("upto", F.sum("n").over(Window.partitionBy("w").orderBy("digit")))
    bucket = upto.filter((F.col("before") + F.col("upto") >= k) & (F.col("before") + F.col("upto") - F.col("n") < k))
    return {r.w: (r.digit, r.upto - r.n, r.n) for r in bucket.collect()}


def _gathered(rows: DataFrame, held, k: int) -> DataFrame:
    """(w, id, score) of the rows up to the bucket of each window; of more than k in a task its first k."""

    def run(batches):
        import pyarrow as pa

        model = held.value
        w: Windows = model["windows"]
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, "v"):
            for x, s, i in _candidates(*_scores(batch, model), model):
                keep = w.taken(x, s, i)
                if keep.any():
                    s, i = s[keep], i[keep]
                    if x in best:
                        s, i = np.concatenate([best[x][0], s]), np.concatenate([best[x][1], i])
                    if len(s) > k:
                        first = np.lexsort((i, -s))[:k]
                        s, i = s[first], i[first]
                    best[x] = s, i
        for x, (s, i) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), x), pa.int32()), pa.array(i, pa.int64()), pa.array(s)], ["w", "id", "score"])

    return rows.mapInArrow(run, "w int, id long, score long")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _first(rows: DataFrame, group: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def _mine_block(rows: DataFrame, block: list, ends: tuple[int, int], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    model = {"ids": np.array([r.id for r in block]), "labels": np.array([r.label for r in block]), "vectors": np.array([r.v for r in block], float)}
    held = spark.sparkContext.broadcast(model)  # a block of anchors
    pairs = _first(_positives(rows, held, positives), "a", positives).select("a", "id", "score", "rank").collect()  # at most `positives` rows an anchor of the block
    pairs = sorted((r.a, r.rank, r.id, r.score) for r in pairs)
    bounds = [(a, -(-low * s // 100), high * s // 100, i, s) for a, _, i, s in pairs]
    bounds = [b for b in bounds if b[1] <= b[2]]
    if not bounds:
        return spark.createDataFrame([], RESULT)
    anchor, least, most = (np.array([b[c] for b in bounds], np.int64) for c in range(3))
    digits = lambda n: -(-int(n).bit_length() // 8)
    windows = Windows(anchor, least, most, digits((most - least).max()), digits(ends[1] - ends[0]), ends[0], negatives)
    while True:
        model["windows"] = windows
        active = np.flatnonzero(windows.open)
        model["by anchor"] = [(int(a), active[anchor[active] == a].tolist()) for a in np.unique(anchor[active])]
        if not len(active) or not windows.score_digits + windows.id_digits:
            break
        held = spark.sparkContext.broadcast(model)
        windows.learn(_kth(_histograms(rows, held), negatives))
    model["by anchor"] = [(int(a), np.flatnonzero(anchor == a).tolist()) for a in np.unique(anchor)]
    held = spark.sparkContext.broadcast(model)
    found = _first(_gathered(rows, held, negatives), "w", negatives)
    named = spark.createDataFrame([(w, int(model["ids"][a]), i, s) for w, (a, _, _, i, s) in enumerate(bounds)], "w int, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(named), "w").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of the rows that meet the SQL condition `anchors` on id; see the module for the columns."""
    spark, block = rows.sparkSession, block or BLOCK
    whole, _ = fixed_point.fixed(rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), scale, BITS, id_col, vector_col, label_col)
    kept = common.stage(common.spread(whole.select(F.col("id").cast("long"), F.col("label").cast("long"), "v")), "mining-rows")
    asked = common.stage(kept.filter(anchors).distinct(), "anchors")
    count, least, most = asked.count(), *kept.agg(F.min("id"), F.max("id")).first()
    blocks = -(-count // block)
    parts = []
    for b in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == b).collect()  # about `block` rows, equal ones once
        if some:
            parts.append(common.stage(_mine_block(kept, some, (least, most), positives, negatives, low, high), "hard-negatives"))
    if not parts:
        return spark.createDataFrame([], RESULT)
    paths = [f for p in parts for f in p.inputFiles()]
    return spark.read.schema(parts[0].schema).parquet(*paths)


def op13_radix_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.load(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", shifted.alias("label")), "id % 100 = 0")


ORACLE = f"""
WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor, r.vec_id AS other, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM k a, k r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= {POSITIVES})
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
