"""Quality rules, and an isolation forest on their statistics.

Base rules are counted over whole texts. A forest of random trees, each grown on a few hundred
documents, isolates unusual combinations of the statistics in short paths. The score from which a
document counts as anomalous is calibrated on all labelled rows: of the scores that keep at least
`keep` of the rows labelled good, that with the best balance of good rows kept and bad rows dropped.

The forest is grown on TREES * TREE_ROWS documents at most, drawn by a hash of id and statistics: a
bound that belongs to the method. Statistics, scores and the threshold cover every row.

Defined results: a null text has no words and fails the base rules. Without labelled rows of both
kinds the threshold is 1, so that the base rules decide. Rows with equal ids are judged each by its
own text; a null id is an id like another.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .odd_sketch import mix

TREES, TREE_ROWS = 100, 256
SYMBOLS = [c.encode() for c in "#*$%&|<>"]
SPACES = [bytes([c]) for c in (32, 9, 10, 11, 12, 13)]
WINDOW = 5
#: Scores are compared in steps of 1 / STEPS when the threshold is calibrated.
STEPS = 1000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The statistics that the forest sees.
FEATURES = ["word_length", "symbols_a_word", "dup_lines", "repeats", "capitals", "exclamations", "digits", "bars"]

_FACTORS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def statistics(raw: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts of a UTF-8 text and the forest's statistics."""
    from xxhash import xxh3_64_intdigest

    raw = raw or b""
    words = raw.split()
    n = len(words)
    octets = np.frombuffer(raw, np.uint8)
    word_chars = int(np.count_nonzero(octets & 0xC0 != 0x80)) - sum(map(raw.count, SPACES))
    symbols = sum(map(raw.count, SYMBOLS))
    lines, seen, copies = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                copies += 1
            else:
                seen.add(line)
    repeated = 0
    if n >= WINDOW:
        hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
        count = n - WINDOW + 1
        with np.errstate(over="ignore"):
            total = np.zeros(count, np.uint64)
            for k in range(WINDOW):
                total += hashes[k : k + count] * _FACTORS[k]
            total = mix(total)
        order = np.sort(total)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            found = np.isin(total, twice)
            covered = np.zeros(n, bool)
            for k in range(WINDOW):
                covered[k : k + count] |= found
            repeated = int(covered.sum())
    capitals = int(np.count_nonzero(octets - np.uint8(65) < 26))
    small = int(np.count_nonzero(octets - np.uint8(97) < 26))
    digits = int(np.count_nonzero(octets - np.uint8(48) < 10))
    some = max(n, 1)
    features = [
        word_chars / some, symbols / some, copies / max(lines, 1), repeated / some, capitals / max(capitals + small, 1),
        raw.count(b"!") / some, digits / max(word_chars, 1), raw.count(b"|") / some,
    ]
    return [n, word_chars, symbols, copies, repeated], features


# ---------------------------------------------------------------- the forest


class Forest:
    """Isolation trees as arrays: a node's feature (-1: leaf), split value, left child, and path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 0):
        random = np.random.default_rng(seed)
        self.feature, self.value, self.left, self.length, self.roots = [], [], [], [], []
        size = min(tree_rows, len(rows))
        depth = max(1, math.ceil(math.log2(max(size, 2))))
        self.usual = _usual_length(size)
        for _ in range(trees if size > 1 else 0):
            self.roots.append(self._grow(rows[random.choice(len(rows), size, replace=False)], depth, random))
        self.feature, self.left = np.array(self.feature, np.int32), np.array(self.left, np.int32)
        self.value, self.length = np.array(self.value), np.array(self.length)
        self.depth = depth

    def _grow(self, rows: np.ndarray, depth: int, random) -> int:
        root = len(self.feature)
        self._add()
        todo = [(root, rows, 0)]
        while todo:
            node, rows, at = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            splits = np.flatnonzero(high > low)
            if at == depth or not len(splits):
                self.length[node] = at + _usual_length(len(rows))
                continue
            f = int(random.choice(splits))
            cut = random.uniform(low[f], high[f])
            goes = rows[:, f] < cut
            if not goes.any():  # the cut met the least value
                cut, goes = high[f], rows[:, f] < high[f]
            self.feature[node], self.value[node], self.left[node] = f, cut, len(self.feature)
            self._add()
            self._add()
            todo += [(self.left[node], rows[goes], at + 1), (self.left[node] + 1, rows[~goes], at + 1)]
        return root

    def _add(self) -> None:
        for column, start in ((self.feature, -1), (self.value, 0.0), (self.left, 0), (self.length, 0.0)):
            column.append(start)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1: near 1 for rows that random splits isolate at once, about a half for usual ones."""
        if not self.roots or not len(rows):
            return np.zeros(len(rows))
        total, all_rows = np.zeros(len(rows)), np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root, np.int32)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                right = rows[all_rows, np.maximum(f, 0)] >= self.value[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.length[node]
        return 2.0 ** (-total / len(self.roots) / max(self.usual, 1e-9))


def _usual_length(n: int) -> float:
    """The mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def best_threshold(counts: list[tuple[int, int, int]], keep: float) -> float:
    """counts: step of the score, label (1 good), rows. The score from which a row is anomalous."""
    good, bad = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    for step, label, n in counts:
        (good if label else bad)[step] += n
    if not good.sum() or not bad.sum():
        return 1.0
    kept = np.concatenate(([0], np.cumsum(good)))[:-1] / good.sum()  # good rows below each step
    dropped = 1 - np.concatenate(([0], np.cumsum(bad)))[:-1] / bad.sum()
    value = np.where(kept >= keep, kept + dropped, -1)
    return int(np.argmax(value)) / STEPS


# ---------------------------------------------------------------- over documents


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, the base counts, base_failed, and the array `features`."""

    def count(batches):
        import pyarrow as pa

        for batch in common.pieces_of(batches):
            made = [statistics(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [batch.column("doc_id"), *(pa.array([m[0][k] for m in made], pa.int64()) for k in range(5))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["doc_id", *BASE, "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", features array<double>")
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def grow_forest(measured: DataFrame) -> Forest:
    """A forest of documents that pass the base rules."""
    drawn = common.draw(measured.filter("not base_failed").select("doc_id", "features"), TREES * TREE_ROWS)
    rows = drawn.select("features").toArrow().column("features").combine_chunks()
    return Forest(rows.flatten().to_numpy().reshape(-1, len(FEATURES)))


def add_scores(measured: DataFrame, forest: Forest) -> DataFrame:
    held = measured.sparkSession.sparkContext.broadcast(forest)  # bounded by TREES and TREE_ROWS
    columns = [c for c in measured.columns if c != "features"]

    def score(batches):
        import pyarrow as pa

        for batch in batches:  # numbers alone: a batch is small
            rows = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield batch.select(columns).append_column("anomaly", pa.array(held.value.scores(rows)))

    return measured.mapInArrow(score, measured.select(columns).schema.add("anomaly", "double"))


def judge(docs: DataFrame, labels: DataFrame, keep: float = 0.97, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """A row per row of docs: doc_id, the base counts, base_failed, kept, anomaly."""
    measured = common.stage(measure(docs, id_col, text_col), "rules")
    scored = common.stage(add_scores(measured, grow_forest(measured)), "anomalies")
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").distinct()
    steps = scored.filter("not base_failed").select("doc_id", F.floor(F.col("anomaly") * STEPS).cast("int").alias("step"))
    counts = steps.join(marks, "doc_id").groupBy("step", "label").count().collect()  # STEPS rows at most, twice
    limit = best_threshold([tuple(r) for r in counts], keep)
    kept = ~F.col("base_failed") & (F.floor(F.col("anomaly") * STEPS) / STEPS < limit)
    return scored.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "anomaly")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels"))
