"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's n-grams of one to three characters (in lower case) are hashed into BUCKETS features. A feature's value is
its share of the text's n-grams times its inverse document frequency; as the model is linear, a
text's score is then a plain mean over its n-grams. Weights are trained by follow-the-regularised-
leader with an elastic net, which leaves most of them zero, and the probabilities are calibrated by
a temperature on rows that training didn't see.

Document frequencies count every learnable document. Weights are fitted on SAMPLE labelled rows at
most, drawn by a hash of id, language and text, equal rows once.

Defined results: a null text or one without letters gives `und` with score 0, as does any text where
no labelled row could be learned from. Equal scores go to the language first in the alphabet. Rows
with equal ids are predicted each by its own text; a row without id is not held out, nor learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .odd_sketch import mix

BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
SAMPLE = 4096
#: Values are multiplied by this, so that weights are of the order of one.
SCALE = 10.0
UNKNOWN = "und"

#: Characters of a text that are taken apart at a time.
STRETCH = 1 << 20

_LETTER = re.compile(r"[^\W\d_]").search
_FACTORS = [np.uint64(x) for x in mix(np.arange(1, max(LENGTHS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)]


def grams(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, with repeats, by stretches of the text."""
    text, over = text.lower(), max(LENGTHS) - 1
    for start in range(0, len(text), STRETCH):
        back = min(start, over)  # n-grams that begin in the stretch before
        points = np.frombuffer(text[start - back : start + STRETCH].encode("utf-32-le"), "<u4").astype(np.uint64)
        found = []
        with np.errstate(over="ignore"):
            total = np.zeros(len(points), np.uint64)
            for k in range(max(LENGTHS)):
                if len(points) <= k:
                    break
                total = total[: len(points) - k] + points[k:] * _FACTORS[k]
                if k + 1 in LENGTHS:
                    z = (total[max(back - k, 0) :] ^ (total[max(back - k, 0) :] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
                    found.append((z >> np.uint64(48)).astype(np.int32))
        yield np.concatenate(found)


def train(rows: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS, classes) and biases by follow-the-regularised-leader (proximal) with L1 and L2."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        lead = z[at]
        return np.where(np.abs(lead) <= l1, 0.0, -(lead - np.sign(lead) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, value = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)  # the last is the bias
            w = weights(at)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[marks[i]] -= 1
            g = value[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def temperature(scores: np.ndarray, marks: np.ndarray) -> float:
    """The divisor of the scores under which the true classes are likeliest."""
    if not len(scores):
        return 1.0

    def loss(t):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), marks]).mean()

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, divisor: float):
        self.languages, self.table, self.bias, self.divisor = languages, table.astype(np.float32), bias, divisor

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in grams(text):
            total += self.table[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return self.bias + total / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER(text):
            return UNKNOWN, 0.0
        s = self.scores(text) / self.divisor
        p = np.exp(s - s.max())
        best = int(np.argmax(p))
        return self.languages[best], float(p[best] / p.sum())


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Of every row's text: how many hold each bucket; how many there are. Reduced to BUCKETS rows."""

    def count(batches):
        import pyarrow as pa

        total, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in common.pieces_of(batches):
            for text in batch.column("text").to_pylist():
                seen = np.zeros(BUCKETS, bool)
                for found in grams(text):
                    seen[found] = True
                total += seen
                docs += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], ["bucket", "n"])

    counted = rows.select("text").filter("text is not null").mapInArrow(count, "bucket long, n long")
    frequency, docs = np.zeros(BUCKETS), 0
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            docs = n
        else:
            frequency[bucket] = n
    return frequency, docs


def _sample(rows: DataFrame, size: int) -> list:
    """lang, buckets and counts of at most `size` distinct rows of (doc_id, lang, text)."""

    def count(batches):
        import pyarrow as pa

        for batch in common.pieces_of(batches):
            made = []
            for text in batch.column("text").to_pylist():
                total = sum((np.bincount(g, minlength=BUCKETS) for g in grams(text)), np.zeros(BUCKETS, np.int64))
                at = np.flatnonzero(total)
                made.append((at.astype(np.int32), total[at].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int32())), batch.column("h")], ["lang", "buckets", "counts", "h"]
            )

    labelled = rows.filter("lang is not null and text is not null and doc_id is not null")
    drawn = common.draw(labelled, size).mapInArrow(count, "lang string, buckets array<int>, counts array<int>, h long")
    found = drawn.toArrow().sort_by("h").combine_chunks()
    if not found.num_rows:
        return []
    # views of the columns, not Python numbers: a driver has little memory
    cut = lambda name: np.split(found.column(name).chunk(0).flatten().to_numpy(), found.column(name).chunk(0).offsets.to_numpy()[1:-1])
    return [{"lang": lang, "buckets": at, "counts": n} for lang, at, n in zip(found.column("lang").to_pylist(), cut("buckets"), cut("counts"), strict=True)]


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows of docs that common.learnable() allows."""
    rows = docs.filter(common.learnable(id_col)).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    drawn = _sample(rows, sample)
    languages = sorted({r["lang"] for r in drawn})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    frequency, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    marks = np.array([languages.index(r["lang"]) for r in drawn])
    vectors = []
    for r in drawn:
        at, counts = r["buckets"], r["counts"]
        vectors.append((at, (SCALE * idf[at] * counts / max(counts.sum(), 1)).astype(np.float32)))
    apart = np.arange(len(drawn)) % 5 == 4  # for the temperature
    w, bias = train([v for v, a in zip(vectors, apart, strict=True) if not a], marks[~apart], len(languages))
    scores = np.array([v @ w[at] + bias for (at, v), a in zip(vectors, apart, strict=True) if a]).reshape(-1, len(languages))
    return Model(languages, SCALE * idf[:, None] * w, bias, temperature(scores, marks[apart]))


def add_language(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its probability; columns of these names are replaced, all others pass through."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one number a language

    def predict(texts):
        import pyarrow as pa

        made = [held.value.predict(x.as_py()) for x in texts]
        return pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())

    return common.with_columns(docs, text_col, dict(zip(names, ("string", "double"), strict=True)), predict)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = add_language(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")
