"""Toxicity: a linear classifier on words, regularised by counterfactuals.

A document's features are its distinct words (letters alone, in lower case for A-Z). Logistic regression
with an L1 penalty is fitted on labelled rows. In each sentence of a labelled row that names a group,
each of its identity terms is swapped for others of the same kind; the squared change of the score is
penalised as well, so that a group's mention moves the score no more than another's, whatever the
labels say. Terms that stand for groups are moreover shrunk towards no effect, which keeps neutral
mentions clean.

Weights are fitted on SAMPLE labelled rows at most, drawn by a hash of ids, then of id, label and text,
equal rows once. Every row is scored by its whole text.

Defined results: a null or empty text has the score of a text without known words. Without labelled
rows of both kinds every score is the share of toxic rows (0 if there is none). Rows with equal ids
are scored each by its own text; labels of equal ids that differ count as toxic.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE = 6000
#: A word is a feature if so many sampled rows have it.
LEAST_ROWS = 4
THRESHOLD = 0.3

#: Terms that name groups, by kind. Those of a kind are swapped for one another.
IDENTITY_TERMS = {
    "gender": ["man", "woman", "men", "women", "male", "female", "boy", "girl", "transgender", "nonbinary"],
    "religion": ["christian", "jewish", "muslim", "hindu", "buddhist", "atheist", "catholic", "christians", "jews", "muslims", "hindus", "buddhists", "atheists", "catholics"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"],
    "origin": ["african", "american", "asian", "european", "arab", "latino", "mexican", "chinese", "indian", "russian", "immigrant", "immigrants", "refugee", "refugees"],
    "colour": ["black", "white", "brown"],
    "age": ["young", "old", "elderly", "teenager", "teenagers"],
    "ability": ["blind", "deaf", "disabled", "autistic"],
}

_TERMS = {t.encode() for kind in IDENTITY_TERMS.values() for t in kind}

#: ASCII letters in lower case, other bytes of UTF-8 as they are, anything else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Punctuation of Latin-1 and of the block for general punctuation, in UTF-8.
_MARKS = re.compile(rb"\xc2[\x80-\xbf]|\xe2\x80[\x80-\xbf]|\xe2\x81[\x80-\xaf]")
_SENTENCE_END = re.compile(rb"[.!?\n]+")
#: Bytes of a text that are split at a time.
STRETCH = 1 << 22


def _letters(raw: bytes) -> bytes:
    return (raw if raw.isascii() else _MARKS.sub(b" ", raw)).translate(_LETTERS)


def words(raw: bytes | None) -> set[bytes]:
    raw, found, at = raw or b"", set(), 0
    while len(raw) - at > STRETCH and (end := raw.find(b" ", at + STRETCH)) >= 0:
        found.update(_letters(raw[at:end]).split())
        at = end
    found.update(_letters(raw[at:]).split())
    return found


def mentions(raw: bytes | None) -> list[list[str]]:
    """Of each sentence that has some, its identity terms."""
    found = (words(s) & _TERMS for s in _SENTENCE_END.split(raw or b""))
    return [sorted(t.decode() for t in terms) for terms in found if terms]


def swaps(found: set[str]) -> list[tuple[str, str]]:
    """Each identity term of a sentence with each other term of its kind that the sentence hasn't."""
    return [(a, b) for kind in IDENTITY_TERMS.values() for a in kind if a in found for b in kind if b not in found]


def fit_weights(rows: list[set[str]], toxic: np.ndarray, named: list[list[str]] | None = None, **settings) -> tuple[dict[str, float], float]:
    """fit_encoded of rows given as sets of words; named: the identity terms of each sentence, by default of each row."""
    names = sorted(set().union(*rows)) if rows else []
    place = {w: i for i, w in enumerate(names)}
    flat = np.fromiter((place[w] for row in rows for w in sorted(row)), np.int64)
    every = {t.decode() for t in _TERMS}
    named = [sorted(row & every) for row in rows] if named is None else named
    return fit_encoded(names, flat, np.array([len(row) for row in rows], np.int64), toxic, named, **settings)


def fit_encoded(names, flat: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, named: list[list[str]], l1: float = 0.5, fairness: float = 5.0, steps: int = 400) -> tuple[dict[str, float], float]:
    """Word weights (those that aren't zero) and the bias, by accelerated proximal gradient.

    Rows are places in `names` (a list or Arrow array), one row after another. Minimised: the sum of
    log losses + l1 * |weights| + fairness / 2 * (the squared score changes of all swaps in sentences
    + the squared weights of the identity terms that occur).
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        return {}, -40.0 if share == 0 else 40.0
    rows = len(sizes)
    enough = np.flatnonzero(np.bincount(flat, minlength=len(names)) >= LEAST_ROWS)
    frequent = sorted((str(names[i]), i) for i in enough.tolist())
    vocabulary, none = [w for w, _ in frequent], len(frequent)  # a word that isn't a feature has weight 0
    column = np.full(len(names), none)
    column[[i for _, i in frequent]] = np.arange(none)
    place = {w: i for i, w in enumerate(vocabulary)}
    terms = np.array([place[t] for kind in IDENTITY_TERMS.values() for t in kind if t in place], np.int64)
    flat, owner = column[flat], np.repeat(np.arange(rows), sizes)
    flat, owner = flat[flat < none], owner[flat < none]
    sizes = np.bincount(owner, minlength=rows)

    pairs: dict[tuple[int, int], int] = {}
    for sentence in named:
        for a, b in swaps(set(sentence)):
            key = (place.get(a, none), place.get(b, none))
            pairs[key] = pairs.get(key, 0) + 1
    first = np.array([p[0] for p in pairs], np.int64)
    second = np.array([p[1] for p in pairs], np.int64)
    times = np.array(list(pairs.values()), float)

    used = np.bincount(flat, minlength=none).astype(float)
    # a bound on the curvature of each coordinate, from the longest rows that it occurs in
    curve = np.zeros(none)
    np.maximum.at(curve, flat, np.minimum(sizes, 400)[owner] ** 0.5)
    curve = 0.25 * used * np.maximum(curve, 1) + 1e-3
    if len(times):
        degree = np.bincount(first, times, none + 1) + np.bincount(second, times, none + 1)
        curve += 2 * fairness * degree[:none]
    curve[terms] += fairness
    w, bias = np.zeros(none + 1), np.log(share / (1 - share))
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    for _ in range(steps):
        score = np.bincount(owner, ahead[flat], rows) + ahead_bias
        error = 1 / (1 + np.exp(-score)) - toxic
        g = np.bincount(flat, error[owner], none)
        if len(times):
            change = times * (ahead[first] - ahead[second]) * fairness
            g += (np.bincount(first, change, none + 1) - np.bincount(second, change, none + 1))[:none]
        g[terms] += fairness * ahead[terms]
        step = ahead[:none] - g / curve
        new = np.append(np.sign(step) * np.maximum(np.abs(step) - l1 / curve, 0), 0.0)
        new_bias = ahead_bias - error.sum() / rows
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, ahead_bias = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    return {v: float(x) for v, x in zip(vocabulary, w, strict=False) if x}, float(bias)


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = {k.encode(): v for k, v in weights.items()}, bias

    def score(self, raw: bytes | None) -> float:
        z = self.bias + sum(sorted(self.weights[w] for w in words(raw) & self.weights.keys()))
        return 1 / (1 + np.exp(-min(max(z, -60.0), 60.0)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """Learn from at most `sample` of the labelled rows that common.learnable() allows."""
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("toxic in (0, 1)")
    marks = marks.filter(common.learnable()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = common.draw(marks, sample).drop("h")  # bounded by `sample`, so it may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def split(batches):
        import pyarrow as pa

        for batch in common.pieces_of(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = [sorted(w.decode(errors="replace") for w in words(x)) for x in texts]
            columns = [pa.array(made, pa.list_(pa.string())), pa.array([mentions(x) for x in texts], pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), *columns], ["h", "toxic", "words", "named"])

    joined = common.stage(rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text"), "labelled")
    made = common.draw(joined, sample).mapInArrow(split, "h long, toxic int, words array<string>, named array<array<string>>")
    found = made.toArrow().sort_by("h").combine_chunks()
    if not found.num_rows:
        return Model(*fit_weights([], np.empty(0)))
    lists = found.column("words").chunk(0)
    encoded = lists.flatten().dictionary_encode()  # as numbers: a driver has little memory
    named = found.column("named").chunk(0).flatten().to_pylist()
    return Model(*fit_encoded(encoded.dictionary, encoded.indices.to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()), found.column("toxic").to_numpy().astype(float), named))


def add_toxicity(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of the toxic label; a column of this name is replaced, all others pass through."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # weights of words of the bounded sample

    def score(texts):
        import pyarrow as pa

        return (pa.array([held.value.score(x) for x in texts.cast(pa.binary()).to_pylist()], pa.float64()),)

    return common.with_columns(docs, text_col, {name: "double"}, score)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = add_toxicity(docs, fit(docs, common.load(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
