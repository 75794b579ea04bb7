"""Token counts of a unigram tokenizer by a Viterbi pass that keeps counts alone.

Aho-Corasick enumerates all vocabulary pieces that end at each place; dynamic programming carries
the best score to each place and the number of pieces on the way there, so that no segmentation is
ever built. Ties fall as in the tokenizers library's Unigram model: of equal scores the piece that
starts first wins, and an unknown character, at ten below the least score, is tried last and only
where no piece of one character stands. Unknown characters count as their bytes if the vocabulary
has byte pieces, else a run of them counts as one.

Spaces become `▁`, one stands before the text, and no piece crosses into the next word, as with the
library's Metaspace; words are thus independent, and the results of the frequent ones are remembered.

Defined results: a null or empty text has no tokens and score 0. Every row is counted by its own text.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, capacity: int = 400_000):
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        known = {p for p, _ in vocabulary}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.capacity, self.kept = capacity, {}

    def word(self, text: str) -> complex:
        """The best score (real part) and the count (imaginary part): added up as one number."""
        n = len(text)
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        hits = self.pieces.iter(text)
        last, found = next(hits, (n, None))
        for end in range(1, n + 1):
            top, single = None, False
            while last == end - 1:  # pieces that end here, the longest first
                size, score = found
                candidate = best[end - size] + score
                if top is None or candidate > top:
                    top, count[end] = candidate, count[end - size] + 1
                single |= size == 1
                last, found = next(hits, (n, None))
            if not single:
                candidate = best[end - 1] + self.unknown
                if top is None or candidate > top:
                    top, open_run[end] = candidate, True
                    count[end] = count[end - 1] + (len(text[end - 1].encode()) if self.bytes else not open_run[end - 1])
            best[end] = top
        return complex(best[n], count[n])

    def count(self, text: str | None) -> tuple[int, float]:
        """The number of tokens and the best score of a whole text."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", SPACE)
        words = text.split(SPACE)
        if text[0] == SPACE:
            del words[0]  # there is a space before the text already
        found = list(map(self.kept.get, words))
        if None in found:
            fresh = {w: self.word(SPACE + w) for w, x in zip(words, found, strict=True) if x is None}
            found = [fresh[w] if x is None else x for w, x in zip(words, found, strict=True)]
            if len(self.kept) + len(fresh) <= self.capacity:
                self.kept.update((w, x) for w, x in fresh.items() if len(w) <= 64)
            elif len(fresh) > len(words) // 2:
                self.kept.clear()
        total = sum(found)
        return int(total.imag), total.real


_COUNTERS: dict[tuple, UnigramCounter] = {}


def _counter(held) -> UnigramCounter:
    name, vocabulary, byte_fallback = held.value
    key = (os.getpid(), name)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = UnigramCounter(vocabulary, byte_fallback)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, score."""
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary, byte_fallback))  # a tokenizer's vocabulary

    def count(batches):
        import pyarrow as pa

        counter = _counter(held)
        for batch in common.pieces_of(batches):
            made = [counter.count(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long, score double")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.load(spark, sf_dir, "documents"), sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
