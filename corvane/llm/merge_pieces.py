"""Encoding and decoding with a merge-type (BPE) SentencePiece model, exactly as the sentencepiece library does it.

The merge rule joins, again and again, the two neighbours whose joined piece scores highest, the
leftmost of equals. A sequence of pieces is what this rule makes of a text if and only if each two
neighbours are what it makes of just their characters. So no merge is carried out on a text:
Aho-Corasick gives the longest piece that starts at each place, and a walk from the left takes it
if it is compatible with the piece before it; that is decided by merging the characters of both
again, and remembered by pair. If not, the next shorter piece that starts there is tried; if none
is left, the place is marked as failed in a bitfield, so that no other way leads there again, and
the walk goes back by one piece. Pieces that the rule can't build are never candidates; single
characters always are. A character without a piece becomes its bytes, or the unknown id, a run of
which counts once.

The library's normaliser runs first. Where no piece holds a `▁` behind another character (checked),
text before a `▁` never joins what follows: such stretches are encoded one by one, frequent ones from
memory. Pieces that a user defined are kept whole, the longest first, as the library does.

Defined results: a null text counts as empty; an empty text has the end id alone. Every row is encoded
by itself, whole. A text's ids stand in memory once while it is encoded. Models with unused pieces are refused.
"""

from __future__ import annotations

import os
import re
import uuid
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from . import common

SPACE = "▁"


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The merge rule itself, on a short text."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Backtracker:
    """Splits a stretch of text into the pieces that the merge rule makes of it."""

    def __init__(self, scores: dict[str, float], capacity: int = 1_000_000):
        import ahocorasick

        self.scores, self.capacity, self.pairs = scores, capacity, {}
        built = [p for p in scores if len(p) > 1 and merge(p, scores) == [p]]
        self.pieces = ahocorasick.Automaton()
        for p in built:
            self.pieces.add_word(p, len(p))
        if built:
            self.pieces.make_automaton()
        known = set(built)
        #: Of each piece the length of the longest shorter piece that it begins with.
        self.shorter = {p: next((n for n in range(len(p) - 1, 1, -1) if p[:n] in known), 1) for p in built}

    def compatible(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.capacity:
                self.pairs.clear()
            known = self.pairs[pair] = merge(left + right, self.scores) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        n = len(text)
        longest = [1] * n
        if self.shorter:
            for end, size in self.pieces.iter(text):
                start = end - size + 1
                if size > longest[start]:
                    longest[start] = size
        failed = bytearray(n // 8 + 1)  # a bit for each place
        out: list[str] = []
        at, size = 0, longest[0] if n else 0
        while at < n:
            piece, end = text[at : at + size], at + size
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                at, size = end, longest[end] if end < n else 0
            elif size > 1:
                size = self.shorter[piece]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                size = len(out.pop())
                at -= size
        return out


class PieceCodec:
    """The ids of whole texts, and texts of ids."""

    def __init__(self, model: bytes, capacity: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in ids if sp.is_byte(i)}
        self.tracker = Backtracker({p: sp.get_score(i) for p, i in self.ids.items()})
        own = sorted(_user_defined(model), key=len, reverse=True)
        stretch = "|".join(map(re.escape, own))
        #: Stretches that no piece crosses: up to the next run of spaces where pieces hold none inside, else whole.
        inner = f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) else "(?s:.+)"
        self.own, self.fixed, self.stretches = set(own), re.compile(f"({stretch})") if own else None, re.compile(inner)
        self.capacity, self.kept = capacity, {}

    def stretch(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.tracker.split(text):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.library.unk_id())
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without an end id."""
        text = self.library.normalize(text or "")
        parts = [text] if self.fixed is None else self.fixed.split(text)
        out: list[int] = []
        for part in parts:
            if part in self.own:
                out.append(self.ids[part])
                continue
            words = self.stretches.findall(part)
            found = list(map(self.kept.get, words))
            if None in found:
                fresh = {w: self.stretch(w) for w in {w for w, x in zip(words, found, strict=True) if x is None}}
                found = [fresh[w] if x is None else x for w, x in zip(words, found, strict=True)]
                if len(self.kept) + len(fresh) <= self.capacity:
                    self.kept.update((w, x) for w, x in fresh.items() if len(w) <= 64)
                elif len(fresh) > len(words) // 2:
                    self.kept.clear()
            out.extend(chain.from_iterable(found))
        if not self.bytes and self.library.unk_id() in out:
            unknown = self.library.unk_id()
            out = [x for i, x in enumerate(out) if x != unknown or not i or out[i - 1] != unknown]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _user_defined(model: bytes) -> list[str]:
    from sentencepiece import sentencepiece_model_pb2 as messages

    proto = messages.ModelProto.FromString(model)
    if proto.trainer_spec.model_type != messages.TrainerSpec.BPE:
        raise ValueError("only models of the merge type (BPE) are supported")
    return [p.piece for p in proto.pieces if p.type == messages.ModelProto.SentencePiece.USER_DEFINED]


_CODECS: dict[tuple, PieceCodec] = {}


def _codec(held) -> PieceCodec:
    name, model = held.value
    key = (os.getpid(), name)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model: bytes, end: bool = True, decode: bool = True, text_col: str = "text") -> DataFrame:
    """docs with `ids` (array of int, the end id last if asked for) and `decoded` (the text that the library's decode makes of them); columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))  # a tokenizer's model

    def compute(texts):
        import pyarrow as pa

        codec = _codec(held)
        tail = [codec.library.eos_id()] if end else []
        ids = [codec.encode(t) + tail for t in texts.to_pylist()]
        made = [pa.array(ids, pa.list_(pa.int32()))]
        return [*made, pa.array([codec.decode(x) for x in ids], pa.string())] if decode else made

    return common.with_columns(docs, text_col, {"ids": ArrayType(IntegerType())} | ({"decoded": StringType()} if decode else {}), compute)


def op12_merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda c: F.sha2(c, 256)
    return encode_documents(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256")
    )
