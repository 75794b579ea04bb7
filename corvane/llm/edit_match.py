"""Benchmark decontamination by approximate matching: pigeonhole pieces, then Myers' algorithm.

A test item of n characters may differ from a passage of a document by `rate * n` edits. Cut into one
piece more than that budget, at least one piece of it stands in the passage unchanged. Aho-Corasick
finds all pieces of all items in one pass over a text; around each hit Myers' bit-parallel algorithm
finds the least edit distance of the item to any passage there, so the result is exact.

Items and texts are compared in lower case, with runs of white space as one space; positions are
places in that form of the text, in code points.

Items are held in memory in blocks of about `block_bytes`, each for one pass over the documents, so a
test set of any size is used whole; where there are several, what a pass found is written before the
next block is read, and the block given up.

An item of fewer than 1 / rate characters (20) has no edits to spend: it is found wherever it stands
unchanged, inside longer words as well.

Defined results: an item without text, or with white space alone, matches nothing. A null or empty
text has no matches. Items with equal texts all match; rows with equal ids each have their matches.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE = 0.05
BLOCK_BYTES = 1 << 24


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def search(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and the first end of such a substring.

    anchored: to substrings from the text's start only.
    """
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    m, full, top = len(pattern), (1 << len(pattern)) - 1, len(pattern) - 1
    plus, minus, score, best, end = full, 0, m, m, 0
    get = masks.get
    for at, c in enumerate(text, 1):
        equal = get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        score += (up >> top & 1) - (down >> top & 1)
        up = (up << 1 | anchored) & full
        plus = (down << 1 | ~(vertical | up)) & full
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


class ItemIndex:
    """The pieces of a block of items, for one pass over texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items: dict[str, list[int]] = defaultdict(list)
        for item, text in items:
            if text := normal(text):
                self.items[text].append(item)
        self.texts = list(self.items)
        self.budgets = [int(len(t) * rate) for t in self.texts]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (text, budget) in enumerate(zip(self.texts, self.budgets, strict=True)):
            pieces = min(budget + 1, len(text))
            for k in range(pieces):
                start, end = k * len(text) // pieces, (k + 1) * len(text) // pieces
                places[text[start:end]].append((i, start))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Item and the bounds of the stretches of text that may hold it; overlapping ones are joined."""
        if not self.texts:
            return
        starts = defaultdict(set)
        for last, (n, where) in self.pieces.iter(text):
            for i, offset in where:
                starts[i].add(last - n + 1 - offset)
        for i, found in starts.items():
            budget, n, low, high = self.budgets[i], len(self.texts[i]), None, -1
            for start in sorted(found):
                if low is None or start - budget > high:
                    if low is not None:
                        yield i, low, high
                    low = max(0, start - budget)
                high = min(len(text), start + n + budget)
            yield i, low, high

    def matches(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """item, edits, start, end of the best passage for each item within its budget."""
        text, best = normal(text), {}
        for i, low, high in self.windows(text):
            item, window = self.texts[i], text[low:high]
            at = window.find(item)
            edits, end = (0, at + len(item)) if at >= 0 else search(item, window)
            if edits <= self.budgets[i] and (i not in best or edits < best[i][0]):
                best[i] = (edits, low, low + end)
                if first_only:
                    break
        out = []
        for i, (edits, low, end) in best.items():
            _, back = search(self.texts[i][::-1], text[low:end][::-1], True) if edits else (0, len(self.texts[i]))
            out += [(item, edits, end - back, end) for item in self.items[self.texts[i]]]
        return sorted(out)


_INDEXES: dict[tuple, ItemIndex] = {}


def _index(block, rate: float) -> ItemIndex:
    """One index a process and block."""
    name, items = block.value
    key = (os.getpid(), name, rate)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = ItemIndex(items, rate)
    return _INDEXES[key]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator:
    """Broadcasts of the items, of about block_bytes each, with a name."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for k in range(count):
        block = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) if count > 1 else rows
        found = sorted((tuple(r) for r in block.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        held = items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, found))
        held.alone = count == 1
        yield held


def _settled(part: DataFrame, block) -> DataFrame:
    """The result of a block's pass; written, and the block given up, unless it is the only one."""
    if block.alone:
        return part
    part = common.stage(part, "pass")
    block.destroy()
    return part


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and item that it holds: doc_id, item_id, edits, match_start, match_end."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text, block_bytes):

        def find(batches, block=block):
            import pyarrow as pa

            index = _index(block, rate)
            names = ["doc_id", "item_id", "edits", "match_start", "match_end"]
            for batch in common.pieces_of(batches):
                found = [(doc, *m) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in index.matches(text)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)], names)

        part = _settled(rows.mapInArrow(find, "doc_id long, item_id long, edits long, match_start long, match_end long"), block)
        out = part if out is None else out.unionByName(part)
    return out


def without_items(docs: DataFrame, items: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    for block in _blocks(items, item_id, item_text, block_bytes):
        at = docs.columns.index(text_col)

        def clean(batches, block=block, at=at):
            import pyarrow as pa

            index = _index(block, rate)
            for batch in common.pieces_of(batches, text_col):
                keep = [not index.matches(x.as_py(), first_only=True) for x in batch.column(at)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = _settled(docs.mapInArrow(clean, docs.schema), block)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))
