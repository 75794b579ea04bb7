"""Packing: documents' token ids into sequences of a fixed size, by first-fit decreasing.

Each document is cut into whole sequences and a rest. A whole sequence is a sequence of its own. The
rests of a group are placed in decreasing order of length, each into the first sequence with room: a
tournament tree over the sequences' free room finds it in logarithmic time. Groups are randomised: a
rest's group comes from a hash of its task and place, so no id, source or group of copies gathers in
one, and their number follows the number of documents, so a group is bounded. Each group leaves at
most a few sequences that are not full. The pieces are written before they are packed, so that what
a task dealt stays, whatever order a repeated task would see.

Defined results: a null text is an empty one, and a document without ids still has its end id.
Rows with equal document ids are packed each for itself; a null document id stays null.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokenize import encoder, with_end

SEQUENCE = 1024
#: Documents in a group, on average; with their rests this is what one task holds.
GROUP_DOCS = 8192

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"


class Tournament:
    """Bins of equal capacity. A node holds the largest free room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put a piece into the first bin with room; its number and what it held before is returned."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        free = room[node]
        room[node] = free - length
        found = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found, free


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity); equal lengths are placed in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = Tournament(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], free = tree.place(int(lengths[i]))
        offsets[i] = capacity - free
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer: str, groups: int, sequence: int = SEQUENCE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts and cut them: a row per piece, with its checksum, and the group (a rest's) or the sequence that it is in."""

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        row = whole = 0
        for batch in common.pieces_of(batches):
            ids, sizes = with_end(*coder.encode(batch.column("text")), end_id)
            # a hash of task and place, by the finaliser of SplitMix64
            with np.errstate(over="ignore"):
                z = np.uint64(task << 40) + np.arange(row, row + len(sizes), dtype=np.uint64)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                dealt = ((z ^ (z >> np.uint64(31))) % np.uint64(groups)).astype(np.int64)
            row += len(sizes)
            pieces = -(-sizes // sequence)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * sequence
            length = np.minimum(sizes[owner] - start, sequence)
            ends = np.cumsum(length)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            full = length == sequence
            # the whole sequences of a task are numbered like those of a group behind all others
            own = (np.int64(groups + task) << 32) + whole + np.cumsum(full) - full
            whole += int(full.sum())
            columns = [
                batch.column("id").take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(sizes[owner]),
                pa.array(dealt[owner], mask=full), pa.array(own, pa.int64(), mask=~full),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group", "sequence_id", *["ids"] * with_ids])
            del ids, raw
            common.release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.stage(rows.mapInArrow(cut, PIECES + ", group long, sequence_id long" + ", ids array<int>" * with_ids), "pieces")


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Give each rest its sequence and offset, group by group. Other columns of pieces stay."""

    def place(table):
        import pyarrow as pa

        # the order of rows in a group isn't fixed: sort, so that a repeated task gives the same result
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(lengths, sequence)
        first = table.column("group")[0].as_py() << 32
        return table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    rests = pieces.filter("sequence_id is null").drop("sequence_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rests.schema.fields)
    placed = rests.groupBy("group").applyInArrow(place, schema + ", sequence_id long, offset long").drop("group")
    whole = pieces.filter("sequence_id is not null").drop("group").withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = 0, group_docs: int = GROUP_DOCS, **columns) -> DataFrame:
    groups = max(1, -(-docs.count() // group_docs))
    return pack_pieces(cut_documents(docs, tokenizer, groups, sequence, end_id, **columns), sequence)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
