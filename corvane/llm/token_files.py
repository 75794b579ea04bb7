"""Token ids on disk: Simple-8b words with escapes and per-block offsets.

A file is a run of frames, each followed by TRAILER. A frame holds whole documents:

    magic, documents, ids, blocks, words, escapes      HEADER
    document ids        int64 a document
    nulls               one byte a document, 1 where the id is null
    ids a document      int64 a document
    block offsets       uint32 a block and one more: the block's first word
    escapes             uint64 each
    words               uint64 each

The ids of a frame form blocks of BLOCK; each block's words can be decoded alone. The lowest four
bits of a word are its selector, which says how many values of how many bits the other 60 hold.
The last selector holds the place, in the frame's escapes, of one id that no other selector suits:
of 2**30 or more, or just before such an id.
A block's last word may have room left; it holds zeros, and BLOCK says how many ids count.

Defined results: a null text is an empty one, a document without ids has the end id alone, rows
with equal document ids stay apart (in the order of their texts' hashes), a null document id comes first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokenize import encoder, with_end

#: Fixed values of the file format.
MAGIC, TRAILER = b"CVT1", b"\nend\n"
HEADER = struct.Struct("<4sIQIII")
BLOCK = 256
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15

#: A frame is closed when it has so many ids; a longer document has a frame of its own.
FRAME_IDS = 1 << 18
#: A file is closed after so many frames: about 64 MB of ids of two bytes each.
FILE_FRAMES = 128
#: Ids are packed so many at a time.
SLAB = BLOCK << 12


# ---------------------------------------------------------------- the code


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, block offsets and escapes of unsigned ids. All blocks of a slab are packed side by side."""
    words, offsets, escapes, at, left = [], [np.zeros(1, np.uint32)], [], 0, 0
    for start in range(0, len(ids), SLAB):
        w, o, e = _pack_slab(ids[start : start + SLAB])
        if left and len(e):  # places of escapes count from the frame's first
            w[w & np.uint64(15) == ESCAPE] += np.uint64(left << 4)
        words.append(w)
        offsets.append(o[1:] + np.uint32(at))
        escapes.append(e)
        at, left = at + len(w), left + len(e)
    if not words:
        return np.empty(0, np.uint64), offsets[0], np.empty(0, np.uint64)
    return np.concatenate(words), np.concatenate(offsets), np.concatenate(escapes)


def _pack_slab(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    wide = BLOCK + int(COUNTS[0])  # each block has zeros behind it, for what its last word has room for
    values = np.zeros((blocks, wide), np.uint64)
    whole = len(ids) // BLOCK
    values[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    values[whole:, : len(ids) - whole * BLOCK] = ids[whole * BLOCK :]
    least = np.searchsorted((2 ** BITS[1:15]).astype(np.uint64), values[:, :BLOCK], side="right").astype(np.uint8)
    least += least > 0  # the first selector that holds the value: 0 only for zero, 2 or more for others
    most = {1: np.zeros((blocks, wide), np.uint8)}  # by a power of two: the largest of so many from here on
    most[1][:, :BLOCK] = least
    for k in (1, 2, 4, 8, 16, 32, 64):
        most[2 * k] = most[k].copy()
        np.maximum(most[k][:, :-k], most[k][:, k:], out=most[2 * k][:, :-k])
    chosen = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for s in range(ESCAPE - 1, -1, -1):
        count = int(COUNTS[s])
        half = 1 << (count.bit_length() - 1)
        reach = np.maximum(most[half][:, :BLOCK], most[half][:, count - half : count - half + BLOCK])
        fits = reach <= (s if s > 1 else 0)
        if not fits.any():  # nor will a selector of more and smaller values
            break
        chosen[fits] = s
    size = np.minimum(BLOCK, len(ids) - np.arange(blocks) * BLOCK)
    place, row, insides, rows = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while len(row):
        insides.append(place)
        rows.append(row)
        place = place + COUNTS[chosen[row, place]]
        more = place < size[row]
        row, place = row[more], place[more]
    insides, rows = np.concatenate(insides), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    insides, rows = insides[order], rows[order]
    selectors, starts, values = chosen[rows, insides], rows * wide + insides, values.reshape(-1)
    words = selectors.astype(np.uint64)
    escaped = np.flatnonzero(selectors == ESCAPE)
    escapes = values[starts[escaped]]
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64) << np.uint64(4)
    for s in np.unique(selectors):
        if BITS[s] and s != ESCAPE:
            at = np.flatnonzero(selectors == s)
            word, place = words[at], starts[at]
            for k in range(COUNTS[s]):
                word |= values[place + k] << np.uint64(4 + k * BITS[s])
            words[at] = word
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=blocks)))).astype(np.uint32)
    return words, offsets, escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last - 1 (all by default) of the n ids of a frame."""
    last = len(offsets) - 1 if last is None else last
    if last <= first:
        return np.empty(0, np.uint64)
    words = words[offsets[first] : offsets[last]]
    rows = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1].astype(np.int64)))
    selectors = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    heads = offsets[first:last].astype(np.int64) - int(offsets[first])
    inside = ends - counts - (ends - counts)[heads][rows]
    out = np.zeros((last - first) * BLOCK + int(COUNTS[0]), np.uint64)
    for s in np.unique(selectors):
        if not BITS[s]:
            continue
        at = np.flatnonzero(selectors == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        place = rows[at] * BLOCK + inside[at]
        room = BLOCK - inside[at]
        for k in range(COUNTS[s]):
            value = (words[at] >> np.uint64(4 + k * BITS[s])) & mask
            within = k < room
            out[place[within] + k] = (escapes[value[within].astype(np.int64)] if s == ESCAPE else value[within])
    return out[: min(n - first * BLOCK, (last - first) * BLOCK)]


def frame(documents: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A frame without its trailer."""
    words, offsets, escapes = pack(ids)
    return b"".join((
        HEADER.pack(MAGIC, len(documents), len(ids), len(offsets) - 1, len(words), len(escapes)),
        np.array([d or 0 for d in documents], "<i8").tobytes(),
        np.array([d is None for d in documents], np.uint8).tobytes(),
        np.asarray(lengths, "<i8").tobytes(),
        offsets.astype("<u4").tobytes(),
        escapes.astype("<u8").tobytes(),
        words.astype("<u8").tobytes(),
    ))


def frames_of(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, int, tuple]]:
    """Of each frame: document ids, ids a document, all ids, and what unpack() takes first."""
    at = 0
    while at < len(content):
        magic, docs, n, blocks, words, escapes = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        at += HEADER.size
        parts = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<u4", blocks + 1), ("<u8", escapes), ("<u8", words)):
            parts.append(np.frombuffer(content, kind, count, at))
            at += parts[-1].nbytes
        if content[at : at + len(TRAILER)] != TRAILER:
            raise ValueError(f"the frame before byte {at} is cut off")
        at += len(TRAILER)
        yield [None if z else int(d) for d, z in zip(parts[0], parts[1], strict=True)], parts[2], n, (parts[5], parts[3], parts[4])


# ---------------------------------------------------------------- files


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_frames: int = FILE_FRAMES) -> None:
    """Encode whole texts and write files whose names and rows are in ascending order of the document id.

    Rows are dealt by ranges of the id, the text's hash and the row's place, so that a repeated id, a
    null one or a group of copies isn't one task's alone. A file's place among the files is its
    partition's number and its own number there; no task holds more than a batch of texts and one frame.
    """

    def encode(batches):
        import pyarrow as pa

        coder = encoder(tokenizer)
        documents, lengths, parts, total = [], [], [], 0  # of the open frame

        def full():
            made = frame(documents, np.concatenate(lengths), np.concatenate(parts))
            for x in (documents, lengths, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["frame"])

        for batch in common.pieces_of(batches):
            ids, sizes = with_end(*coder.encode(batch.column("text")), end_id)
            docs_, ends, at, done = batch.column("id").to_pylist(), np.cumsum(sizes), 0, 0
            while at < len(sizes):
                # the documents up to that with which the frame is full
                stop = min(int(np.searchsorted(ends, done + FRAME_IDS - total)) + 1, len(sizes))
                documents += docs_[at:stop]
                lengths.append(sizes[at:stop])
                parts.append(ids[done : ends[stop - 1]])
                total += int(ends[stop - 1]) - done
                at, done = stop, int(ends[stop - 1])
                if total >= FRAME_IDS:
                    yield full()
                    total = 0
            parts = [p.copy() for p in parts]  # not views of a batch's ids
            del ids
            common.release()
        if documents:
            yield full()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h").select("id", "text")
    common.write_frames(rows.mapInArrow(encode, "frame binary"), path, TRAILER, file_frames)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""

    def decode(batches):
        import pyarrow as pa

        names = ["file", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for number, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                before = 0
                for documents, lengths, n, packed in frames_of(memoryview(content.as_buffer())):
                    ids = unpack(*packed, n).astype("<u4")
                    ends = np.cumsum(lengths)
                    raw = memoryview(ids).cast("B")
                    columns = [
                        pa.array([number] * len(documents), pa.int64()), pa.array(documents, pa.int64()),
                        pa.array(ends - lengths + before), pa.array(lengths),
                        pa.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    before += n

    schema = "file long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = common.stage(common.read_files(spark, path).mapInArrow(decode, schema), "token_rows")  # each file is read once
    # one row a file: the ids of all files before it
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n_ids"))
    files = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    out = rows.join(files, "file").withColumn("start", F.col("base") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch(spark, "tokens")
    write_token_files(common.load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
