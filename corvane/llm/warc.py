"""WARC archives compressed with a Zstandard dictionary, record by record.

An archive is a run of Zstandard frames, one a record, so that any record can be read alone. The
dictionary is built from the archive's own first records and leads the archive in a skippable
frame; where these are too few or too short to train one, their text itself is the dictionary. An
archive of `archive_bytes` is closed and another begun. An empty skippable frame ends each archive,
which every Zstandard reader passes over.

Records with equal payloads of at least `least_revisit` bytes are stored once: that with the
largest id is the response, the others are revisits that name it and hold its digest and length.

Defined results: a null payload is an empty one. A row without id is a response unless a row with
an id has the same payload. Rows with equal ids and equal payloads are all responses where theirs is
the largest id. No rows make no archive. A page longer than `archive_bytes` has an archive of its own size.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
TRAILER = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
FIELD_END = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A dictionary is built from the records of an archive's first SAMPLE_BYTES.
SAMPLE_BYTES = 1 << 21
DICTIONARY_BYTES = 1 << 16
ARCHIVE_BYTES = 1 << 25
#: Payloads of a share over 1 / HOT of all copies are hot: fewer than HOT, they may be broadcast.
HOT = 10_000


def record_id(page: int | None) -> str:
    """A UUID of the custom kind (version 8) that holds the page's id; without an id, the nil UUID."""
    if page is None:
        return f"<urn:uuid:{uuid.UUID(int=0)}>"
    bits = page & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(bits >> 16) << 80 | 8 << 76 | 2 << 62 | bits & 0xFFFF)}>"


def page_of(record: str) -> int | None:
    whole = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if not whole:
        return None
    bits = whole >> 80 << 16 | whole & 0xFFFF
    return bits - (1 << 64) if bits >> 63 else bits


def make_record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: WARC header, HTTP header, and the payload unless it is a revisit of refers_to."""
    revisit = refers_to is not None
    http = FIELD_END.join((b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""))
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": date,
        "WARC-Target-URI": _one_line(url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
    body = http if revisit else http + payload
    fields["Content-Length"] = str(len(body))
    head = FIELD_END.join((b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None), b"", b""))
    return head + body + FIELD_END * 2


def _one_line(url: str | None) -> str | None:
    """Header fields can't hold control characters: those are percent-encoded, as in any URL."""
    return url and "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields, payload; names in lower case."""
    head, _, rest = record.partition(FIELD_END * 2)
    fields = _fields(head)
    if len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(FIELD_END * 2):
        raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
    http, _, payload = rest[:-4].partition(FIELD_END * 2)
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.decode().partition(":") for line in head.split(FIELD_END)[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


# ---------------------------------------------------------------- frames


def dictionary(records: list[bytes]):
    """A trained dictionary, or the records' last bytes where there is too little to train on."""
    import zstandard

    size = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 16)), records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archives(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> Iterator[bytes]:
    """All records in archives, each closed with the record that brings it to archive_bytes or its sample to an end, if that is later."""
    import zstandard

    while True:
        first, size = [], 0
        while size < min(SAMPLE_BYTES, archive_bytes) and (record := next(records, None)) is not None:
            first.append(record)
            size += len(record)
        if not first:
            return
        trained = dictionary(first)
        content = trained.as_bytes()
        coder = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        frames = [struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content, *map(coder.compress, first)]
        first.clear()
        size = sum(map(len, frames))
        while size < archive_bytes and (record := next(records, None)) is not None:
            frames.append(coder.compress(record))
            size += len(frames[-1])
        yield b"".join(frames)


def decompressed(archive: bytes, slice_bytes: int = 1 << 14) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    import zstandard

    coder, at, view = zstandard.ZstdDecompressor(), 0, memoryview(archive)
    while at < len(archive):
        (magic,) = struct.unpack_from("<I", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", archive, at + 4)
            if magic == DICTIONARY_MAGIC and at == 0:
                words = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
                coder = zstandard.ZstdDecompressor(dict_data=words)
            at += 8 + size
            continue
        frame, parts = coder.decompressobj(), []
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("the archive is cut off")
            parts.append(frame.decompress(view[at : at + slice_bytes]))
            at = min(at + slice_bytes, len(archive)) - len(frame.unused_data)
        yield b"".join(parts)


# ---------------------------------------------------------------- archives


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 1000, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write a record per row, into archives of at most about `archive_bytes` in the folder `path`.

    Equal payloads are found by digest: ids are first reduced to the largest of each digest, and these
    few columns are joined back. The hot ones of them are broadcast, so that a large group of copies
    isn't moved at all; revisits leave their payload behind there. Of the others Spark broadcasts what
    its own limit allows, else it moves the rows to their digests.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    copies = (
        rows.filter(F.col("size") >= least_revisit)
        .groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .filter("n > 1 and response is not null")
    )
    copies = common.stage(copies, "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    known = lambda c: c.select(F.col("digest").alias("of"), "response")

    def settled(rows: DataFrame) -> DataFrame:
        """Rows with a response get its id, and keep their payload only if it is theirs."""
        revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
        return rows.withColumns({"payload": F.when(~revisit, F.col("payload")), "refers_to": F.coalesce("refers_to", F.when(revisit, F.col("response")))}).drop("of", "response")

    rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    rows = settled(rows.join(F.broadcast(known(copies.filter(hot))), F.col("digest") == F.col("of"), "left"))
    # rows of hot payloads are dealt anywhere: none of the rest has their key
    key = F.when(F.col("refers_to").isNull(), F.col("digest")).otherwise(F.unhex(F.hex(F.xxhash64("page_id", "url"))))
    rows = settled(rows.join(known(copies.filter(~hot)), key == F.col("of"), "left"))

    def archive(batches):
        import pyarrow as pa

        def records():
            for batch in common.pieces_of(batches, "payload"):
                for page, url, payload, digest, size, response in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "size", "refers_to")), strict=True):
                    yield make_record(page, url, payload, size, digest, response, date)

        for made in archives(records(), archive_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["frame"])

    common.write_frames(rows.mapInArrow(archive, "frame binary"), path, TRAILER, 1)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record. Digests of responses are computed anew and must be those in the header."""

    def parse(batches):
        import pyarrow as pa

        kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
        schema = pa.schema(kinds + [("payload", pa.binary())] * with_payload)
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for record in decompressed(content.as_py()):
                    fields, http, payload = parse_record(record)
                    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    revisit = fields["warc-type"] == "revisit"
                    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
                    if digest != stated:
                        raise ValueError(f"record {fields['warc-record-id']}: the digest isn't its payload's")
                    rows.append((
                        page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"],
                        int(http["content-length"]) if revisit else len(payload), digest,
                        page_of(fields["warc-refers-to"]) if revisit else None, *[None if revisit else payload] * with_payload,
                    ))
                    size += len(payload) * with_payload
                    if len(rows) >= 4096 or size >= 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    columns = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return common.read_files(spark, path).select("content").mapInArrow(parse, columns + ", payload binary" * with_payload)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write_archives(common.load(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, ''))
            THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
FROM pages
"""
