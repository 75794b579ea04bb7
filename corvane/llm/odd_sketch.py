"""MinHash near-duplicates with odd sketches.

1. Each document becomes the set of its distinct word shingles, as 64-bit hashes. Documents with
   equal sets form a class; from here on a class stands for its copies, whatever their number.
2. A class has a MinHash signature. Bands of it are bucket keys; the samples are also folded into an
   odd sketch, a bitmap of their parities. The bits in which two sketches differ tell how many
   samples differ, so a few words of XOR and a population count dismiss most chance candidates.
3. Within a bucket each class is a candidate with the bucket's smallest class only. Candidates that
   their sketches don't dismiss are confirmed on the full sets; links give components.
4. Only buckets that still hold several components can hold further links. There all pairs across
   components are compared by sketch, in blocks of bounded size, and those not dismissed are confirmed
   within the task that compares them, which returns links alone, and no more than join components.
   After this every pair that shares a bucket is in one component, dismissed or confirmed.

Nothing is dropped: a bucket of any size goes through 3 (one pair a member) and 4 (blocks). In 4 the
largest component of a bucket is compared with the rest alone, and a bucket with very many members
outside it is first split by bands of further samples. What remains grows with the square of the
members outside the largest component that are alike by these as well. Two documents of the least similarity share no
bucket with a probability of under one in a million, and are dismissed by their sketches as rarely.

Defined results: a document without text or words has no shingles and is linked with nothing. A
document with fewer words than a shingle has one shingle, all its words. A document without id is
linked with nothing, has no component and is kept. Rows with equal ids and different texts have the
components of their texts, which may differ; texts whose smallest ids are equal are one node to the
links. Each row is returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import common

SAMPLES = 128
SKETCH_BITS = 512
#: Classes in one block of a bucket that holds several components.
BLOCK = 512
#: A bucket with more blocks than this outside its largest component is split by further bands.
WIDE = 48


@dataclass(frozen=True)
class Similarity:
    """Shingles of `words` words; a link is 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """The most rows a band at which two documents of the least similarity all but surely share one."""
        j = self.percent / 100
        good = [r for r in range(1, 9) if (1 - j**r) ** (SAMPLES // r) < 1e-6]
        return max(good, default=1)

    @property
    def further(self) -> int:
        """How many further bands two documents of the least similarity all but surely share one of."""
        return math.ceil(math.log(1e-9) / math.log(1 - (self.percent / 100) ** self.rows)) if self.percent < 100 else 1

    @property
    def most_bits(self) -> int:
        """Bits in which the sketches of a linked pair differ at most."""
        j = self.percent / 100
        samples = SAMPLES * (1 - j) + 5.5 * math.sqrt(SAMPLES * j * (1 - j))
        return math.ceil(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * samples)))


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_FACTORS = _stream(SAMPLES, 1) | np.uint64(1)
_TERMS = _stream(SAMPLES, 2)
_WORD_FACTORS = _stream(64, 3) | np.uint64(1)
_SALTS = _stream(SAMPLES, 4)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles."""
    from xxhash import xxh3_64_intdigest

    found = (text or b"").lower().split()  # bytes.lower() changes A-Z alone
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    with np.errstate(over="ignore"):
        total = np.full(len(found) - n + 1, n, np.uint64)
        for k in range(n):
            total += hashes[k : len(found) - n + 1 + k] * _WORD_FACTORS[k]
        return np.unique(mix(total))


def signature(elements: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), 256):
            part = elements[at : at + 256, None] * _FACTORS
            part += _TERMS
            np.minimum(least, part.min(axis=0), out=least)
    return least


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    count = SAMPLES // rows
    with np.errstate(over="ignore"):
        parts = signatures[:, : count * rows].reshape(len(signatures), count, rows)
        return mix((parts * _WORD_FACTORS[:rows]).sum(axis=2, dtype=np.uint64) + _SALTS[:count])


def further_bands(elements: np.ndarray, how: Similarity) -> np.ndarray:
    """Bands of samples that no signature holds."""
    rows, count = how.rows, how.further
    if not len(elements):
        return np.empty(0, np.int64)
    factors, terms = _stream(rows * count, 5) | np.uint64(1), _stream(rows * count, 6)
    least = np.full(rows * count, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), 256):
            np.minimum(least, (elements[at : at + 256, None] * factors + terms).min(axis=0), out=least)
        return mix((least.reshape(count, rows) * _WORD_FACTORS[:rows]).sum(axis=1, dtype=np.uint64) + _stream(count, 7)).view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Parity bitmaps, a row of SKETCH_BITS / 8 bytes each."""
    n = len(signatures)
    with np.errstate(over="ignore"):
        place = (mix(signatures ^ _SALTS) % np.uint64(SKETCH_BITS)).astype(np.int64)
    place += np.arange(n)[:, None] * SKETCH_BITS
    parity = np.bincount(place.reshape(-1), minlength=n * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


# ---------------------------------------------------------------- the distributed steps


def _sign(rows: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, sketch of each row of (doc_id, text)."""
    words, band_rows = how.words, how.rows

    def sign(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in common.pieces_of(batches):
            sets = [shingles(x, words) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            signed = np.array([signature(s) for s in sets]).reshape(-1, SAMPLES)
            keys, folded = bands(signed, band_rows).view(np.int64), sketches(signed)
            some = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_digest(s.tobytes()) if x else None for s, x in zip(sets, some, strict=True)], pa.binary()),
                    pa.array([k if x else None for k, x in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                    pa.array([k.tobytes() if x else None for k, x in zip(folded, some, strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return rows.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def _differing(x, y):
    """Bits in which two binary columns of SKETCH_BITS / 8 bytes differ."""
    part = lambda c, k: F.conv(F.hex(F.substring(c, 1 + 8 * k, 8)), 16, -10).cast("long")
    total = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        total = total + F.bit_count(part(x, k).bitwiseXOR(part(y, k)))
    return total


def _confirm(texts: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) of nodes with their candidates' full sets. texts: (doc_id, text, leaders), a node's text with its candidates.

    A node's text moves to each of its candidates, whose own text comes to the same task once; Spark splits the
    partition of a candidate of many.
    """
    words, percent = how.words, how.percent

    def check(batches):
        import pyarrow as pa

        known, held = None, None  # rows come sorted by a
        for batch in common.pieces_of(batches, "text_b", 2_000_000):
            keep = []
            texts_a, texts_b = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            for i, a in enumerate(batch.column("a").to_pylist()):
                first = texts_a[i].as_py()
                if known != (a, first):
                    known, held = (a, first), shingles(first, words)
                if linked(held, shingles(texts_b[i].as_py(), words), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    pairs = texts.select(F.explode("leaders").alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(texts.filter("leads").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


MEMBER = "bucket long, sub long, kind int, band int, low int, high int, block int, node long, component long, n_shingles long, bands array<long>, sketch binary"
GROUP = ("bucket", "sub", "kind", "low", "high")


def _main(members: DataFrame) -> DataFrame:
    """Of each (bucket, sub) that holds several components: its largest one, and how many members are in that and in others."""
    parts = members.groupBy("bucket", "sub", "component").agg(F.count("*").alias("n"))
    tops = parts.groupBy("bucket", "sub").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"))
    return tops.select("bucket", "sub", F.col("top.component").alias("main"), F.col("top.n").alias("inside"), (F.col("size") - F.col("top.n")).alias("outside")).filter("outside > 0")


def _deal(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups of two blocks of a bucket at most, in which all pairs across components are.

    A bucket that fits a block is one group. Of any other the largest component needs no comparison inside, so
    its blocks meet those of the rest (kind 0), and the rest's blocks meet one another (kind 1): where
    few members are outside the largest component, the work grows with the members alone.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = members.join(sizes, ["bucket", "sub"]).withColumn("is_main", F.col("component") == F.col("main"))
    small = F.col("inside") + F.col("outside") <= BLOCK
    own, others = blocks(F.when(F.col("is_main"), F.col("inside")).otherwise(F.col("outside"))), blocks(F.when(F.col("is_main"), F.col("outside")).otherwise(F.col("inside")))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("node"), own).cast("int"))
    columns = ("bucket", "sub", "kind", "band", "low", "high", "block", "node", "component", "n_shingles", "bands", "sketch")
    zero = F.lit(0)
    whole = rows.filter(small).withColumns({"kind": F.lit(1), "low": zero, "high": zero, "block": zero})
    across = rows.filter(~small).withColumn("other", F.explode(F.sequence(zero, others - 1)))
    across = across.withColumns({"kind": zero, "low": F.when(F.col("is_main"), F.col("place")).otherwise(F.col("other")), "high": F.when(F.col("is_main"), F.col("other")).otherwise(F.col("place")), "block": F.when(F.col("is_main"), 0).otherwise(1)})
    among = rows.filter(~small & ~F.col("is_main")).withColumn("other", F.explode(F.sequence(zero, own - 1)))
    among = among.withColumns({"kind": F.lit(1), "low": F.least("place", "other"), "high": F.greatest("place", "other"), "block": F.col("place")})
    return whole.select(*columns).unionByName(across.select(*columns)).unionByName(among.select(*columns))


def _spread(members: DataFrame, wide: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """The members of wide buckets, once for each band of further samples (`sub`).

    Two linked documents share one of these with a probability of all but one in a thousand million, while
    documents that met by one common passage mostly share none.
    """

    def sign(batches):
        import pyarrow as pa

        for batch in common.pieces_of(batches):
            made = [further_bands(shingles(x, how.words), how) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.int64()))], ["node", "further"])

    rows = members.drop("sub").join(wide.select("bucket"), "bucket")
    signed = texts.select("doc_id", "text").join(rows.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(sign, "node long, further array<long>")
    return rows.join(common.stage(signed, "further"), "node").withColumn("sub", F.explode("further")).drop("further")


def _candidates(table, how: Similarity):
    """Of one group: for each row i of its first block the rows that may be linked with it, nearest first.

    Rows of one component aren't compared, nor pairs that share an earlier band: their bucket has them.
    """
    parts, block, nodes = (table.column(k).to_numpy() for k in ("component", "block", "node"))
    n, band = table.column("n_shingles").to_numpy(), table.column("band")[0].as_py()
    raw = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(nodes), -1)
    keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
    one = block.min() == block.max()
    if one and table.column("kind")[0].as_py() == 0:  # the other block has no members
        return
    for i in np.flatnonzero(block == block.min()).tolist():
        near = (parts != parts[i]) & (100 * np.minimum(n, n[i]) >= how.percent * np.maximum(n, n[i]))
        near &= nodes > nodes[i] if one else block != block[i]
        found = np.flatnonzero(near)
        bits = np.bitwise_count(raw[found] ^ raw[i]).sum(axis=1)
        found, bits = found[bits <= how.most_bits], bits[bits <= how.most_bits]
        first = np.argmax(keys[found] == keys[i], axis=1) == band
        yield i, found[first][np.argsort(bits[first], kind="stable")]


def _across(members: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) between components that share a bucket, as many as join them.

    A first pass finds the members that have any candidate by sketch; only those get their full sets,
    and the second pass confirms candidates where they are, so that pairs never become rows.
    """
    members = common.stage(members.withColumn("sub", F.lit(0).cast("long")), "inside")
    sizes = common.stage(_main(members), "sizes")
    wide = F.col("outside") > WIDE * BLOCK
    if not sizes.filter(wide).isEmpty():
        narrow = members.join(sizes.filter(~wide).select("bucket"), "bucket", "left_semi")
        members = common.stage(narrow.unionByName(_spread(members, sizes.filter(wide), texts, how)), "spread")
        sizes = common.stage(_main(members), "sizes")

    def active(table):
        import pyarrow as pa

        keep = np.zeros(table.num_rows, bool)
        for i, found in _candidates(table, how):
            keep[found] = True
            keep[i] |= len(found) > 0
        return table.filter(pa.array(keep))

    def confirm(table):
        import pyarrow as pa

        nodes, parts = table.column("node").to_pylist(), table.column("component").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
        root = {p: p for p in parts}

        def find(p):
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        links = []
        for i, found in _candidates(table, how):
            for j in found.tolist():
                mine, theirs = find(parts[i]), find(parts[j])
                if mine != theirs and linked(sets[i], sets[j], how.percent):
                    root[max(mine, theirs)] = min(mine, theirs)
                    links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    def elements(batches):
        import pyarrow as pa

        for batch in common.pieces_of(batches):
            made = [shingles(x, how.words).tobytes() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["node", "elements"])

    found = common.stage(_deal(members, sizes).groupBy(*GROUP).applyInArrow(active, MEMBER), "active")
    sets = texts.join(found.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(elements, "node long, elements binary")
    return found.join(sets, "node").groupBy(*GROUP).applyInArrow(confirm, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, how: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = common.stage(_sign(rows, how), "signed")
    known = signed.filter("set_key is not null and doc_id is not null")
    once = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]  # equal sets have equal ones
    classes = common.stage(known.groupBy("set_key").agg(F.min("doc_id").alias("node"), *once), "classes")
    folded = classes.select("node", "sketch")
    dealt = classes.select("node", F.explode("bands").alias("bucket"))
    shared = common.stage(dealt.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = common.stage(dealt.join(shared, "bucket"), "members")
    pairs = members.filter("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(folded.toDF("b", "sketch_b"), "b").join(folded.toDF("a", "sketch_a"), "a")
    pairs = common.stage(pairs.filter(_differing(F.col("sketch_a"), F.col("sketch_b")) <= how.most_bits).select("a", "b"), "pairs")
    # the texts of all classes that share a bucket, moved once: later steps read no others. A node has no more candidates than bands
    empty = F.array().cast("array<long>")
    wanted = members.select("node").distinct().select(F.col("node").alias("doc_id"), empty.alias("leaders"), F.lit(False).alias("leads"))
    wanted = wanted.unionByName(pairs.select(F.col("b").alias("doc_id"), F.array("a").alias("leaders"), F.lit(False).alias("leads")))
    wanted = wanted.unionByName(pairs.select(F.col("a").alias("doc_id"), empty.alias("leaders"), F.lit(True).alias("leads")).distinct())
    wanted = wanted.groupBy("doc_id").agg(F.flatten(F.collect_list("leaders")).alias("leaders"), F.max("leads").alias("leads"))
    texts = common.stage(rows.join(wanted, "doc_id"), "texts")
    # where ids repeat, a pair of ids may be confirmed by several texts
    links = common.stage(_confirm(texts, how).distinct(), "links")
    parts = connected_components(links)

    labelled = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = common.stage(labelled.select("bucket", "node", "component", "size"), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    inside = labelled.join(common.stage(mixed.select("bucket"), "mixed"), "bucket")
    inside = inside.join(classes.select("node", "n_shingles", "bands", "sketch"), "node").withColumn("band", (F.array_position("bands", F.col("bucket")) - 1).cast("int"))
    more = common.stage(_across(inside, texts, how), "more")
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))

    found = classes.select("set_key", "node").join(parts, "node", "left")
    found = found.select("set_key", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.load(spark, sf_dir, "documents"), Similarity(words=3, percent=85))
