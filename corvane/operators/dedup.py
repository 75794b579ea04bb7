"""Duplicates: within a document, exact and fuzzy across documents, and what follows from a merge.

Groups of copies are reduced (least id, set of sources, count) before anything is joined back, so a
group of any size costs one row a copy and never a pair of copies.
"""

from __future__ import annotations

from bisect import bisect_right
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import slices
from ..sources.checkpoint import checkpointed
from .components import connected_components

PRIME = (1 << 31) - 1
PERMUTATIONS, BANDS = 128, 16
#: Texts in one block of a bucket, and elements compared at a time.
BLOCK, COLUMNS = 256, 8192
#: From this similarity on, texts without a partner are put aside by parts of their sets. Below it, parts are too small to tell.
PARTS_FROM = 0.9


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """The affine hashes' factors and terms, by a linear congruential rule; products stay below 2**62."""
    out, state = [], 1
    for _ in range(n):
        pair = []
        for _ in range(2):
            state = (state * 48271) % PRIME
            pair.append(state)
        out.append((pair[0], pair[1]))
    return out


def accepted(chunks: DataFrame, text: str = "text", least_chars: int = 40, least_score: float = 0.45) -> DataFrame:
    """Chunks that are long enough and score high enough; values at the bounds stay."""
    return chunks.filter((F.length(T.strip(F.col(text))) >= least_chars) & (T.quality_score(F.col(text)) >= least_score))


def first_of_each(chunks: DataFrame, group: str, index: str, text: str = "text") -> DataFrame:
    """Within each group the first chunk of each text, compared in lower case with single spaces."""
    norm = T.strip(T.collapse(F.lower(text)))
    place = F.row_number().over(Window.partitionBy(group, F.sha2(norm, 256)).orderBy(index))
    return chunks.withColumn("place_", place).filter("place_ = 1").drop("place_")


def merge_exact(chunks: DataFrame, key: str, source: str, text: str = "text") -> DataFrame:
    """A row per distinct text: content_hash, canonical id, the sorted set of sources, and the copies."""
    hashed = chunks.select(T.normal_hash(F.col(text)).alias("content_hash"), F.col(key).alias("id"), F.col(source).alias("source"))
    return hashed.groupBy("content_hash").agg(F.min("id").alias("canonical_id"), F.array_sort(F.collect_set("source")).alias("source_documents"), F.count("*").alias("n_copies"))


def merge_events(chunks: DataFrame, key: str, source: str, text: str = "text", override: list[str] | None = None) -> DataFrame:
    """An event per copy that isn't canonical, and per chunk of an overridden source."""
    hashed = chunks.select(T.normal_hash(F.col(text)).alias("canonical_content_hash"), F.col(key).alias("id"), F.col(source).alias("merged_source_key"))
    skip = F.col("merged_source_key").isin(override or [])
    canonical = hashed.filter(~skip).groupBy("canonical_content_hash").agg(F.min("id").alias("canonical_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    merged = hashed.filter(~skip).join(canonical, "canonical_content_hash").filter("id <> canonical_id")
    event = lambda df, canonical_id, similarity, action: df.select("canonical_content_hash", canonical_id.alias("canonical_id"), "id", "merged_source_key", F.lit("exact").alias("match_tier"), F.lit(similarity).alias("similarity_score"), F.lit(False).alias("canonical_replaced"), F.lit(action).alias("action"))
    return event(merged, F.col("canonical_id"), 1.0, "merged").unionByName(event(hashed.filter(skip), F.col("id"), 0.0, "override_skipped"))


def shingles(text: Column, n: int = 3) -> Column:
    """The distinct word n-grams in lower case; all words where there are fewer."""

    def runs(w: Column) -> Column:
        one = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])  # noqa: E731  what lies beyond the end is null and skipped
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), one)))

    return T.let(T.words(F.lower(text)), runs)


def minhash(docs: DataFrame, key: str, text: str = "text", n: int = 3) -> DataFrame:
    """id and signature: for each affine hash the least value over the shingles of a row, row by row. Texts without words have none.

    A shingle's number is the first 28 bits of its MD5.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    factors, terms = (np.array(c, np.uint64)[:, None] for c in zip(*coefficients(), strict=True))

    def runs(words: bytes) -> set:
        spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        if len(spaces) < n:
            return {words}
        starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(words)]
        return {words[a:b] for a, b in zip(starts[: len(starts) - n + 1], ends[n - 1 :], strict=True)}

    def sign(batches):
        import pyarrow as pa

        for batch in slices(batches, "words"):
            made, keep = [], []
            for i, words in enumerate(batch.column("words").to_pylist()):
                if not words:
                    continue
                digests = b"".join([md5(r).digest() for r in runs(words.encode())])
                h = (np.frombuffer(digests, ">u4")[::4] >> 4).astype(np.uint64)
                least = np.full(PERMUTATIONS, PRIME, np.uint32)
                for at in range(0, len(h), 256):
                    # 2**31 leaves 1 at division by the prime, so the two halves' sum has the same remainder
                    products = h[at : at + 256] * factors + terms
                    sums = (products & np.uint64(PRIME)).astype(np.uint32)
                    sums += (products >> np.uint64(31)).astype(np.uint32)
                    np.minimum(sums, sums - np.uint32(PRIME), out=sums)  # what is below the prime wraps round and stays
                    np.minimum(least, sums.min(axis=1), out=least)
                made.append(least.astype(np.int64))
                keep.append(i)
            flat = pa.array(np.concatenate(made) if made else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * PERMUTATIONS), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), lists], ["id", "signature"])

    # one text for the words, which hold no space: quicker to hand over than a list, and runs are parts of it
    rows = docs.select(F.col(key).alias("id"), F.array_join(T.words(F.lower(F.col(text))), " ").alias("words"))
    return rows.mapInArrow(sign, f"id {kind}, signature array<long>")


def estimated_similarity(a: Column, b: Column) -> Column:
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return equal / PERMUTATIONS


def similarity(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays of distinct values; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _mixed(h):
    """The bits of 64-bit numbers spread over each other, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _distinct(values):
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


#: A number for each byte at each of a word's first places.
PLACES = _mixed(np.arange(64 * 256, dtype=np.uint64))


def _sets(texts, n: int):
    """For each of an Arrow array's texts (words with single spaces between) the distinct hashes of its word n-grams; of all words where there are fewer."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    full = bounds[:-1] < bounds[1:]
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.sort(np.concatenate([spaces + 1, bounds[:-1][full]])), np.sort(np.concatenate([spaces, bounds[1:][full]]))
    # a word's hash is the sum of numbers for each byte at its place, so all words' hashes are differences of one running sum
    at = (np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))) * 256 + data
    values = PLACES.take(at, mode="clip")
    far = np.flatnonzero(at >= len(PLACES))
    values[far] = _mixed(at[far].astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    words = sums[ends] - sums[starts]
    cuts = np.searchsorted(starts, bounds)
    first, last = np.repeat(cuts[:-1], np.diff(cuts)), np.repeat(cuts[1:], np.diff(cuts))
    runs, place = np.minimum(last - first, n).astype(np.uint64), np.arange(len(words))
    for k in range(n):  # each place has a factor of its own
        size = max(len(words) - k, 0)
        more = runs[:size] * np.uint64(0x9E3779B97F4A7C15) + words[k:]
        runs[:size] = np.where(place[k:] < last[:size], more, runs[:size])
    whole = (place + n <= last) | (place == first)
    cuts = np.concatenate([[0], np.cumsum(whole)])[cuts]
    runs = _mixed(runs[whole])
    return [_distinct(runs[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _parts(elements, threshold: float, bounds: list[int]):
    """Numbers of which two sets of at least the threshold have one in common.

    Sets whose union holds at most d elements that aren't in both agree in one of d + 1 parts, as each such element
    spoils one part. d is bounded by the sizes; sizes are in classes, and sets that are similar enough are in one class
    or in two that follow each other, so each set is cut for its class with the next, and with the one before.
    """
    while bounds[-1] <= len(elements):
        bounds.append(int(bounds[-1] / threshold + 1e-9) + 1)
    at = bisect_right(bounds, len(elements)) - 1
    while len(bounds) < at + 3:
        bounds.append(int(bounds[-1] / threshold + 1e-9) + 1)
    out, mixed = [], _mixed(elements)
    for low in range(max(at - 1, 0), at + 1):
        most = 2 * (bounds[low + 2] - 1)
        parts = int(most * (1 - threshold) / (1 + threshold) + 1e-6) + 1
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, (elements % np.uint64(parts)).astype(np.int64), mixed)
        out.append(_mixed(sums + _mixed(np.arange(parts, dtype=np.uint64) + (np.uint64(low + 1) << np.uint64(32)))))
    return np.concatenate(out).view(np.int64)


def _hashed(docs: DataFrame, key: str, text: str, threshold: float, n: int) -> DataFrame:
    """(id, content_hash, parts) of each text, written once; parts is null for a threshold that is too low for them."""
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.trim(T.collapse(F.col(text))).alias("norm"))  # T.normal_hash's text, stripped of the spaces that are left
    rows = rows.select("id", F.sha2("norm", 256).alias("content_hash"), F.lower("norm").alias("words"))
    if not PARTS_FROM <= threshold <= 1:
        return checkpointed(rows.select("id", "content_hash", F.lit(None).cast("array<long>").alias("parts")), "hashes")

    def cut(batches):
        import pyarrow as pa

        bounds = [1]
        for batch in slices(batches, "words", 250_000):
            made = [_parts(s, threshold, bounds) if len(s) else np.empty(0, np.int64) for s in _sets(batch.column("words"), n)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(np.concatenate(made)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("content_hash"), lists], ["id", "content_hash", "parts"])

    return checkpointed(rows.mapInArrow(cut, f"id {kind}, content_hash string, parts array<long>"), "hashes")


def fuzzy_matches(docs: DataFrame, key: str, text: str = "text", threshold: float = 0.95, n: int = 3) -> DataFrame:
    """For each text its most similar earlier text of at least the threshold, the earliest on a tie, and whether it replaces that.

    Exact copies are put aside first. Bands of the signature make buckets, and all pairs of a bucket are
    compared on their full sets, in blocks of bounded size and within the task: rows out are at most one a
    member and block, never a pair. Buckets with the same members are compared once. For a high threshold, only
    texts that agree with another in a part of their sets are signed; no pair of at least the threshold is lost by that.
    """
    groups, kind = _dealt(docs, _hashed(docs, key, text, threshold, n), key, text, threshold, n)

    def compare(table):
        return _best_earlier(table, threshold)

    scored = groups.applyInArrow(compare, f"id {kind}, canonical_id {kind}, similarity double, replaces boolean")
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("least"), "canonical_id", "similarity", "replaces")).alias("b"))
    return best.select("id", F.col("b.canonical_id").alias("canonical_id"), F.round("b.similarity", 6).alias("similarity"), F.when(F.col("b.replaces"), "replaced").otherwise("merged").alias("action"))


def near_duplicate_clusters(docs: DataFrame, key: str, text: str = "text", threshold: float = 0.95, n: int = 3) -> DataFrame:
    """(id, cluster): each text with the smallest id that a chain of pairs of at least the threshold leads to, its own if none does.

    Exact copies are of one cluster. Pairs come from fuzzy_matches' blocks; each returns no more links than join its rows.
    """
    hashed = _hashed(docs, key, text, threshold, n)
    groups, kind = _dealt(docs, hashed, key, text, threshold, n)

    def link(table):
        return _forest(table, threshold)

    hashed = hashed.select("id", "content_hash")
    firsts = hashed.groupBy("content_hash").agg(F.min("id").alias("first"))
    parts = connected_components(groups.applyInArrow(link, f"a {kind}, b {kind}"))
    named = firsts.join(parts, F.col("first") == F.col("node"), "left").select("content_hash", F.coalesce("component", "first").alias("cluster"))
    return hashed.filter("content_hash is not null").join(named, "content_hash").select("id", "cluster").unionByName(hashed.filter("content_hash is null").select("id", F.col("id").alias("cluster")))


def _dealt(docs: DataFrame, hashed: DataFrame, key: str, text: str, threshold: float, n: int):
    """Blocks of the buckets that texts share, grouped, with the texts' sets; and the type of the key."""
    ids = hashed.groupBy("content_hash").agg(F.min("id").alias("id")).select("id")
    if PARTS_FROM <= threshold <= 1:
        parts = hashed.join(ids, "id", "left_semi").select("id", F.explode("parts").alias("part"))
        shared = parts.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part")
        ids = parts.join(shared, "part", "left_semi").select("id").distinct()
    kept = checkpointed(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi"), "kept")
    signed = minhash(kept, "id", n=n)
    width = PERMUTATIONS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.concat_ws(":", b.cast("string"), F.array_join(F.slice("signature", b * width + 1, width), ",")))
    bucketed = checkpointed(signed.select("id", F.explode(bands).alias("name")).select("id", F.md5("name").alias("bucket")))
    hashed = F.xxhash64("id")
    sized = bucketed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(20,0)")).alias("total"), F.bit_xor(hashed).alias("parity")).filter("n > 1")
    once = sized.groupBy("n", "total", "parity").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = bucketed.join(once.select("bucket", "n"), "bucket").withColumn("block", F.pmod(hashed, blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id")
    # only texts that share a bucket are taken apart and moved as sets
    sharing = bucketed.join(once.select("bucket"), "bucket", "left_semi").select("id").distinct()
    sets = kept.join(sharing, "id", "left_semi").select("id", F.length("text").alias("chars"), F.transform(shingles(F.col("text"), n), lambda s: F.xxhash64(s)).alias("elements"))
    return dealt.join(sets, "id").groupBy("bucket", "low", "high"), docs.select(key).schema[0].dataType.simpleString()


def _similar(table):
    """Of one group sorted by id: the similarity of each row with each earlier row, of the other block if there are two, else -1."""
    block = table.column("block").to_numpy()
    elements = table.column("elements").combine_chunks()
    sizes = elements.value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    _, column, held = np.unique(elements.flatten().to_numpy(), return_inverse=True, return_counts=True)
    place = np.cumsum(held > 1) - 1  # an element of one row is in no intersection
    shared = held[column] > 1
    rows, column = rows[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(sizes), len(sizes)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(sizes), int(column[b - 1]) + 1 - low), np.float32)
        has[rows[a:b], column[a:b] - low] = 1
        both += has @ has.T
    similar = both.astype(np.float64)
    similar /= sizes[:, None] + sizes - similar
    earlier = np.tri(len(sizes), k=-1, dtype=bool)
    if block.min() < block.max():
        earlier &= block[:, None] != block
    similar[~earlier] = -1
    return similar


def _best_earlier(table, threshold: float):
    """Of one group: for each row its most similar earlier row of at least the threshold."""
    import pyarrow as pa

    table = table.sort_by("id")
    similar, chars = _similar(table), table.column("chars").to_numpy()
    at = similar.argmax(axis=1)
    best = similar[np.arange(len(at)), at]
    found = np.flatnonzero((best >= threshold) & (best >= 0))
    at = at[found]
    ids = table.column("id")
    return pa.table({"id": ids.take(pa.array(found)), "canonical_id": ids.take(pa.array(at)), "similarity": pa.array(best[found]), "replaces": pa.array(chars[found] > chars[at])})


def _forest(table, threshold: float):
    """Of one group: links between rows of at least the threshold, as many as join them."""
    import pyarrow as pa

    table = table.sort_by("id")
    later, earlier = np.nonzero(_similar(table) >= max(threshold, 0))
    root, links = list(range(table.num_rows)), []

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(later.tolist(), earlier.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((j, i))
    ids = table.column("id")
    return pa.table({"a": ids.take(pa.array([x[0] for x in links], pa.int64())), "b": ids.take(pa.array([x[1] for x in links], pa.int64()))})


# ---------------------------------------------------------------- source references


def append_source(sources: Column, key: Column) -> Column:
    return F.array_union(sources, F.array(key))


def remove_source(chunks: DataFrame, key: str, sources: str = "source_documents") -> DataFrame:
    """Without the key in the sources, and without the chunks that have no source left."""
    return chunks.withColumn(sources, F.array_remove(F.col(sources), key)).filter(F.size(sources) > 0)


def revert_merges(merged: DataFrame, events: DataFrame) -> DataFrame:
    """merged (content_hash, source_documents) without the sources that the events merged in."""
    undone = events.groupBy(F.col("canonical_content_hash").alias("content_hash")).agg(F.collect_set("merged_source_key").alias("undone"))
    joined = merged.join(undone, "content_hash", "left")
    return joined.withColumn("source_documents", F.when(F.col("undone").isNull(), F.col("source_documents")).otherwise(F.array_except("source_documents", "undone"))).drop("undone")


def update_content(chunks: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Replace text and content_hash of the chunks that changes (key, new_text) names."""
    joined = chunks.join(changes, key, "left")
    text = F.coalesce("new_text", "text")
    return joined.select(key, text.alias("text"), T.normal_hash(text).alias("content_hash"))


def best_of_each(hits: DataFrame, key: Column, score: str, *ties: str) -> DataFrame:
    """The row with the highest score of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *ties))
    return hits.withColumn("place_", place).filter("place_ = 1").drop("place_")

