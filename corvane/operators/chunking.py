"""Chunking: one row becomes many. Fixed windows and headings stay in the JVM; the recursive splitter is an Arrow function."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import slices
from ..sources.checkpoint import checkpointed

SIZE, OVERLAP = 512, 50
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def windows(docs: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk) of windows of `size` characters that overlap."""
    last = F.greatest(F.lit(0), F.length(text) - 1)
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return docs.select(key, text, F.posexplode(starts).alias("chunk_index", "start")).select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.col(text).substr(F.col("start") + 1, F.lit(size)).alias("chunk"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: list[str] | None = None) -> list[str]:
    """Recursive splitting: by the first separator that occurs, pieces that are still too long by the next ones,
    then neighbours joined up to the size, each chunk beginning with the end of the one before."""
    separators = SEPARATORS if separators is None else separators
    mark = next((s for s in separators if s in text), "")
    rest = separators[separators.index(mark) + 1 :]
    if mark:
        first, *others = text.split(mark)
        pieces = [p for p in [first, *(mark + o for o in others)] if p]
    else:
        pieces = list(text)
    chunks: list[str] = []
    held: list[str] = []
    total = 0

    def close():
        if joined := "".join(held).strip():
            chunks.append(joined)

    for piece in pieces:
        if len(piece) > size and rest:
            close()
            held, total = [], 0
            chunks += split_text(piece, size, overlap, rest)
            continue
        if total + len(piece) > size and held:
            close()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    close()
    return chunks


def recursive_chunks(docs: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, total_chunks, chunk) by split_text."""

    def split(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            keys, index, totals, chunks = [], [], [], []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                made = split_text(t or "", size, overlap)
                keys += [k] * len(made)
                index += range(len(made))
                totals += [len(made)] * len(made)
                chunks += made
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("key").type), pa.array(index, pa.int64()), pa.array(totals, pa.int64()), pa.array(chunks, pa.string())], [key, "chunk_index", "total_chunks", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(split, f"{key} {kind}, chunk_index long, total_chunks long, chunk string")


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, section_path, heading, heading_level, content): cut at headings of level 1 to 4, headings kept."""
    line = docs.select(key, F.posexplode(T.lines(F.col(text))).alias("i", "line"))
    mark = r"^(#{1,4})\s+(.*\S)\s*$"
    level = F.when(F.col("line").rlike(mark), F.length(F.regexp_extract("line", mark, 1)))
    rows = line.withColumns({"level": level, "title": F.when(level.isNotNull(), F.regexp_extract("line", mark, 2))})
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.count("level").over(w))
    for n in range(1, 5):
        # the last heading of this level, unless a higher one came after it
        at = F.max(F.when(F.col("level") == n, F.col("i"))).over(w)
        above = F.max(F.when(F.col("level") < n, F.col("i"))).over(w)
        title = F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(w)
        rows = rows.withColumn(f"h{n}", F.when(at > F.coalesce(above, F.lit(-1)), title))
    path = F.array_compact(F.array("h1", "h2", "h3", "h4"))
    cut = rows.groupBy(key, "section").agg(F.max(F.struct("i", path.alias("path")))["path"].alias("path"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("ls"))
    content = T.strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    out = cut.select(key, "section", F.array_join("path", " > ").alias("section_path"), F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")).alias("heading"), F.size("path").cast("long").alias("heading_level"), content.alias("content"))
    return out.filter("content <> ''")


def hybrid_chunks(docs: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sections that fit as they are, longer ones split further; numbered within the document."""
    names = ["section_path", "heading", "heading_level"]
    # sections are dealt by the key already, so a document comes together without another shuffle
    whole = sections(docs, key, text).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", *names, "content"))).alias("parts"))

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                piece, out = batch.slice(at, 100), []
                for k, parts in zip(piece.column("key").to_pylist(), piece.column("parts").to_pylist(), strict=True):
                    made = [(p, c) for p in parts for c in ([p["content"]] if len(p["content"]) <= size else split_text(p["content"], size, overlap))]
                    out += [(k, *[p[n] for n in names], c, i, len(made)) for i, (p, c) in enumerate(made)]
                kinds = [piece.column("key").type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                cols = zip(*out, strict=True) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, *names, "chunk", "chunk_index", "total_chunks"])

    kind = docs.schema[key].dataType.simpleString()
    return whole.select(F.col(key).alias("key"), "parts").mapInArrow(split, f"{key} {kind}, section_path string, heading string, heading_level long, chunk string, chunk_index long, total_chunks long")


def semantic_groups(sentences: DataFrame, key: str, order: str, vector: str, threshold: float = 0.75) -> DataFrame:
    """sentences with `group`: a new one begins where neighbours are less alike than the threshold."""
    from .search import cosine

    w = Window.partitionBy(key).orderBy(order)
    near = cosine(F.col(vector), F.lag(vector).over(w))
    breaks = F.when(F.lag(vector).over(w).isNull(), 0).when(near < threshold, 1).otherwise(0)
    return sentences.withColumn("break_", breaks).withColumn("group", F.sum("break_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("break_")


def provenance_exact(chunks: DataFrame, originals: DataFrame, key: str, index: str, chunk: str, text: str) -> DataFrame:
    """The first place of each chunk in its document, or -1, and the method."""
    joined = chunks.join(originals.select(key, F.col(text).alias("original_")), key)
    at = F.position(F.col(chunk), F.col("original_")) - 1
    found = (at >= 0) & (F.length(chunk) > 0)
    return joined.select(key, index, F.when(found, at).otherwise(-1).cast("long").alias("char_start"), F.when(found, at + F.length(chunk)).otherwise(-1).cast("long").alias("char_end"), F.when(found, "exact_global").otherwise("unmapped").alias("method"))


def _fuzzy(text: str, anchor: str) -> tuple[int, int, float]:
    """The paragraph most like the anchor, by difflib's ratio of their lower-cased heads."""
    from difflib import SequenceMatcher

    best, at = (-1, -1, 0.0), 0
    for part in text.split("\n\n"):
        if part.strip():
            ratio = SequenceMatcher(None, anchor[:220].lower(), part.strip()[:600].lower()).ratio()
            if ratio > best[2]:
                best = (at, at + len(part), ratio)
        at += len(part) + 2
    return best


def provenance(chunks: DataFrame, documents: DataFrame, key: str, index: str, chunk: str, original: str, refactored: str) -> DataFrame:
    """Where each chunk stands in the refactored and the original text, with method and confidence.

    A document's chunks are followed in order, since a search starts where the last one ended: they come
    as one array beside its texts, which are moved once. Exact places come first, then the most similar
    paragraph of the original. Chunks of unknown documents have no row.
    """
    columns = "refactored_start long, original_start long, original_end long, method string, confidence double"

    def place(text, part, start):
        if not text or not part:
            return -1, "missing"
        found = text.find(part, start)
        if found >= 0:
            return found, "exact_cursor"
        found = text.find(part)
        return found, "exact_global" if found >= 0 else "not_found"

    def follow(batches):
        import pyarrow as pa

        for batch in slices(batches, "source", rows=16):
            out = []
            for k, parts, source, made in zip(*(batch.column(c).to_pylist() for c in ("key", "parts", "source", "made")), strict=True):
                at_original = at_refactored = 0
                source, made = source or "", made or ""
                for part in parts:
                    number, part = part["i"], part["c"] or ""
                    m, how_made = place(made, part, at_refactored)
                    o, how = place(source, part, at_original)
                    size, sure = len(part), 1.0 if o >= 0 else 0.0
                    if o < 0:
                        start, end, ratio = _fuzzy(source, part) if source.strip() and part.strip() else (-1, -1, 0.0)
                        if start >= 0 and ratio >= 0.45:
                            o, size, how, sure = start, end - start, "paragraph_fuzzy", round(min(0.79, ratio), 3)
                        else:
                            how = "unmapped"
                    at_refactored = m + len(part) if m >= 0 else at_refactored
                    at_original = o + size if o >= 0 else at_original
                    out.append((k, number, m, o, o + size if o >= 0 else -1, f"{how_made}->{how}", sure))
            kinds = (batch.column("key").type, *[pa.int64()] * 4, pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)], [key, index, "refactored_start", "original_start", "original_end", "method", "confidence"])

    parts = chunks.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct(F.col(index).cast("long").alias("i"), F.col(chunk).alias("c")))).alias("parts"))
    texts = documents.select(F.col(key).alias("key"), F.col(original).alias("source"), F.col(refactored).alias("made"))
    kind = chunks.schema[key].dataType.simpleString()
    return parts.join(texts, "key").select("key", "parts", "source", "made").mapInArrow(follow, f"{key} {kind}, {index} long, {columns}")


def chosen_chunks(files: DataFrame, key: str, kind: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunker, section_path, chunk, chunk_index, total_chunks): each file by the chunker for its kind.

    `code` is cut by its syntax tree, `markdown` by its headings, anything else recursively. Code that has no
    syntax tree falls back to the headings, and a document in which these leave nothing to the recursive splitter.
    """
    from ..sources.code import parses, python_chunks

    rows = files.select(key, F.col(text).alias("text"), F.col(kind).alias("kind_"))
    rows = rows.withColumn("by_", F.when((F.col("kind_") == "code") & parses(F.col("text")), "code").when(F.col("kind_").isin("code", "markdown"), "markdown").otherwise("recursive"))
    rows = checkpointed(rows.drop("kind_"), "chosen")
    of = lambda name: rows.filter(F.col("by_") == name)
    code = python_chunks(of("code"), key).select(key, F.lit("code").alias("chunker"), "section_path", "chunk", F.lit(None).cast("long").alias("chunk_index"))
    marked = hybrid_chunks(of("markdown"), key, "text", size, overlap).select(key, F.lit("markdown").alias("chunker"), "section_path", "chunk", "chunk_index")
    plain = recursive_chunks(of("recursive"), key, "text", size, overlap).select(key, F.lit("recursive").alias("chunker"), F.lit("").alias("section_path"), "chunk", "chunk_index")
    every = code.unionByName(marked).unionByName(plain)
    w = Window.partitionBy(key)
    index = F.row_number().over(w.orderBy("chunk_index", "section_path", "chunk")) - 1
    return every.withColumns({"chunk_index": index.cast("long"), "total_chunks": F.count("*").over(w)})
