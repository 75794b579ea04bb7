"""Identity and duplicates (D, F6, J8, U rows of the inventory). Documents stand in for chunks, their lines for chunks of a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..registry import query, table
from ..sources.checkpoint import checkpointed
from . import sql as S

HASH = f"sha256({S.strip(S.collapse('text'))})"
QUALITY = "least(1.0, 0.4 + CASE WHEN length(line) >= 120 THEN 0.2 ELSE 0.0 END + least(0.2, length(regexp_replace(line, '[^\\p{Nd}]', '', 'g')) * 0.01::DOUBLE))"
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS idx FROM documents"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def line_chunks(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("idx", "line"))


@query("d1_content_hash", f"SELECT doc_id, {HASH} AS content_hash FROM documents")
def d1(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normal_hash(F.col("text")).alias("content_hash"))


@query("f6_quality_filter", f"SELECT doc_id, idx FROM ({LINES}) WHERE length({S.strip('line')}) >= 40 AND {QUALITY} >= 0.45")
def f6(spark, sf_dir):
    return D.accepted(line_chunks(spark, sf_dir), "line").select("doc_id", "idx")


@query(
    "d2_within_document",
    f"""
    SELECT doc_id, idx FROM (
      SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id, {S.strip(S.collapse('lower(line)'))} ORDER BY idx) AS rn
      FROM ({LINES}) WHERE length({S.strip('line')}) >= 40 AND {QUALITY} >= 0.45)
    WHERE rn = 1
    """,
)
def d2(spark, sf_dir):
    return D.first_of_each(D.accepted(line_chunks(spark, sf_dir), "line"), "doc_id", "idx", "line").select("doc_id", "idx")


@query("d3_merge_exact", f"SELECT {HASH} AS content_hash, min(doc_id) AS canonical_id, list_sort(list(DISTINCT source)) AS source_documents, count(*) AS n_copies FROM documents GROUP BY 1")
def d3(spark, sf_dir):
    return D.merge_exact(docs(spark, sf_dir), "doc_id", "source")


EVENTS = f"""
    SELECT h AS canonical_content_hash, c AS canonical_id, doc_id AS id, source AS merged_source_key, 'exact' AS match_tier, 1.0::DOUBLE AS similarity_score, false AS canonical_replaced, 'merged' AS action
    FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS c FROM (SELECT *, {HASH} AS h FROM documents WHERE source NOT IN ('src3'))) WHERE doc_id <> c
    UNION ALL
    SELECT {HASH}, doc_id, doc_id, source, 'exact', 0.0::DOUBLE, false, 'override_skipped' FROM documents WHERE source IN ('src3')
"""


@query("d9_merge_events", EVENTS)
def d9(spark, sf_dir):
    return D.merge_events(docs(spark, sf_dir), "doc_id", "source", override=["src3"])


@query("d15_dedup_stats", f"SELECT action, match_tier, count(*) AS n, count(DISTINCT merged_source_key) AS sources FROM ({EVENTS}) GROUP BY 1, 2")
def d15(spark, sf_dir):
    return d9(spark, sf_dir).groupBy("action", "match_tier").agg(F.count("*").alias("n"), F.countDistinct("merged_source_key").alias("sources"))


W = S.words("lower(text)")
SHINGLES = f"list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))"


@query("d5_shingles", f"SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE len({SHINGLES}) END AS BIGINT) AS n_shingles FROM (SELECT doc_id, {W} AS w FROM documents)")
def d5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.size(D.shingles(F.col("text"))).cast("long").alias("n_shingles"))


LEAST = ", ".join(f"min(({a}::BIGINT * h + {b}) % {D.PRIME})" for a, b in D.coefficients())


def signed_sql(rows: str) -> str:
    return f"""
    SELECT id, [{LEAST}] AS signature FROM (
      SELECT doc_id AS id, CAST('0x' || substr(md5(unnest({SHINGLES})), 1, 7) AS BIGINT) AS h FROM (SELECT doc_id, {W} AS w FROM {rows}) WHERE len(w) > 0)
    GROUP BY id
"""


@query("d6_minhash", f"SELECT id, md5(array_to_string(signature, ',')) AS signature_md5 FROM ({signed_sql('documents')})")
def d6(spark, sf_dir):
    signed = D.minhash(docs(spark, sf_dir), "doc_id")
    return signed.select("id", F.md5(F.array_join("signature", ",").cast("binary")).alias("signature_md5"))


@query(
    "d7_similarity",
    f"""
    WITH s AS (SELECT id, signature FROM ({signed_sql('documents')})), w AS (SELECT doc_id AS id, {W} AS w FROM documents), sh AS (SELECT id, {SHINGLES} AS s FROM w WHERE len(w) > 0)
    SELECT a.id, b.id AS next_id, round(len(list_filter(range(1, 129), lambda i: a.signature[i] = b.signature[i])) / 128.0, 6)::DOUBLE AS estimate,
           round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE, 6)::DOUBLE AS exact
    FROM s a JOIN s b ON b.id = a.id + 1 JOIN sh x ON x.id = a.id JOIN sh y ON y.id = b.id
    """,
)
def d7(spark, sf_dir):
    """Texts are moved, not their runs, which are several times as long; signatures are written, since both sides read them."""
    rows = docs(spark, sf_dir)
    signed = checkpointed(D.minhash(rows, "doc_id"), "signed").join(rows.select(F.col("doc_id").alias("id"), "text"), "id")
    after = signed.select((F.col("id") - 1).alias("id"), F.col("id").alias("next_id"), F.col("signature").alias("signature2"), F.col("text").alias("text2"))
    pairs = signed.join(after, "id").withColumns({"s": D.shingles(F.col("text")), "s2": D.shingles(F.col("text2"))})
    return pairs.select(
        "id", "next_id", F.round(D.estimated_similarity(F.col("signature"), F.col("signature2")), 6).alias("estimate"), F.round(D.similarity(F.col("s"), F.col("s2")), 6).alias("exact")
    )


@query(
    "d4_fuzzy_matches",
    f"""
    WITH kept AS (SELECT * FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM (SELECT doc_id, {HASH} AS h FROM documents) GROUP BY h)),
    sig AS ({signed_sql('kept')}),
    b AS (SELECT id, unnest(list_transform(range(0, 16), lambda b: b || ':' || array_to_string(list_slice(signature, b * 8 + 1, b * 8 + 8), ','))) AS bucket FROM sig),
    p AS (SELECT DISTINCT b.id, l.id AS c FROM b JOIN b l ON l.bucket = b.bucket AND l.id < b.id),
    w AS (SELECT doc_id AS id, length(text) AS n, {W} AS w FROM kept), sh AS (SELECT id, n, {SHINGLES} AS s FROM w WHERE len(w) > 0),
    sc AS (SELECT p.id, p.c, len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE AS j, x.n > y.n AS r FROM p JOIN sh x ON x.id = p.id JOIN sh y ON y.id = p.c)
    SELECT id, c AS canonical_id, round(j, 6)::DOUBLE AS similarity, CASE WHEN r THEN 'replaced' ELSE 'merged' END AS action
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY j DESC, c) AS rn FROM sc WHERE j >= 0.95) WHERE rn = 1
    """,
)
def d4(spark, sf_dir):
    return D.fuzzy_matches(docs(spark, sf_dir), "doc_id")


MERGED = f"SELECT {HASH} AS content_hash, list_sort(list(DISTINCT source)) AS source_documents FROM documents GROUP BY 1"


@query("d11_remove_source", f"SELECT content_hash, list_filter(source_documents, lambda s: s <> 'src1') AS source_documents FROM ({MERGED}) WHERE len(list_filter(source_documents, lambda s: s <> 'src1')) > 0")
def d11(spark, sf_dir):
    return D.remove_source(d3(spark, sf_dir).select("content_hash", "source_documents"), "src1")


@query("d12_append_source", f"SELECT content_hash, CASE WHEN list_contains(source_documents, 'src1') THEN source_documents ELSE list_append(source_documents, 'src1') END AS source_documents FROM ({MERGED})")
def d12(spark, sf_dir):
    return d3(spark, sf_dir).select("content_hash", D.append_source(F.col("source_documents"), F.lit("src1")).alias("source_documents"))


@query(
    "d13_revert_merges",
    f"""
    WITH e AS ({EVENTS}), u AS (SELECT canonical_content_hash AS h, list(DISTINCT merged_source_key) AS gone FROM e WHERE action = 'merged' GROUP BY 1)
    SELECT content_hash, CASE WHEN gone IS NULL THEN source_documents ELSE list_filter(source_documents, lambda s: NOT list_contains(gone, s)) END AS source_documents
    FROM ({MERGED}) LEFT JOIN u ON u.h = content_hash
    """,
)
def d13(spark, sf_dir):
    return D.revert_merges(d3(spark, sf_dir).select("content_hash", "source_documents"), d9(spark, sf_dir).filter("action = 'merged'"))


@query("d14_update_content", f"SELECT doc_id, text, {HASH} AS content_hash FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new ' || doc_id ELSE text END AS text FROM documents)")
def d14(spark, sf_dir):
    changes = docs(spark, sf_dir).filter("doc_id % 10 = 0").select("doc_id", F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("new_text"))
    return D.update_content(docs(spark, sf_dir).select("doc_id", "text"), changes, "doc_id")


UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


@query(
    "d17_chunk_ids",
    f"""
    WITH r AS (SELECT doc_id, source, text, CASE doc_id % 3 WHEN 0 THEN upper({S.uuid5("'x' || doc_id")}) WHEN 1 THEN 'name ' || doc_id ELSE ' ' END AS raw FROM documents),
    k AS (SELECT *, source || ':' || doc_id || ':' || sha256(text) AS own FROM r)
    SELECT doc_id, CASE WHEN regexp_matches(raw, {S.q(UUID)}) THEN lower(raw) WHEN trim(raw) = '' THEN {S.uuid5('own')} ELSE {S.uuid5('raw')} END AS chunk_id FROM k
    """,
)
def d17(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 3 == 0, F.upper(T.uuid5(F.concat(F.lit("x"), n)))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("name "), n)).otherwise(F.lit(" "))
    rows = docs(spark, sf_dir).withColumn("raw", raw)
    own = T.chunk_id(F.col("source"), F.col("doc_id"), F.col("text"))
    return rows.select("doc_id", F.when(F.col("raw").rlike(UUID), F.lower("raw")).when(F.trim("raw") == "", own).otherwise(T.uuid5(F.col("raw"))).alias("chunk_id"))


@query("d18_document_ids", f"SELECT source, {S.uuid5('k')} AS document_id FROM (SELECT DISTINCT source, 'doc:' || source AS k FROM documents)")
def d18(spark, sf_dir):
    return docs(spark, sf_dir).select("source").distinct().select("source", T.uuid5(F.concat(F.lit("doc:"), F.col("source"))).alias("document_id"))


@query(
    "d19_collections_merged",
    f"""
    WITH h AS (SELECT doc_id, {HASH} AS k, 'a' AS collection, round((doc_id % 97) / 97.0::DOUBLE, 6) AS score FROM documents UNION ALL SELECT doc_id, {HASH}, 'b', round((doc_id % 89) / 89.0::DOUBLE, 6) FROM documents)
    SELECT k, doc_id, collection, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id, collection) AS rn FROM h) WHERE rn = 1
    """,
)
def d19(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.normal_hash(F.col("text")).alias("k"))
    part = lambda name, m: rows.withColumns({"collection": F.lit(name), "score": F.round((F.col("doc_id") % m) / F.lit(float(m)), 6)})
    return D.best_of_each(part("a", 97).unionByName(part("b", 89)), F.col("k"), "score", "doc_id", "collection").select("k", "doc_id", "collection", "score")


CHANGES = """
    WITH old AS (SELECT doc_id AS k, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id AS k, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)
    SELECT coalesce(old.k, new.k) AS source_key, CASE WHEN old.k IS NULL THEN 'added' WHEN new.k IS NULL THEN 'deleted' WHEN old.h <> new.h THEN 'modified' ELSE 'unchanged' END AS change FROM old FULL JOIN new ON old.k = new.k
"""


@query("j7_changed_files", CHANGES)
def j7(spark, sf_dir):
    from ..operators.lifecycle import changes

    old = docs(spark, sf_dir).filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("source_key"), F.sha2("text", 256).alias("h"))
    new = docs(spark, sf_dir).filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("source_key"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return changes(old, new, "source_key", "h")


@query("d20_reingest", f"SELECT change, count(*) AS n, CAST(count(*) FILTER (WHERE change IN ('modified', 'deleted')) AS BIGINT) AS chunks_deleted, CAST(count(*) FILTER (WHERE change IN ('modified', 'added')) AS BIGINT) AS chunks_inserted FROM ({CHANGES}) GROUP BY change")
def d20(spark, sf_dir):
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return j7(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"), n("modified", "deleted").alias("chunks_deleted"), n("modified", "added").alias("chunks_inserted"))


@query(
    "d8_clusters",
    f"""
    WITH RECURSIVE h AS (SELECT doc_id AS id, text, {HASH} AS h FROM documents), kept AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT min(id) FROM h GROUP BY h)),
    sig AS ({signed_sql('kept')}),
    b AS (SELECT id, unnest(list_transform(range(0, 16), lambda b: b || ':' || array_to_string(list_slice(signature, b * 8 + 1, b * 8 + 8), ','))) AS bucket FROM sig),
    p AS (SELECT DISTINCT b.id, l.id AS c FROM b JOIN b l ON l.bucket = b.bucket AND l.id < b.id),
    w AS (SELECT doc_id AS id, {W} AS w FROM kept), sh AS (SELECT id, {SHINGLES} AS s FROM w WHERE len(w) > 0),
    l AS MATERIALIZED (SELECT p.id, p.c FROM p JOIN sh x ON x.id = p.id JOIN sh y ON y.id = p.c WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s)))::DOUBLE >= 0.8),
    e AS (SELECT id AS a, c AS b FROM l UNION ALL SELECT c, id FROM l),
    r(id, seen) AS (SELECT doc_id, doc_id FROM kept UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
    SELECT h.id, f.cluster FROM h JOIN (SELECT h, min(id) AS first FROM h GROUP BY h) g USING (h) JOIN (SELECT id, min(seen) AS cluster FROM r GROUP BY id) f ON f.id = g.first
    """,
)
def d8(spark, sf_dir):
    return D.near_duplicate_clusters(docs(spark, sf_dir), "doc_id", threshold=0.8)
