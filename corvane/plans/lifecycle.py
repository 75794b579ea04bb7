"""Lifecycle, listings, security tables and joins (L, A1 to A4, J1 to J6, J21, J22, O2, O6, O7, U, P1 to P3, S13 to S20, S27 rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lifecycle as L
from ..registry import query, table
from . import sql as S


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


CHUNK_COUNTS = """
    WITH c AS (SELECT source AS source_key, lang, count(*) AS n FROM documents WHERE source LIKE '%src%' GROUP BY 1, 2)
    SELECT source_key, CAST(sum(n) AS BIGINT) AS chunk_count, max_by(lang, (n, -ascii(lang), -ascii(substr(lang, 2, 1)))) AS connector FROM c GROUP BY source_key
"""


@query("a1_chunk_counts", CHUNK_COUNTS)
def a1(spark, sf_dir):
    """Counts by source and the most frequent connector, the first in the alphabet of equal ones; no mode(), whose ties are open."""
    counts = docs(spark, sf_dir).filter(F.col("source").like("%src%")).groupBy(F.col("source").alias("source_key"), F.col("lang").alias("connector")).agg(F.count("*").alias("n"))
    best = F.min(F.struct(-F.col("n"), "connector"))
    return counts.groupBy("source_key").agg(F.sum("n").alias("chunk_count"), best.alias("b")).select("source_key", "chunk_count", F.col("b.connector").alias("connector"))


@query("a2_collection_stats", "SELECT count(*) AS total_chunks, count(DISTINCT source) AS documents, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de FROM documents")
def a2(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count("*").alias("total_chunks"), F.countDistinct("source").alias("documents"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"))


@query("a3_collections", "SELECT lang AS collection, count(*) AS chunks FROM documents GROUP BY lang")
def a3(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("chunks"))


@query("a4_source_rollup", f"SELECT connector, count(*) AS document_count, CAST(sum(chunk_count) AS BIGINT) AS chunk_count FROM ({CHUNK_COUNTS}) GROUP BY connector")
def a4(spark, sf_dir):
    return a1(spark, sf_dir).groupBy("connector").agg(F.count("*").alias("document_count"), F.sum("chunk_count").alias("chunk_count"))


@query(
    "j1_listing_page",
    """
    WITH s AS (SELECT doc_id, 'Title ' || doc_id AS title FROM documents WHERE doc_id % 3 <> 0)
    SELECT d.doc_id, coalesce(title, 'd' || d.doc_id) AS title, count(*) OVER () AS total FROM documents d LEFT JOIN s USING (doc_id) ORDER BY d.doc_id LIMIT 25 OFFSET 50
    """,
)
def j1(spark, sf_dir):
    """Listing joined with its sidecars, then one page of 25: the page is the feature."""
    rows = docs(spark, sf_dir).select("doc_id")
    side = rows.filter("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"))
    listed = rows.join(side, "doc_id", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    total = rows.agg(F.count("*").alias("total"))
    return listed.orderBy("doc_id").offset(50).limit(25).crossJoin(F.broadcast(total))


@query(
    "j2_documents_with_counts",
    f"SELECT s.s_suppkey AS document, coalesce(c.chunk_count, 0) AS chunk_count, coalesce(connector, 'none') AS connector FROM supplier s LEFT JOIN ({CHUNK_COUNTS}) c ON c.source_key = 'src' || s.s_suppkey",
)
def j2(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("document"), F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source_key"))
    joined = suppliers.join(a1(spark, sf_dir), "source_key", "left")
    return joined.select("document", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("connector", F.lit("none")).alias("connector"))


INVENTORY = """
    SELECT 'manifest' AS store, doc_id AS source_key FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 17 <> 0
    UNION SELECT 'vectors', doc_id FROM documents WHERE doc_id % 3 <> 0 UNION SELECT 'objects', doc_id FROM documents WHERE doc_id % 4 <> 0
"""


def inventoried(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("source_key"))
    manifest = rows.filter("source_key % 5 <> 0").withColumn("deleted", F.col("source_key") % 17 == 0)
    return L.inventory(manifest, {"vectors": rows.filter("source_key % 3 <> 0"), "objects": rows.filter("source_key % 4 <> 0")})


@query("l1_inventory", INVENTORY)
def l1(spark, sf_dir):
    return inventoried(spark, sf_dir)


@query(
    "l2_orphans",
    f"""
    WITH i AS ({INVENTORY}), m AS (SELECT source_key FROM i WHERE store = 'manifest')
    SELECT store || '_orphan' AS kind, source_key FROM i WHERE store <> 'manifest' AND source_key NOT IN (SELECT source_key FROM m)
    UNION ALL SELECT 'manifest_only', source_key FROM m WHERE source_key NOT IN (SELECT source_key FROM i WHERE store <> 'manifest')
    """,
)
def l2(spark, sf_dir):
    return L.orphans(inventoried(spark, sf_dir))


@query(
    "l3_orphan_report",
    f"""
    WITH i AS ({INVENTORY}), m AS (SELECT source_key FROM i WHERE store = 'manifest'),
    o AS (SELECT store || '_orphan' AS kind, source_key FROM i WHERE store <> 'manifest' AND source_key NOT IN (SELECT source_key FROM m) UNION ALL SELECT 'manifest_only', source_key FROM m WHERE source_key NOT IN (SELECT source_key FROM i WHERE store <> 'manifest'))
    SELECT '{{"kind":"' || kind || '","n":' || count(*) || ',"first_key":' || min(source_key) || '}}' AS report FROM o GROUP BY kind
    """,
)
def l3(spark, sf_dir):
    kinds = l2(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min("source_key").alias("first_key"))
    return kinds.select(F.to_json(F.struct("kind", "n", "first_key")).alias("report"))


@query("j3_orphans_by_difference", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 <> 0")
def j3(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id")
    return rows.filter("doc_id % 3 <> 0").join(rows.filter("doc_id % 5 <> 0"), "doc_id", "left_anti")


@query("j5_removed_sources", "SELECT source || '/' || doc_id AS source FROM documents WHERE doc_id % 7 = 0")
def j5(spark, sf_dir):
    """The manifest knows every document; each seventh is gone from the sources."""
    manifest = docs(spark, sf_dir).select("doc_id", F.concat_ws("/", "source", "doc_id").alias("source"))
    return manifest.select("source").join(manifest.filter("doc_id % 7 <> 0"), "source", "left_anti")


@query(
    "j6_priority_match",
    """
    WITH s AS (SELECT doc_id AS source, CASE WHEN doc_id % 4 = 0 THEN 'k' || doc_id END AS k1, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id END AS k2, 'n' || (doc_id // 2) AS k3 FROM documents),
    m AS (SELECT doc_id AS entry, 'k' || (doc_id + 4) AS k1, 'u' || (doc_id * 3) AS k2, CASE WHEN doc_id % 5 = 0 THEN 'n' || doc_id END AS k3 FROM documents),
    h AS (SELECT source, entry, 0 AS p FROM s JOIN m USING (k1) UNION ALL SELECT source, entry, 1 FROM s JOIN m USING (k2) UNION ALL SELECT source, entry, 2 FROM s JOIN m USING (k3))
    SELECT s.source, coalesce(b.entry, -1) AS entry, coalesce(b.p, -1) AS matched_by FROM s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, entry) AS rn FROM h) b ON b.source = s.source AND rn = 1
    """,
)
def j6(spark, sf_dir):
    rows, n = docs(spark, sf_dir), F.col("doc_id")
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    sources = rows.select(n.alias("source"), F.when(n % 4 == 0, name("k", n)).alias("k1"), F.when(n % 3 == 0, name("u", n)).alias("k2"), name("n", F.floor(n / 2)).alias("k3"))
    manifest = rows.select(n.alias("entry"), name("k", n + 4).alias("k1"), name("u", n * 3).alias("k2"), F.when(n % 5 == 0, name("n", n)).alias("k3"))
    return L.matched_entries(sources, manifest, ["k1", "k2", "k3"]).na.fill(-1, ["entry", "matched_by"])


MANIFEST = "SELECT doc_id AS source_key, doc_id % 6 = 0 AS deleted, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 12 = 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE 'never' END END AS deleted_at, ['1.0.0', '1.1.0', '0.9.0'][CAST(doc_id % 3 AS INTEGER) + 1] AS schema_version FROM documents"


def manifest(spark, sf_dir):
    n = F.col("doc_id")
    at = F.when(n % 6 == 0, F.when(n % 12 == 0, F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))).otherwise("never"))
    version = F.get(F.array(F.lit("1.0.0"), F.lit("1.1.0"), F.lit("0.9.0")), (n % 3).cast("int"))
    return docs(spark, sf_dir).select(n.alias("source_key"), (n % 6 == 0).alias("deleted"), at.alias("deleted_at"), version.alias("schema_version"))


@query("l4_soft_delete", f"SELECT source_key, deleted OR source_key % 10 = 1 AS deleted, CASE WHEN source_key % 10 = 1 THEN '2024-03-01' ELSE deleted_at END AS deleted_at FROM ({MANIFEST})")
def l4(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return L.collect_garbage(m, m.filter("source_key % 10 = 1"), "soft", F.lit("2024-03-01")).select("source_key", "deleted", "deleted_at")


@query("l4_hard_delete", f"SELECT source_key FROM ({MANIFEST}) WHERE source_key % 10 <> 1")
def l4h(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return L.collect_garbage(m, m.filter("source_key % 10 = 1"), "hard", F.lit("2024-03-01")).select("source_key")


@query("l5_retention", f"SELECT source_key, deleted_at FROM ({MANIFEST}) WHERE deleted AND TRY_CAST(deleted_at AS TIMESTAMP) < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def l5(spark, sf_dir):
    return L.expired(manifest(spark, sf_dir), F.lit("2024-02-15").cast("timestamp")).select("source_key", "deleted_at")


@query(
    "l6_migration_plan",
    f"SELECT source_key, schema_version AS from_version, CASE schema_version WHEN '1.0.0' THEN 'full_phase2' WHEN '1.1.0' THEN 'kg_reextract' ELSE 'metadata_only' END AS strategy FROM ({MANIFEST}) WHERE NOT deleted AND schema_version <> '1.2.0'",
)
def l6(spark, sf_dir):
    log = spark.createDataFrame([(0, "1.0.0", "none"), (1, "1.1.0", "full_phase2"), (2, "1.2.0", "kg_reextract")], "place int, version string, strategy string")
    return L.plan_migration(manifest(spark, sf_dir), log, "1.2.0")


@query("l7_migration_status", f"SELECT source_key, CASE WHEN deleted OR schema_version = '1.2.0' THEN schema_version ELSE '1.2.0' END AS schema_version FROM ({MANIFEST})")
def l7(spark, sf_dir):
    plan = l6(spark, sf_dir).select("source_key", "strategy")
    joined = manifest(spark, sf_dir).join(plan, "source_key", "left")
    return joined.select("source_key", F.when(F.col("strategy").isNotNull() & (F.col("strategy") != "none"), "1.2.0").otherwise(F.col("schema_version")).alias("schema_version"))


@query("l8_validation", "SELECT doc_id AS trace_id, doc_id % 3 <> 0 AS vectors, doc_id % 4 <> 0 AS objects, NULL::BOOLEAN AS graph, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS consistent FROM documents")
def l8(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("trace_id"))
    return L.consistency(rows, {"vectors": rows.filter("trace_id % 3 <> 0"), "objects": rows.filter("trace_id % 4 <> 0"), "graph": None})


@query("l11_queue_routing", "SELECT event_id, CASE event_type WHEN 'click' THEN 'high' WHEN 'view' THEN 'normal' ELSE 'low' END AS priority, CASE event_type WHEN 'click' THEN 'interactive' WHEN 'view' THEN 'interactive' ELSE 'background' END AS queue FROM events")
def l11(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", F.when(kind == "click", "high").when(kind == "view", "normal").otherwise("low").alias("priority"), F.when(kind.isin("click", "view"), "interactive").otherwise("background").alias("queue"))


@query("o6_validation_sample", "SELECT doc_id FROM documents ORDER BY sha256(doc_id || ':7'), doc_id LIMIT 20")
def o6(spark, sf_dir):
    """A seeded sample: its size is the feature."""
    return docs(spark, sf_dir).select("doc_id").orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":7")), 256), "doc_id").limit(20)


@query("o7_last_log_entries", "SELECT conv_id, array_to_string(list_slice(l, greatest(1, len(l) - 2), len(l)), '|') AS last_turns FROM (SELECT conv_id, list(turn ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def o7(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("l"))
    last = F.slice("l", F.greatest(F.lit(1), F.size("l") - 2), 3)
    return turns.select("conv_id", F.array_join(last.cast("array<string>"), "|").alias("last_turns"))


@query("u3_types_in_common", "SELECT a.source AS a, b.source AS b, len(list_intersect(a.l, b.l)) > 0 AS overlap FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source) a JOIN (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY source) b ON b.source = a.source || '0'")
def u3(spark, sf_dir):
    langs = docs(spark, sf_dir).groupBy("source").agg(F.collect_set("lang").alias("l"))
    other = langs.select(F.col("source").alias("b"), F.col("l").alias("m"))
    return langs.join(other, F.concat(F.col("source"), F.lit("0")) == F.col("b")).select(F.col("source").alias("a"), "b", F.arrays_overlap("l", "m").alias("overlap"))


@query("s13_source_identity", "SELECT doc_id, 'local_fs:' || (doc_id % 4) || ':' || doc_id AS source_key, doc_id * 1000 AS version FROM documents")
def s13(spark, sf_dir):
    n = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", F.concat_ws(":", F.lit("local_fs"), (n % 4).cast("string"), n.cast("string")).alias("source_key"), (n * 1000).alias("version"))


@query("s18_vector_upsert", "SELECT vec_id, label::BIGINT + 100 AS label FROM embeddings WHERE vec_id % 4 = 0 UNION ALL SELECT vec_id, label::BIGINT FROM embeddings WHERE vec_id % 4 <> 0")
def s18(spark, sf_dir):
    from ..sources.tables import upsert

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return upsert(rows, rows.filter("vec_id % 4 = 0").withColumn("label", F.col("label") + 100), "vec_id")


@query("s27_cache_expiry", "SELECT event_id FROM events WHERE epoch_us(ts) + CAST((event_id % 120) AS BIGINT) * 1000000 > (SELECT epoch_us(max(ts)) - 60000000 FROM events)")
def s27(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    now = rows.agg((F.max("us") - 60_000_000).alias("now"))
    return rows.crossJoin(F.broadcast(now)).filter(F.col("us") + F.col("event_id") % 120 * 1_000_000 > F.col("now")).select("event_id")


@query("j21_quotas", "SELECT c_custkey, coalesce(q.quota, 60) AS quota FROM customer LEFT JOIN (SELECT n_nationkey, 10 * n_nationkey AS quota FROM nation WHERE n_nationkey % 2 = 0) q ON q.n_nationkey = c_nationkey")
def j21(spark, sf_dir):
    quotas = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), (10 * F.col("n_nationkey")).alias("quota"))
    return table(spark, sf_dir, "customer").join(quotas, "c_nationkey", "left").select("c_custkey", F.coalesce("quota", F.lit(60)).alias("quota"))


@query("p1_active_keys", "SELECT c_custkey AS key_id, sha256(c_name) AS key_hash FROM customer WHERE c_custkey % 4 <> 0")
def p1(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), F.sha2("c_name", 256).alias("key_hash"), F.when(F.col("c_custkey") % 4 == 0, "2024-01-01").alias("revoked_at"))
    return keys.filter("revoked_at is null").select("key_id", "key_hash")


@query("p2_effective_tenant", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'other' ELSE c_mktsegment END AS tenant, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS may_write FROM customer")
def p2(spark, sf_dir):
    n = F.col("c_custkey")
    roles = F.array_compact(F.array(F.when(n % 3 == 0, "admin"), F.when(n % 5 == 0, "writer")))
    asked = F.when(n % 2 == 0, "other")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", roles.alias("roles"), asked.alias("asked"))
    admin = F.array_contains("roles", "admin")
    return rows.select("c_custkey", F.when(admin & F.col("asked").isNotNull(), F.col("asked")).otherwise(F.col("c_mktsegment")).alias("tenant"), (admin | F.array_contains("roles", "writer")).alias("may_write"))


@query("p10_cache_keys", """SELECT item_id, sha256('{"alpha":0.5,"limit":10,"query":' || to_json(text) || '}') AS cache_key FROM benchmark""")
def p10(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.lit(0.5).alias("alpha"), F.lit(10).alias("limit"), F.col("text").alias("query"), "item_id")
    return rows.select("item_id", F.sha2(F.to_json(F.struct("alpha", "limit", "query")), 256).alias("cache_key"))


@query("s20_visual_pages", "SELECT page_id, url, 2 AS version FROM pages WHERE page_id % 6 = 0 AND page_id % 4 <> 0 UNION ALL SELECT page_id, url, 1 FROM pages WHERE page_id % 6 <> 0 AND page_id % 4 <> 0")
def s20(spark, sf_dir):
    """Pages are inserted without their mean vectors, some again, and those of deleted documents go."""
    from ..sources.tables import delete, upsert

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit(1).alias("version"), F.array(F.lit(0.0)).alias("mean_vector")).drop("mean_vector")
    again = pages.filter("page_id % 6 = 0").withColumn("version", F.lit(2))
    return delete(upsert(pages, again, "page_id"), pages.filter("page_id % 4 = 0"), "page_id")


@query("s19_ranked_sources", f"SELECT source, n, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def s19(spark, sf_dir):
    counts = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))  # one row a source
    return counts.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))))


@query("m_text_stats", f"SELECT lang, count(*) AS n, CAST(sum(len({S.words('text')})) AS BIGINT) AS n_words FROM documents GROUP BY lang")
def text_stats(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.size(T.words(F.col("text")))).alias("n_words"))


@query(
    "s17_store_objects",
    """
    SELECT 'src/' || doc_id || ':' || source AS key, 'src_' || doc_id || '_' || replace(source, '..', '__') AS safe_key, CASE WHEN doc_id % 4 = 0 THEN 'again: ' || text ELSE text END AS content, lang
    FROM documents WHERE doc_id % 5 <> 0
    """,
)
def s17(spark, sf_dir):
    """Each document is put, each fourth put again, each fifth deleted; a batch without its marker doesn't show."""
    from ..sources.checkpoint import folder
    from ..sources.store import Store

    store = Store(spark, folder(spark, "store"))
    key = F.concat_ws(":", F.concat(F.lit("src/"), F.col("doc_id").cast("string")), "source")
    rows = docs(spark, sf_dir).select("doc_id", key.alias("key"), F.col("text").alias("content"), F.create_map(F.lit("lang"), "lang").alias("metadata"))
    store.put(rows)
    store.put(rows.filter("doc_id % 4 = 0").withColumn("content", F.concat(F.lit("again: "), "content")))
    store.delete(rows.filter("doc_id % 5 = 0"))
    store.write(store.objects().select("key", "safe_key", F.lit("cut off").alias("content"), "metadata", F.lit(False).alias("deleted")))
    return store.objects().select("key", "safe_key", "content", F.col("metadata")["lang"].alias("lang"))


@query(
    "s25_manifest_round_trip",
    "SELECT 'local:' || doc_id AS source_key, sha256(text) AS content_hash, n_chars FROM documents",
)
def s25(spark, sf_dir):
    """Saved as JSON lines, one of them spoilt, and loaded again."""
    from ..sources import tables
    from ..sources.checkpoint import folder

    path = folder(spark, "manifest")
    entries = docs(spark, sf_dir).select(F.concat(F.lit("local:"), F.col("doc_id").cast("string")).alias("source_key"), F.sha2("text", 256).alias("content_hash"), "n_chars")
    tables.save_json(entries, path)
    spark.range(1).select(F.lit('{"source_key": "cut of').alias("value")).write.mode("append").text(path)
    return tables.load_json(spark, path, "source_key string, content_hash string, n_chars long")[0]


@query(
    "l10_isolated_failures",
    "SELECT event_id, event_id % 13 = 0 AS failed, CASE WHEN event_id % 13 = 0 THEN 'JSONDecodeError' ELSE '' END AS error, CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k FROM events",
)
def l10(spark, sf_dir):
    """Each thirteenth event's properties are cut off: its row fails alone."""
    from ..operators.isolation import isolated

    broken = F.when(F.col("event_id") % 13 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", broken.alias("props"))

    def parse(row):
        import json

        return [(json.loads(row["props"]).get("k"),)]

    good, bad = isolated(rows, "event_id", parse, "k long", "parse")
    good = good.select("event_id", F.lit(False).alias("failed"), F.lit("").alias("error"), "k")
    return good.unionByName(bad.select("event_id", F.lit(True).alias("failed"), "error", F.lit(-1).cast("long").alias("k")))


@query("p8_community_upsert", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'new ' || n_name ELSE n_name END AS summary, CASE WHEN n_nationkey % 4 = 0 THEN 2 ELSE 1 END AS member_count FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 2 FROM region")
def p8(spark, sf_dir):
    from ..sources.tables import upsert

    nations = table(spark, sf_dir, "nation")
    row = lambda df, k, summary, n: df.select(k.cast("int").alias("id"), summary.alias("summary"), F.lit(n).alias("member_count"))
    old = row(nations, F.col("n_nationkey"), F.col("n_name"), 1)
    new = row(nations.filter("n_nationkey % 4 = 0"), F.col("n_nationkey"), F.concat(F.lit("new "), "n_name"), 2).unionByName(row(table(spark, sf_dir, "region"), 100 + F.col("r_regionkey"), F.col("r_name"), 2))
    return upsert(old, new, "id")
