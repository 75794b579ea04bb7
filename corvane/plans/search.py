"""Search, filters, ranking and confidence (V, F, A9 to A12, Q, E8 to E10, J10, J19, J20 rows). Test items stand in for queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as R
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..registry import query, table
from ..sources.checkpoint import folder
from . import sql as S


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{R.NOT_TOKEN}'), lambda t: t <> '')"


BM25 = f"""
    tok AS (SELECT doc_id AS id, {tokens_sql('text')} AS tokens FROM documents),
    corpus AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
    tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM tok) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
    kw AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6)::DOUBLE AS bm25 FROM tf JOIN qt USING (term) JOIN df USING (term), corpus GROUP BY query_id, id)
"""
COS = "list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)))"
DENSE = f"""
    e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    ve AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({COS}, 6)::DOUBLE AS dense FROM e, e q WHERE {{asked}})
"""
#: A search among the vectors asks with each vector whose id is divisible by 20; the hybrid one with each test item and its vector.
DENSE, OF_ITEMS = DENSE.replace("{asked}", "q.vec_id % 20 = 0"), DENSE.replace("{asked}", "q.vec_id IN (SELECT item_id FROM benchmark)")
HYBRID = f"""
    WITH {BM25}, {OF_ITEMS},
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rn FROM kw) WHERE rn <= 50),
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id) AS rn FROM ve) WHERE rn <= 50),
    kn AS (SELECT query_id, id, CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 1.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS s FROM k WINDOW w AS (PARTITION BY query_id)),
    vn AS (SELECT query_id, id, CASE WHEN max(dense) OVER w = min(dense) OVER w THEN 1.0 ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END AS s FROM v WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT coalesce(kn.query_id, vn.query_id) AS query_id, coalesce(kn.id, vn.id) AS id, round({{alpha}} * coalesce(vn.s, 0) + (1 - {{alpha}}) * coalesce(kn.s, 0), 6)::DOUBLE AS score FROM kn FULL JOIN vn ON kn.query_id = vn.query_id AND kn.id = vn.id)
    SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f) WHERE rank <= {{k}}
"""


def hybrid_sql(alpha: float = 0.5, k: int = 10) -> str:
    return HYBRID.replace("{alpha}", str(alpha)).replace("{k}", str(k))


def inputs(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = table(spark, sf_dir, "benchmark")
    return table(spark, sf_dir, "documents"), vectors, queries, vectors.withColumnRenamed("vec_id", "query_id")


def hits(spark, sf_dir, alpha=0.5, k=10):
    docs, vectors, queries, asked = inputs(spark, sf_dir)
    return R.hybrid_search(docs, vectors, queries, asked.join(queries, F.col("query_id") == F.col("item_id"), "left_semi"), alpha=alpha, limit=k)


@query("hybrid_search", hybrid_sql())
def hybrid(spark, sf_dir):
    return hits(spark, sf_dir)


@query("v5_bm25", f"WITH {BM25} SELECT query_id, id, bm25, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS INTEGER) AS rank FROM kw) WHERE rank <= 10")
def v5(spark, sf_dir):
    docs, _, queries, _ = inputs(spark, sf_dir)
    return R.top(R.bm25(docs, queries, k=10), "bm25", 10)


@query("v5_index", f"WITH {BM25} SELECT query_id, id, bm25, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS INTEGER) AS rank FROM kw) WHERE rank <= 10")
def v5_index(spark, sf_dir):
    """From a stored index of two segments, of which a third of the documents was removed and added again."""
    docs, _, queries, _ = inputs(spark, sf_dir)
    index, third = TextIndex(spark, folder(spark, "text-index")), docs.filter("doc_id % 3 = 1")
    index.add(docs)
    index.remove(third)
    index.add(third)
    return index.search(queries)


@query("v4_dense", f"WITH {DENSE} SELECT query_id, id, dense, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id) AS INTEGER) AS rank FROM ve) WHERE rank <= 10")
def v4(spark, sf_dir):
    _, vectors, _, asked = inputs(spark, sf_dir)
    return R.top(R.dense(vectors, asked.filter("query_id % 20 = 0"), k=10), "dense", 10)


def indexed(spark, vectors):
    """An index of the vectors that was changed since: a third was removed and added again as another segment."""
    index = VectorIndex.build(vectors, folder(spark, "vector-index"), lists=64)
    third = vectors.filter("vec_id % 3 = 1")
    index.remove(third)
    index.add(third)
    return index


@query("v4_index_exact", f"WITH {DENSE} SELECT query_id, id, dense, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id) AS INTEGER) AS rank FROM ve) WHERE rank <= 10")
def v4_exact(spark, sf_dir):
    """All lists of a stored index, each row by its vector."""
    _, vectors, _, asked = inputs(spark, sf_dir)
    return indexed(spark, vectors).search(asked.filter("query_id % 20 = 0"), probes=None, candidates=None)


@query("v4_index_search")
def v4_index(spark, sf_dir):
    """As many lists as hold 97 of 100 neighbours of a sample of the queries, by their codes; 200 candidates by their vectors."""
    _, vectors, _, asked = inputs(spark, sf_dir)
    index, asked = indexed(spark, vectors), asked.filter("query_id % 20 = 0")
    return index.search(asked, probes=index.probes_for(asked, 0.97), candidates=200)


@query(
    "v13_visual_search",
    f"WITH {DENSE} SELECT query_id, id, dense AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id) AS rn FROM ve) WHERE rn <= 5 AND dense >= 0.3",
)
def v13(spark, sf_dir):
    """The threshold applies after the cut to five."""
    _, vectors, _, asked = inputs(spark, sf_dir)
    found = R.top(R.dense(vectors, asked.filter("query_id % 20 = 0"), k=5).withColumnRenamed("dense", "score"), "score", 5)
    return found.filter("score >= 0.3").select("query_id", "id", "score")


@query(
    "v7_collections",
    """
    WITH h AS (SELECT vec_id AS id, label AS collection, round((vec_id * 37 % 101) / 101.0::DOUBLE, 6) AS score FROM embeddings UNION ALL SELECT vec_id, label + 100, round((vec_id * 53 % 103) / 103.0::DOUBLE, 6) FROM embeddings)
    SELECT id, score FROM (SELECT id, max(score) AS score FROM h GROUP BY id) ORDER BY score DESC, id LIMIT 20
    """,
)
def v7(spark, sf_dir):
    from ..operators.dedup import best_of_each

    rows = table(spark, sf_dir, "embeddings")
    part = lambda m, n, shift: rows.select(F.col("vec_id").alias("id"), (F.col("label") + shift).alias("collection"), F.round((F.col("vec_id") * m % n) / F.lit(float(n)), 6).alias("score"))
    return best_of_each(part(37, 101, 0).unionByName(part(53, 103, 100)), F.col("id"), "score").select("id", "score").orderBy(F.desc("score"), "id").limit(20)


@query("v8_expanded_text", f"SELECT item_id, text || ' ' || array_to_string(list_slice(list_reverse({tokens_sql('text')}), 1, 3), ' ') AS expanded FROM benchmark")
def v8(spark, sf_dir):
    """The item's last tokens stand in for terms from the graph; three are appended."""
    terms = F.slice(F.reverse(R.tokens(F.col("text"))), 1, 3)
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", "text", F.array_join(terms, " ")).alias("expanded"))


def ranked_sql(k: int = 5, alpha: float = 0.5, score: str = "rerank") -> str:
    q, t = f"list_distinct({tokens_sql('b.text')})", tokens_sql("d.text")
    return f"""
    SELECT query_id, id, {score}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS INTEGER) AS rank FROM (
      SELECT h.query_id, h.id, round(1 / (1 + exp(-(6.0 * coalesce(len(list_intersect({q}, {t})) / nullif(len({q}), 0)::DOUBLE, 0) - 3))), 6)::DOUBLE AS {score}
      FROM ({hybrid_sql(alpha)}) h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) <= {k}
    """


def reranked(spark, sf_dir, k=5, alpha=0.5, score="rerank"):
    docs, _, queries, _ = inputs(spark, sf_dir)
    text = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("doc_text"))
    asked = queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    scored = hits(spark, sf_dir, alpha).drop("score", "rank").join(text, "id").join(asked, "query_id").withColumn(score, F.round(R.sigmoid(R.overlap_logit(F.col("query_text"), F.col("doc_text"))), 6))
    return R.top(scored, score, k)


@query("v9_rerank", ranked_sql())
def v9(spark, sf_dir):
    return reranked(spark, sf_dir).select("query_id", "id", "rerank", "rank")


@query("v10_rank_by_search_score", f"SELECT query_id, id, score FROM ({hybrid_sql()}) WHERE rank <= 5")
def v10(spark, sf_dir):
    return hits(spark, sf_dir).filter("rank <= 5").select("query_id", "id", "score")


@query(
    "v11_quality_label",
    f"SELECT query_id, best, CASE WHEN best >= 0.75 THEN 'strong' WHEN best >= 0.5 THEN 'moderate' WHEN best >= 0.3 THEN 'weak' ELSE 'insufficient' END AS label FROM (SELECT query_id, max(rerank) AS best FROM ({ranked_sql()}) GROUP BY query_id)",
)
def v11(spark, sf_dir):
    best = reranked(spark, sf_dir).groupBy("query_id").agg(F.max("rerank").alias("best"))
    return best.select("query_id", "best", R.quality_label(F.col("best")).alias("label"))


def scores_sql(alpha: float) -> str:
    return f"SELECT query_id, id, score FROM ({ranked_sql(10, alpha, 'score')})"


def scored(spark, sf_dir, alpha):
    """The reranked hits of each test item over all documents: by vectors alone (alpha 1), by words alone (0)."""
    return reranked(spark, sf_dir, 10, alpha, "score").select("query_id", "id", "score")


@query(
    "v12_fallback_retrieval",
    f"""
    WITH a AS ({scores_sql(1.0)}), b AS ({scores_sql(0.0)}),
    u AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(coalesce(ba, 0) < 0.5 AND bb > coalesce(ba, -1), false) AS second FROM (SELECT query_id, max(score) AS ba FROM a GROUP BY 1) x FULL JOIN (SELECT query_id, max(score) AS bb FROM b GROUP BY 1) y ON x.query_id = y.query_id)
    SELECT query_id, id, score, 'first' AS attempt FROM a JOIN u USING (query_id) WHERE NOT second UNION ALL SELECT query_id, id, score, 'fallback' FROM b JOIN u USING (query_id) WHERE second
    """,
)
def v12(spark, sf_dir):
    return R.better_of(scored(spark, sf_dir, 1.0), scored(spark, sf_dir, 0.0))


@query("v14_mean_pooling", "SELECT label, list(round(m, 6) ORDER BY i) AS pooled FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label")
def v14(spark, sf_dir):
    by = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return by.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6)).alias("pooled"))


#: Each vector as eight patches, its consecutive parts.
PATCH_COUNT, PATCH = 8, 8
PATCHES_SQL = f"list_transform(range({PATCH_COUNT}), lambda k: CAST(list_slice(embedding, k * {PATCH} + 1, k * {PATCH} + {PATCH}) AS DOUBLE[]))"


def patches():
    return F.array(*[F.slice("embedding", k * PATCH + 1, PATCH) for k in range(PATCH_COUNT)])


@query("v14_mean_of_patches", f"SELECT vec_id, list_transform(range(1, {PATCH + 1}), lambda i: round(list_sum(list_transform(p, lambda x: x[i])) / {PATCH_COUNT}, 6)) AS pooled FROM (SELECT vec_id, {PATCHES_SQL} AS p FROM embeddings)")
def v14b(spark, sf_dir):
    pooled = R.mean_pool(patches(), PATCH)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(pooled, lambda x: R.binary_round(x, 6)).alias("pooled"))


@query(
    "v15_page_resize",
    "SELECT page_id, w, h, CAST(CASE WHEN greatest(w, h) > 1024 THEN w * 1024 // greatest(w, h) ELSE w END AS BIGINT) AS width, CAST(CASE WHEN greatest(w, h) > 1024 THEN h * 1024 // greatest(w, h) ELSE h END AS BIGINT) AS height FROM (SELECT page_id, 600 + page_id * 37 % 1900 AS w, 400 + page_id * 53 % 1700 AS h FROM pages)",
)
def v15(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", (600 + F.col("page_id") * 37 % 1900).alias("w"), (400 + F.col("page_id") * 53 % 1700).alias("h"))
    long = F.greatest("w", "h")
    fit = lambda c: F.when(long > 1024, F.floor(F.col(c) * 1024 / long)).otherwise(F.col(c)).cast("long")
    return rows.select("page_id", "w", "h", fit("w").alias("width"), fit("h").alias("height"))


@query(
    "v16_late_interaction",
    f"""
    WITH e AS (SELECT vec_id, {PATCHES_SQL} AS p FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_sum(list_transform(q.p, lambda x: list_max(list_transform(e.p, lambda y: list_dot_product(x, y))))), 6)::DOUBLE AS maxsim FROM e q, e WHERE q.vec_id % 20 = 0)
    SELECT query_id, id, maxsim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY maxsim DESC, id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY maxsim DESC, id) <= 10
    """,
)
def v16(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", patches().alias("patches"))
    return R.top(R.late_interaction_search(rows, rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k=10), "maxsim", 10)


@query("v1_embed_offline")
def v1(spark, sf_dir):
    from ..functions.models import embed

    rows = table(spark, sf_dir, "documents").select("doc_id", embed(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("dimensions"), F.round(R.norm(F.col("v")), 4).alias("length"))


# ---------------------------------------------------------------- filters


@query("f1_filters", "SELECT doc_id FROM documents WHERE source = 'src1' AND n_chars >= 500 AND lang LIKE 'e%' AND doc_id <> 7")
def f1(spark, sf_dir):
    return R.where(table(spark, sf_dir, "documents"), [("source", "eq", "src1"), ("n_chars", "GTE", 500), ("lang", "like", "e*"), ("doc_id", "ne", 7)]).select("doc_id")


@query("f2_source_and_tenant", "SELECT doc_id, source FROM documents WHERE source = 'src2'")
def f2(spark, sf_dir):
    text, named = R.parse_filters('source:"src2" anything else')
    return R.where(table(spark, sf_dir, "documents"), [(k, "eq", v) for k, v in named.items()]).select("doc_id", "source")


NAMED = lambda name: f"regexp_extract_all(t, '(?i)\\b{name}:(?:\"[^\"]*\"|[^{S.SPACE}]+)', 0)[-1]"
VALUE = lambda name: f"coalesce(CASE WHEN regexp_matches({NAMED(name)}, '^[^:]*:\"[^\"]*\"$') THEN replace(substr({NAMED(name)}, {len(name) + 2}), '\"', '') ELSE substr({NAMED(name)}, {len(name) + 2}) END, '')"


@query(
    "f3_filter_syntax",
    f"""
    WITH t AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'source:"spec docs/a ' || item_id || '.md" ' || text ELSE text END || CASE WHEN item_id % 2 = 0 THEN ' Section:Clock' || item_id || ' source:last' ELSE ' resource x' END AS t FROM benchmark)
    SELECT item_id, {S.strip(S.collapse(f"regexp_replace(t, '(?i)\\b(?:source|section):(?:\"[^\"]*\"|[^{S.SPACE}]+)', ' ', 'g')"))} AS rest, {VALUE('source')} AS source, {VALUE('section')} AS section FROM t
    """,
)
def f3(spark, sf_dir):
    n, s = F.col("item_id"), F.col("item_id").cast("string")
    head = F.when(n % 3 == 0, F.concat(F.lit('source:"spec docs/a '), s, F.lit('.md" '), "text")).otherwise(F.col("text"))
    tail = F.when(n % 2 == 0, F.concat(F.lit(" Section:Clock"), s, F.lit(" source:last"))).otherwise(" resource x")
    rows = table(spark, sf_dir, "benchmark").select("item_id", R.filter_parts(F.concat(head, tail)).alias("p"))
    return rows.select("item_id", "p.rest", F.coalesce("p.source", F.lit("")).alias("source"), F.coalesce("p.section", F.lit("")).alias("section"))


@query("f4_value_whitelist", f"SELECT doc_id, regexp_matches(text, '^[{S.WORD_CHAR}.\\- /]{{1,200}}$') AS allowed FROM documents")
def f4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(?U)^[\w.\- /]{1,200}\z").alias("allowed"))


@query("f9_listing_filters", "SELECT doc_id, source FROM documents WHERE contains(source, '1') AND lang = 'en'")
def f9(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("source").contains("1") & (F.col("lang") == "en")).select("doc_id", "source")


@query("f11_blank_rows", f"SELECT conv_id, turn FROM conversations WHERE {S.strip('coalesce(text, chr(32))')} <> ''")
def f11(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter(T.strip(F.coalesce("text", F.lit(" "))) != "").select("conv_id", "turn")


# ---------------------------------------------------------------- confidence


@query(
    "a9_score_stats",
    f"SELECT query_id, min(score) AS low, max(score) AS high, round(avg(score), 4) AS mean FROM ({scores_sql(1.0)}) GROUP BY query_id",
)
def a9(spark, sf_dir):
    return scored(spark, sf_dir, 1.0).groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("score"), 4).alias("mean"))


@query(
    "a10_retrieval_confidence",
    f"SELECT query_id, round(greatest(0, least(1, avg(score))), 6)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM ({scores_sql(1.0)})) WHERE rn <= 3 GROUP BY query_id",
)
def a10(spark, sf_dir):
    best = R.top(scored(spark, sf_dir, 1.0), "score", 3)
    return best.groupBy("query_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("score"))), 6).alias("confidence"))


ANSWER = "text || ' [' || (item_id % 4) || ']. ' || 'This one cites [' || (item_id % 3 + 1) || '] for good measure. Short one. And nothing else is cited in here.'"
SENTS = f"list_filter(list_transform(string_split(regexp_replace({S.strip('a')}, '([.!?])[{S.SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {S.strip('s')}), lambda s: len({S.words('s')}) >= 4)"


def grams_sql(w: str) -> str:
    return f"CASE WHEN len({w}) < 5 THEN [] ELSE list_transform(range(1, len({w}) - 3), lambda i: array_to_string(list_slice({w}, i, i + 4), ' ')) END"


COVERAGE = f"""
    WITH a AS (SELECT item_id, {ANSWER} AS a, [text, 'another text', 'a third'] AS r FROM benchmark),
    s AS (SELECT item_id, len(ss) AS n, unnest(ss) AS s, len(r) AS nr, kw FROM (SELECT item_id, {SENTS} AS ss, r, {S.words("lower(array_to_string(r, ' '))")} AS kw FROM a)),
    g AS (SELECT *, {grams_sql('kw')} AS k, {S.words('lower(s)')} AS sw FROM s),
    f AS (SELECT item_id, n, len(list_filter(regexp_extract_all(s, '\\[(\\d+)\\]', 1), lambda c: c::INT BETWEEN 1 AND nr)) > 0 AS cited, len(list_intersect({grams_sql('sw')}, k)) > 0 AS grounded FROM g)
    SELECT item_id, round(0.7 * sum(cited::INT) / any_value(n) + 0.3 * sum(grounded::INT) / any_value(n), 6)::DOUBLE AS coverage FROM f GROUP BY item_id
"""


def answered(spark, sf_dir):
    n = F.col("item_id")
    a = F.concat("text", F.lit(" ["), (n % 4).cast("string"), F.lit("]. This one cites ["), (n % 3 + 1).cast("string"), F.lit("] for good measure. Short one. And nothing else is cited in here."))
    return table(spark, sf_dir, "benchmark").select("item_id", a.alias("answer"), F.array("text", F.lit("another text"), F.lit("a third")).alias("retrieved"))


@query("a11_citation_coverage", COVERAGE)
def a11(spark, sf_dir):
    return answered(spark, sf_dir).select("item_id", F.round(R.citation_coverage(F.col("answer"), F.col("retrieved")), 6).alias("coverage"))


STATED_SQL = "['high', 'MEDIUM', ' low ', 'very high indeed', 'unsure', ''][CAST(item_id % 6 AS INTEGER) + 1]"
STATED_SCORE = f"CASE WHEN st = '' THEN 0.5 WHEN lower(st) LIKE '%high%' THEN 0.85 WHEN lower(st) LIKE '%medium%' THEN 0.55 WHEN lower(st) LIKE '%low%' THEN 0.25 ELSE 0.5 END"


def stated(c="item_id"):
    return F.get(F.array(*[F.lit(x) for x in ("high", "MEDIUM", " low ", "very high indeed", "unsure", "")]), (F.col(c) % 6).cast("int"))


@query("q11_stated_confidence", f"SELECT item_id, CAST({STATED_SCORE} AS DOUBLE) AS stated FROM (SELECT item_id, {STATED_SQL} AS st FROM benchmark)")
def q11(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", R.stated_confidence(stated()).alias("stated"))


ROUTED = f"""
    SELECT item_id, round(greatest(0, least(1, 0.5 * r + 0.25 * {STATED_SCORE} + 0.25 * coverage)), 6)::DOUBLE AS confidence, item_id % 2 AS retries
    FROM (SELECT c.item_id, (item_id * 31 % 100) / 100.0::DOUBLE AS r, {STATED_SQL} AS st, coverage FROM ({COVERAGE}) c)
"""


@query(
    "q8_confidence_route",
    f"SELECT item_id, confidence, CASE WHEN confidence >= 0.7 THEN 'return' WHEN retries < 1 THEN 're_retrieve' WHEN confidence >= 0.5 THEN 'flag' ELSE 'block' END AS action FROM ({ROUTED})",
)
def q8(spark, sf_dir):
    r = (F.col("item_id") * 31 % 100) / 100.0
    rows = answered(spark, sf_dir).select("item_id", F.round(R.composite(r, R.stated_confidence(stated()), F.round(R.citation_coverage(F.col("answer"), F.col("retrieved")), 6)), 6).alias("confidence"))
    return rows.select("item_id", "confidence", R.confidence_route(F.col("confidence"), F.col("item_id") % 2).alias("action"))


@query("q9_reretrieval", "SELECT item_id, round(greatest(0, (item_id % 10) / 10.0 - 0.15), 6)::DOUBLE AS alpha, 10 + 5 AS search_limit FROM benchmark")
def q9(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(F.greatest(F.lit(0.0), (F.col("item_id") % 10) / 10.0 - 0.15), 6).alias("alpha"), F.lit(15).alias("search_limit"))


# ---------------------------------------------------------------- formatting


@query(
    "e8_context",
    """
    WITH r AS (SELECT doc_id % 40 AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS i FROM documents)
    SELECT query_id, sha256(string_agg('[' || i || '] ' || 'relevance: ' || round(100.0 / i, 0)::INT || '% | Source: ' || source || CASE WHEN lang <> 'en' THEN ' | Domain: ' || lang ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY i)) AS context_sha256
    FROM r JOIN documents d USING (doc_id) WHERE i <= 5 GROUP BY query_id
    """,
)
def e8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("query_id", F.col("doc_id") % 40)
    ranked = docs.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).filter("i <= 5")
    label = F.concat_ws(" | ", F.concat(F.lit("relevance: "), F.round(100.0 / F.col("i"), 0).cast("int").cast("string"), F.lit("%")), F.concat(F.lit("Source: "), F.col("source")), F.when(F.col("lang") != "en", F.concat(F.lit("Domain: "), F.col("lang"))))
    block = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), label, F.lit("\n"), F.col("text"))
    blocks = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))).alias("bs"))
    return blocks.select("query_id", F.sha2(F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n"), 256).alias("context_sha256"))


@query("e9_version_conflicts", "SELECT source AS stem, list_sort(list(DISTINCT 'v' || (doc_id % 3))) AS versions FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 3) > 1")
def e9(spark, sf_dir):
    v = F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string"))
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stem")).agg(F.array_sort(F.collect_set(v)).alias("versions")).filter(F.size("versions") > 1)


PROMPT = "you are a helpful assistant that answers only from the given documents and cites them"
CLEAN = f"list_filter(string_split(a, chr(10)), lambda l: NOT (contains(l, '<<<') OR contains(l, '{{{{') OR (length({S.strip(S.collapse('lower(l)'))}) >= 40 AND contains(' {PROMPT} ', ' ' || {S.strip(S.collapse('lower(l)'))} || ' '))))"


@query(
    "e10_sanitised_answer",
    f"""
    WITH a AS (SELECT item_id, text || chr(10) || '<<<CONTEXT' || chr(10) || 'Answers only from the given documents and cites them' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '{{{{name}}}}' ELSE 'fine' END AS a FROM benchmark)
    SELECT item_id, CASE WHEN {S.strip(f"array_to_string({CLEAN}, chr(10))")} = '' THEN a ELSE {S.strip(f"array_to_string({CLEAN}, chr(10))")} END AS answer FROM a
    """,
)
def e10(spark, sf_dir):
    from ..functions.guard import sanitise_answer

    tail = F.when(F.col("item_id") % 2 == 0, "{{name}}").otherwise("fine")
    a = F.concat("text", F.lit("\n<<<CONTEXT\nAnswers only from the given documents and cites them\n"), tail)
    return table(spark, sf_dir, "benchmark").select("item_id", sanitise_answer(a, PROMPT).alias("answer"))


@query("p4_source_references", f"SELECT query_id, id, d.source, 'local://' || d.source AS uri, score, substr(d.text, 1, 200) AS preview FROM ({hybrid_sql(k=3)}) h JOIN documents d ON d.doc_id = h.id")
def p4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.concat(F.lit("local://"), F.col("source")).alias("uri"), F.col("text").substr(1, 200).alias("preview"))
    return hits(spark, sf_dir, k=3).join(docs, "id").select("query_id", "id", "source", "uri", "score", "preview")
