"""Knowledge graph (G, A5, A6, J12 to J16, S22 to S24, O4, P8, P9 rows). Nations, regions, customers and suppliers stand in for entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.leiden import leiden
from ..registry import query, table
from . import sql as S

# customers and suppliers are located in nations, nations are part of regions
EDGES = """
    SELECT 'c' || c_custkey AS subject, n_name AS object, 'located_in' AS relation, c_mktsegment AS source, 1 AS weight, c_custkey AS seq FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 's' || s_suppkey, n_name, 'supplies_from', 'suppliers', 2, 1000000 + s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
    UNION ALL SELECT n_name, r_name, 'part_of', 'nations', 1, 2000000 + n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
"""


def triples(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations = t("nation")
    edge = lambda df, s, o, r, source, w, seq: df.select(s.alias("subject"), F.col(o).alias("object"), F.lit(r).alias("relation"), source.alias("source"), F.lit(w).alias("weight"), seq.cast("long").alias("seq"))
    a = edge(t("customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey")), name("c", "c_custkey"), "n_name", "located_in", F.col("c_mktsegment"), 1, F.col("c_custkey"))
    b = edge(t("supplier").join(nations, F.col("n_nationkey") == F.col("s_nationkey")), name("s", "s_suppkey"), "n_name", "supplies_from", F.lit("suppliers"), 2, 1000000 + F.col("s_suppkey"))
    c = edge(nations.join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")), F.col("n_name"), "r_name", "part_of", F.lit("nations"), 1, 2000000 + F.col("n_nationkey"))
    return a.unionByName(b).unionByName(c)


def seeds(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 20 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed"))


SEEDS = "SELECT 's' || s_suppkey AS seed FROM supplier WHERE s_suppkey % 20 = 0"

# ---------------------------------------------------------------- extraction

LIST = lambda xs: "(" + ", ".join(S.q(x) for x in sorted(set(xs))) + ")"
#: Non-ASCII letters are word characters that no pattern holds: as underscores they keep all word borders.
PLAIN = "regexp_replace(regexp_replace(text, '(?m)^#{1,6}\\s+.*$', '', 'g'), '[^\\x00-\\x7f]', '_', 'g')"
ENTITIES = f"""
    SELECT DISTINCT doc_id, name FROM (
      SELECT doc_id, unnest(regexp_extract_all(t, {S.q(G.CAMEL)}, 0)) AS name FROM (SELECT doc_id, {PLAIN} AS t FROM documents)
      UNION ALL SELECT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(t, {S.q(G.ACRONYM)}, 0)) AS name FROM (SELECT doc_id, {PLAIN} AS t FROM documents)) WHERE name NOT IN {LIST(G.STOPWORDS)}
      UNION ALL SELECT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(t, {S.q(G.PHRASE)}, 0)) AS name FROM (SELECT doc_id, {PLAIN} AS t FROM documents))
        WHERE split_part(name, ' ', 1) NOT IN {LIST(G.SENTENCE_STARTERS)} AND len(list_filter(string_split(name, ' '), lambda w: w IN {LIST(G.STOPWORDS)})) = 0)
"""


def mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(G.entities(F.col("text"))).alias("name"))


@query("g1_entities", ENTITIES)
def g1(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", "name")


@query("g5_entity_types", f"SELECT name, CASE WHEN regexp_matches(name, '^[A-Z][a-z]+[A-Z]') THEN 'technology' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]+$') THEN 'acronym' ELSE 'concept' END AS type, count(*) AS n FROM ({ENTITIES}) GROUP BY name")
def g5(spark, sf_dir):
    return g1(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n")).select("name", G.entity_type(F.col("name")).alias("type"), "n")


@query("g2_aliases", "SELECT doc_id, 'RAG' AS alias, 'Retrieval Augmented Generation' AS target FROM documents UNION ALL SELECT doc_id, 'ML', 'Machine learning ' || lang FROM documents")
def g2(spark, sf_dir):
    t = F.concat(F.lit("use Retrieval Augmented Generation (RAG), or ML (Machine learning "), F.col("lang"), F.lit(")."))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(G.aliases(t)).alias("alias", "target"))


@query("g3_relations")
def g3(spark, sf_dir):
    t = F.concat(F.lit("TensorFlow is a library for numbers. Deep Learning is a subset of machine learning. Frameworks such as PyTorch, and JAX exist. TensorFlow uses graphs with nodes.\n"), F.col("text"))
    return G.relations(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")), "doc_id")


@query("g4_clean_relations")
def g4(spark, sf_dir):
    return G.clean_relations(g3(spark, sf_dir))


@query("g44_chunk_ingest")
def g44(spark, sf_dir):
    rows = g4(spark, sf_dir)
    ends = rows.select("doc_id", F.explode(F.array("subject", "object")).alias("name"))
    named = mentions(spark, sf_dir).select("doc_id", "name").unionByName(ends)
    known = G.canonical_names(named.withColumn("seq", F.col("doc_id")))
    return known.groupBy("canonical").agg(F.count("*").alias("mention_count"))


# ---------------------------------------------------------------- upserts

NAMES = "SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN lower(n_name) WHEN o_orderkey % 3 = 1 THEN n_name ELSE 'alias' || n_nationkey END AS name, n_name AS own, n_nationkey, o_orderpriority AS source, o_orderstatus AS type FROM orders JOIN nation ON n_nationkey = o_custkey % 25"
CANONICAL = f"SELECT *, first_value(r) OVER (PARTITION BY lower(r) ORDER BY seq) AS canonical FROM (SELECT *, CASE WHEN name LIKE 'alias%' THEN own ELSE name END AS r FROM ({NAMES}))"


def spelled(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "orders").join(F.broadcast(nations), F.col("o_custkey") % 25 == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.lower("n_name")).when(k % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("alias"), F.col("n_nationkey").cast("string")))
    alias = nations.select(F.concat(F.lit("alias"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("target"))
    return G.canonical_names(rows.select(k.alias("seq"), name.alias("name"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("type")), alias=alias)


@query("g14_canonical_names", f"SELECT seq, canonical FROM ({CANONICAL})")
def g14(spark, sf_dir):
    return spelled(spark, sf_dir).select("seq", "canonical")


NODES = f"SELECT canonical, count(*) AS mention_count, list_sort(list(DISTINCT source)) AS sources, arg_min(type, seq) AS type FROM ({CANONICAL}) GROUP BY canonical"


@query("g15_upsert_entities", NODES)
def g15(spark, sf_dir):
    return G.upsert_entities(spelled(spark, sf_dir))


@query("g16_edges_digraph", f"SELECT subject, object, CAST(sum(weight) AS BIGINT) AS weight, list_sort(list(DISTINCT source)) AS sources, arg_min(relation, seq) AS relation FROM ({EDGES}) WHERE subject <> object GROUP BY ALL")
def g16(spark, sf_dir):
    return G.upsert_edges(triples(spark, sf_dir))


@query("g16_edges_multigraph", f"SELECT subject, object, relation, CAST(sum(weight) AS BIGINT) AS weight, list_sort(list(DISTINCT source)) AS sources FROM ({EDGES}) WHERE subject <> object GROUP BY subject, object, relation")
def g16m(spark, sf_dir):
    return G.upsert_edges(triples(spark, sf_dir), "multigraph")


@query("g17_descriptions", f"SELECT t.seq FROM ({NAMES}) t WHERE own IN (SELECT n_name FROM nation WHERE n_regionkey < 3)")
def g17(spark, sf_dir):
    """Descriptions of unknown entities are skipped."""
    known = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_nationkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 25).cast("int").alias("n_nationkey"))
    return rows.join(known, "n_nationkey", "left_semi").select("seq")


@query("g18_remove_source", f"SELECT canonical, list_filter(sources, lambda s: s <> '1-URGENT') AS sources FROM ({NODES}) WHERE len(list_filter(sources, lambda s: s <> '1-URGENT')) > 0")
def g18(spark, sf_dir):
    return G.remove_source(g15(spark, sf_dir).select("canonical", "sources"), g16(spark, sf_dir), "1-URGENT")[0]


@query("g18_removed_edges", f"SELECT subject, object FROM ({EDGES}) GROUP BY subject, object HAVING NOT bool_or(source = 'BUILDING')")
def g18e(spark, sf_dir):
    return G.remove_source(g15(spark, sf_dir), g16(spark, sf_dir), "BUILDING")[1].select("subject", "object")


MERGES = "SELECT n.n_name AS loser, r.n_name AS winner FROM nation n JOIN nation r ON r.n_nationkey = n.n_nationkey - n.n_nationkey % 5 WHERE n.n_nationkey % 5 <> 0"


@query(
    "g19_merged_edges",
    f"SELECT s AS subject, o AS object, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT coalesce(a.winner, subject) AS s, coalesce(b.winner, object) AS o, weight FROM ({EDGES}) e LEFT JOIN ({MERGES}) a ON a.loser = e.subject LEFT JOIN ({MERGES}) b ON b.loser = e.object) WHERE s <> o GROUP BY 1, 2",
)
def g19(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    heads = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("winner"))
    merges = n.filter("n_nationkey % 5 <> 0").join(heads, F.col("k") == F.col("n_nationkey") - F.col("n_nationkey") % 5).select(F.col("n_name").alias("loser"), "winner")
    return G.merge_entities(g15(spark, sf_dir), g16(spark, sf_dir), merges)[1]


@query("g20_lookup", f"SELECT canonical, mention_count FROM ({NODES}) WHERE lower(canonical) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 4)")
def g20(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").filter("n_nationkey < 4").select(F.lower("n_name").alias("fold"))
    return g15(spark, sf_dir).withColumn("fold", F.lower("canonical")).join(wanted, "fold", "left_semi").select("canonical", "mention_count")


def walk_sql(edges: str, depth: int) -> str:
    return f"WITH RECURSIVE e AS ({edges}), w(seed, node, d) AS (SELECT seed, seed, 0 FROM ({SEEDS}) UNION SELECT w.seed, e.b, d + 1 FROM w JOIN e ON e.a = w.node WHERE d < {depth}) SELECT DISTINCT seed, node FROM w WHERE node <> seed"


OUT = f"SELECT DISTINCT subject AS a, object AS b FROM ({EDGES})"
BOTH = f"SELECT DISTINCT subject AS a, object AS b FROM ({EDGES}) UNION SELECT object, subject FROM ({EDGES})"


@query("g21_neighbours_digraph", f"SELECT seed, node FROM ({walk_sql(OUT, 2)}) UNION SELECT seed, subject FROM ({SEEDS}) JOIN ({EDGES}) ON object = seed")
def g21(spark, sf_dir):
    return G.neighbours(triples(spark, sf_dir), seeds(spark, sf_dir), 2)


@query("g21_neighbours_multigraph", walk_sql(BOTH, 2))
def g21m(spark, sf_dir):
    return G.neighbours(triples(spark, sf_dir), seeds(spark, sf_dir), 2, "multigraph")


TYPED = f"(SELECT * FROM ({EDGES}) WHERE relation IN ('supplies_from', 'part_of'))"


@query("g22_typed_neighbours", walk_sql(f"SELECT DISTINCT subject AS a, object AS b FROM {TYPED} UNION SELECT object, subject FROM {TYPED}", 2))
def g22(spark, sf_dir):
    return G.typed_neighbours(triples(spark, sf_dir), seeds(spark, sf_dir), 2, ["supplies_from", "part_of"])


@query("g22_typed_out_or_in", walk_sql(f"SELECT DISTINCT subject AS a, object AS b FROM {TYPED}", 2))
def g22m(spark, sf_dir):
    return G.typed_neighbours(triples(spark, sf_dir), seeds(spark, sf_dir), 2, ["supplies_from", "part_of"], "multigraph")


@query("g23_predecessors", f"SELECT object, count(*) AS n_in FROM ({EDGES}) GROUP BY object")
def g23(spark, sf_dir):
    return triples(spark, sf_dir).groupBy("object").agg(F.count("*").alias("n_in"))


@query("g24_name_index", "SELECT lower(n_name) AS key, n_name AS canonical FROM nation UNION SELECT 'alias' || n_nationkey, n_name FROM nation")
def g24(spark, sf_dir):
    names = F.array(F.lower("n_name"), F.concat(F.lit("alias"), F.col("n_nationkey").cast("string")))
    return table(spark, sf_dir, "nation").select(F.explode(F.array_distinct(names)).alias("key"), F.col("n_name").alias("canonical"))


ASKED = "SELECT item_id AS query_id, 'tell me about ' || n_name || ' and ' || lower(r_name) || '; ' || text AS text FROM benchmark JOIN nation ON n_nationkey = item_id % 25 JOIN region ON r_regionkey = n_regionkey"
MATCHED = f"SELECT query_id, name FROM ({ASKED}) q, (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region) n WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])' || regexp_replace(lower(name), '[^a-z0-9_]+', '[^a-z0-9_]+', 'g') || '([^a-z0-9_]|$)')"


def asked(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    q = table(spark, sf_dir, "benchmark").join(F.broadcast(n), F.col("item_id") % 25 == F.col("n_nationkey"))
    return q.select(F.col("item_id").alias("query_id"), F.concat(F.lit("tell me about "), "n_name", F.lit(" and "), F.lower("r_name"), F.lit("; "), F.col("text")).alias("text"))


def names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query("g25_entity_matching", MATCHED)
def g25(spark, sf_dir):
    return G.match_entities(asked(spark, sf_dir), names(spark, sf_dir))


@query("g26_normalised_queries", f"SELECT query_id, {S.strip(S.collapse(S.replace('lower(text)', '[-_]', ' ')))} AS normalised FROM ({ASKED})")
def g26(spark, sf_dir):
    from ..functions import text as T

    return asked(spark, sf_dir).select("query_id", T.strip(T.collapse(F.regexp_replace(F.lower("text"), "[-_]", " "))).alias("normalised"))


@query("g27_alias_expansion", f"SELECT query_id, name AS term FROM ({MATCHED}) UNION SELECT query_id, 'alias' || n_nationkey FROM ({MATCHED}) JOIN nation ON n_name = name")
def g27(spark, sf_dir):
    m = g25(spark, sf_dir)
    alias = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("alias"), F.col("n_nationkey").cast("string")).alias("term"))
    return m.select("query_id", F.col("name").alias("term")).union(m.join(alias, "name").select("query_id", "term")).distinct()


EDGE = f"(SELECT subject, object, CAST(sum(weight) AS BIGINT) AS weight FROM ({EDGES}) GROUP BY 1, 2)"


@query(
    "g28_query_expansion",
    f"""
    WITH m AS ({MATCHED}), q AS ({ASKED}), near AS (SELECT subject AS name, object AS term, weight FROM {EDGE} UNION ALL SELECT object, subject, weight FROM {EDGE}),
    t AS (SELECT query_id, term, sum(weight) AS w FROM m JOIN near USING (name) GROUP BY 1, 2),
    r AS (SELECT t.query_id, term, CAST(row_number() OVER (PARTITION BY t.query_id ORDER BY w DESC, term) AS INTEGER) AS rank FROM t JOIN q ON q.query_id = t.query_id WHERE NOT contains(lower(text), lower(term)))
    SELECT * FROM r WHERE rank <= 3
    """,
)
def g28(spark, sf_dir):
    return G.expand_query(g25(spark, sf_dir), g16(spark, sf_dir), asked(spark, sf_dir))


@query(
    "g29_path_matching",
    f"""
    WITH h1 AS (SELECT subject AS a, object AS b FROM ({EDGES}) WHERE relation = 'supplies_from' UNION SELECT object, subject FROM ({EDGES}) WHERE relation = 'supplies_from'),
    h2 AS (SELECT subject AS a, object AS b FROM ({EDGES}) WHERE relation = 'part_of' UNION SELECT object, subject FROM ({EDGES}) WHERE relation = 'part_of')
    SELECT DISTINCT seed, y.b AS terminal, 'supplies_from > part_of' AS label FROM ({SEEDS}) s JOIN h1 x ON x.a = seed JOIN h2 y ON y.a = x.b WHERE x.b <> seed AND y.b NOT IN (seed, x.b)
    """,
)
def g29(spark, sf_dir):
    return G.match_paths(triples(spark, sf_dir), seeds(spark, sf_dir), ["supplies_from", "part_of"])


#: The ontology that patterns are held against: of each relation the types of its ends; none means any.
ENDS = [("supplies_from", ["supplier"], ["nation"]), ("part_of", ["nation"], ["region"]), ("stocks", [], ["supplier"])]
HOP = "CASE o_orderkey % 5 WHEN 0 THEN 'supplies_from' WHEN 1 THEN 'part_of' WHEN 2 THEN 'nowhere' ELSE 'stocks' END"


@query(
    "g30_pattern_validation",
    f"""
    WITH t(relation, sources, targets) AS (VALUES {', '.join(f"('{r}', {a}::VARCHAR[], {b}::VARCHAR[])" for r, a, b in ENDS)}),
    h AS (SELECT o_custkey AS pattern, o_orderkey AS place, {HOP} AS relation FROM orders),
    f AS (SELECT h.*, t.sources IS NOT NULL AS known, targets, lead(sources) OVER (PARTITION BY pattern ORDER BY place) AS following FROM h LEFT JOIN t USING (relation))
    SELECT pattern, place, 'unknown edge' AS problem FROM f WHERE NOT known
    UNION ALL SELECT pattern, place, 'incompatible hop' FROM f WHERE len(targets) > 0 AND len(following) > 0 AND NOT list_has_any(targets, following)
    """,
)
def g30(spark, sf_dir):
    """Each customer is a pattern, the orders are its hops."""
    hops = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pattern"), F.col("o_orderkey").alias("place"), F.expr(HOP).alias("relation"))
    types = spark.createDataFrame(ENDS, "relation string, source_types array<string>, target_types array<string>")
    return G.path_errors(hops, F.broadcast(types.withColumn("known", F.lit(True))))


@query(
    "g31_context",
    f"""
    WITH t AS (SELECT query_id, relation, subject || ' ' || relation || ' ' || object AS line FROM ({MATCHED}) JOIN ({EDGES}) ON subject = name),
    b AS (SELECT query_id, relation, count(*) AS n, string_agg(line, chr(10) ORDER BY line) AS block FROM t GROUP BY 1, 2),
    k AS (SELECT *, sum(length(block) + 1) OVER (PARTITION BY query_id ORDER BY n DESC, relation ROWS UNBOUNDED PRECEDING) AS upto FROM b)
    SELECT query_id, string_agg(block, chr(10) ORDER BY n DESC, relation) AS context FROM k WHERE upto <= 400 GROUP BY query_id
    """,
)
def g31(spark, sf_dir):
    near = asked(spark, sf_dir).select("query_id").join(g25(spark, sf_dir), "query_id").join(triples(spark, sf_dir), F.col("name") == F.col("subject"))
    return G.context_lines(near, 400)


@query("g33_context_summary", f"SELECT query_id, string_agg(line, chr(10) ORDER BY line) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line) AS rn FROM (SELECT DISTINCT query_id, subject || ' ' || relation || ' ' || object AS line FROM ({MATCHED}) JOIN ({EDGES}) ON subject = name)) WHERE rn <= 5 GROUP BY query_id")
def g33(spark, sf_dir):
    lines = g25(spark, sf_dir).join(triples(spark, sf_dir), F.col("name") == F.col("subject")).select("query_id", F.concat("subject", F.lit(" "), "relation", F.lit(" "), "object").alias("line")).distinct()
    kept = lines.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("line"))).filter("rn <= 5")
    return kept.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("summary"))


# ---------------------------------------------------------------- statistics, communities, output


@query("a5_graph_top", f"SELECT node, n FROM (SELECT node, count(*) AS n FROM (SELECT subject AS node FROM ({EDGES}) UNION ALL SELECT object FROM ({EDGES})) GROUP BY node) ORDER BY n DESC, node LIMIT 10")
def a5(spark, sf_dir):
    """The ten most mentioned: the ten are the feature."""
    ends = triples(spark, sf_dir).select(F.explode(F.array("subject", "object")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(10)


@query("a5_graph_size", f"SELECT count(DISTINCT node) AS nodes, (SELECT count(*) FROM {EDGE}) AS edges FROM (SELECT subject AS node FROM ({EDGES}) UNION ALL SELECT object FROM ({EDGES}))")
def a5s(spark, sf_dir):
    t = triples(spark, sf_dir)
    nodes = t.select(F.explode(F.array("subject", "object")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    return nodes.crossJoin(g16(spark, sf_dir).agg(F.count("*").alias("edges")))


@query("a6_edge_weights", f"SELECT relation, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM ({EDGES}) GROUP BY relation")
def a6(spark, sf_dir):
    return triples(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


G16 = f"SELECT subject, object, sum(weight) AS weight FROM ({EDGES}) WHERE subject <> object GROUP BY 1, 2"


def propagation_steps(name: str, edges: str, rounds: int) -> str:
    """The common table expressions of label propagation over `edges`; the last is {name}_l{rounds}."""
    steps = [
        f"{name}_both AS MATERIALIZED (SELECT node, other, max(weight) AS weight FROM (SELECT subject AS node, object AS other, weight FROM {edges} UNION ALL SELECT object, subject, weight FROM {edges}) GROUP BY 1, 2)",
        f"{name}_l0 AS MATERIALIZED (SELECT node, max(weight) AS own, node AS community FROM {name}_both GROUP BY node)",
    ]
    for k in range(rounds):
        labels = f"{name}_l{k}"
        votes = f"SELECT node, label, sum(w) AS w FROM (SELECT b.node, l.community AS label, b.weight AS w FROM {name}_both b JOIN {labels} l ON l.node = b.other UNION ALL SELECT node, community, own FROM {labels}) GROUP BY 1, 2"
        steps.append(f"{name}_l{k + 1} AS MATERIALIZED (SELECT l.node, l.own, b.label AS community FROM {labels} l JOIN (SELECT node, label FROM ({votes}) QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, label) = 1) b USING (node))")
    return ", ".join(steps)


@query("g35_communities", f"WITH g AS MATERIALIZED ({G16}), {propagation_steps('a', 'g', 5)} SELECT node, community FROM a_l5")
def g35(spark, sf_dir):
    return G.communities(g16(spark, sf_dir).select("subject", "object", "weight"))


@query("g35_leiden")
def g35l(spark, sf_dir):
    """By modularity; without SQL, since it takes as many rounds as there is something to gain."""
    return leiden(g16(spark, sf_dir).select("subject", "object", "weight"))


MEMBERS = "SELECT 'c' || c_custkey AS node, CASE WHEN c_custkey % 50 = 0 THEN 'x' || c_custkey ELSE 'n' || c_nationkey END AS community FROM customer"


def members(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    community = F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k).alias("node"), community.alias("community"))


@query("g36_small_communities", f"SELECT node, CASE WHEN count(*) OVER (PARTITION BY community) < 3 THEN '-1' ELSE community END AS community FROM ({MEMBERS})")
def g36(spark, sf_dir):
    return G.bucket_small(members(spark, sf_dir))


@query(
    "g38_community_changes",
    f"""
    WITH a AS (SELECT community, list_sort(list(node)) AS m FROM ({MEMBERS}) WHERE hash_mod <> 1 GROUP BY 1), b AS (SELECT community, list_sort(list(node)) AS m FROM ({MEMBERS}) WHERE community <> 'n3' GROUP BY 1)
    SELECT coalesce(a.community, b.community) AS community, CASE WHEN a.m IS NULL THEN 'new' WHEN b.m IS NULL THEN 'removed' WHEN a.m <> b.m THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.community = b.community
    """.replace("hash_mod <> 1", "length(node) < 4 OR community LIKE 'n%'"),
)
def g38(spark, sf_dir):
    m = members(spark, sf_dir)
    return G.community_changes(m.filter((F.length("node") < 4) | F.col("community").like("n%")), m.filter("community <> 'n3'"))


@query("g34_communities_touched", f"SELECT query_id, community, count(DISTINCT node) AS touched FROM ({ASKED}) q JOIN ({MEMBERS}) m ON community = 'n' || (query_id % 25) GROUP BY 1, 2")
def g34(spark, sf_dir):
    """A community's nodes are counted once, whatever number of queries touches it."""
    q = asked(spark, sf_dir).select("query_id", F.concat(F.lit("n"), (F.col("query_id") % 25).cast("string")).alias("community")).distinct()
    counts = members(spark, sf_dir).groupBy("community").agg(F.countDistinct("node").alias("touched"))
    return q.join(counts, "community").select("query_id", "community", "touched")


@query("g39_summary_inputs", f"SELECT node FROM (SELECT node, sum(3) OVER (PARTITION BY community ORDER BY node ROWS UNBOUNDED PRECEDING) * 1.3 AS w FROM ({MEMBERS})) WHERE w <= 20")
def g39(spark, sf_dir):
    w = Window.partitionBy("community").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    return members(spark, sf_dir).withColumn("w", F.sum(F.lit(3)).over(w) * 1.3).filter("w <= 20").select("node")


@query("g40_alias_resolution", "SELECT 'alias' || n_nationkey AS loser, n_name AS winner, 1.0::DOUBLE AS similarity FROM nation")
def g40(spark, sf_dir):
    entities = g24(spark, sf_dir)
    alias = entities.filter(F.col("key").like("alias%"))
    return alias.join(names(spark, sf_dir), F.lower("canonical") == F.lower("name")).select(F.col("key").alias("loser"), F.col("name").alias("winner"), F.lit(1.0).alias("similarity"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("name"), F.col("label").cast("string").alias("type"), F.col("vec_id").alias("place"), F.col("embedding").alias("vector"))


SIMILAR = """
    WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.label::VARCHAR AS type, 'e' || a.vec_id AS a, 'e' || b.vec_id AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 5) AS similarity
    FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.3
"""


@query("g41_similar_entities", SIMILAR)
def g41(spark, sf_dir):
    return G.similar_names(vectors(spark, sf_dir), 0.3).withColumn("similarity", F.round("similarity", 5))


def greedy_sql(counts: str) -> str:
    """The pairs of a type folded in order; counts: (name, n)."""
    start = "{'a': '', 'b': '', 'na': 0::BIGINT, 'nb': 0::BIGINT, 'gone': []::VARCHAR[], 'merged': []::STRUCT(loser VARCHAR, winner VARCHAR)[]}"
    one = "{'a': a, 'b': b, 'na': x.n::BIGINT, 'nb': y.n::BIGINT, 'gone': []::VARCHAR[], 'merged': []::STRUCT(loser VARCHAR, winner VARCHAR)[]}"
    lost, won = "(CASE WHEN p.nb > p.na THEN p.a ELSE p.b END)", "(CASE WHEN p.nb > p.na THEN p.b ELSE p.a END)"
    step = f"CASE WHEN list_contains(s.gone, p.a) OR list_contains(s.gone, p.b) THEN s ELSE {{'a': p.a, 'b': p.b, 'na': p.na, 'nb': p.nb, 'gone': list_append(s.gone, {lost}), 'merged': list_append(s.merged, {{'loser': {lost}, 'winner': {won}}})}} END"
    return f"""
    SELECT m.loser, m.winner FROM (
      SELECT unnest(list_reduce(list_prepend({start}, list({one} ORDER BY a, b)), lambda s, p: {step}).merged) AS m
      FROM ({SIMILAR}) JOIN ({counts}) x ON x.name = a JOIN ({counts}) y ON y.name = b GROUP BY type)
    """


@query("g41_greedy_merges", greedy_sql("SELECT 'e' || vec_id AS name, vec_id % 7 AS n FROM embeddings"))
def g41g(spark, sf_dir):
    counts = vectors(spark, sf_dir).select(F.col("name").alias("canonical"), (F.col("place") % 7).alias("mention_count"))
    return G.similar_merges(vectors(spark, sf_dir), counts, 0.3)


@query(
    "s22_graph_json",
    f"""
    SELECT '{{"subject":' || to_json(subject) || ',"object":' || to_json(object) || ',"relation":' || to_json(arg_min(relation, seq)) || ',"weight":' || sum(weight) || ',"sources":' || to_json(list_sort(list(DISTINCT source))) || '}}' AS edge
    FROM ({EDGES}) GROUP BY subject, object
    """,
)
def s22(spark, sf_dir):
    return g16(spark, sf_dir).select(F.to_json(F.struct("subject", "object", "relation", "weight", "sources")).alias("edge"))


@query(
    "s23_notes",
    f"""
    WITH n AS (SELECT DISTINCT subject AS c FROM ({EDGES}) UNION SELECT object FROM ({EDGES})), g AS (SELECT subject, object, arg_min(relation, seq) AS relation FROM ({EDGES}) GROUP BY 1, 2),
    l AS (SELECT subject AS c, 0 AS k, '- ' || relation || ' [[' || object || ']]' AS line FROM g UNION ALL SELECT object, 1, '- ' || relation || ' [[' || subject || ']]' FROM g)
    SELECT c AS canonical, '# ' || c || chr(10) || string_agg(line, chr(10) ORDER BY k, line) AS note FROM n JOIN l USING (c) GROUP BY c
    """,
)
def s23(spark, sf_dir):
    edges = g16(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("subject", "object")).alias("canonical")).distinct()
    return G.notes(edges, nodes)


@query("s24_node_sizes", f"SELECT node, least(20, greatest(3, n)) AS size FROM (SELECT node, count(*) AS n FROM (SELECT subject AS node FROM ({EDGES}) UNION ALL SELECT object FROM ({EDGES})) GROUP BY node)")
def s24(spark, sf_dir):
    ends = triples(spark, sf_dir).select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    return ends.select("node", F.least(F.lit(20), F.greatest(F.lit(3), F.col("n"))).alias("size"))


@query("f8_valid_entities", f"SELECT name FROM ({ENTITIES}) GROUP BY name HAVING length(name) BETWEEN 2 AND 60")
def f8(spark, sf_dir):
    return g1(spark, sf_dir).groupBy("name").agg(F.count("*").alias("mention_count")).filter((F.length("name") >= 2) & (F.length("name") <= 60) & (F.col("mention_count") >= 1)).select("name")


@query("f10_phase_gating", "SELECT n_nationkey FROM nation WHERE n_regionkey <= 2 AND n_regionkey >= 0")
def f10(spark, sf_dir):
    """A type is active from its own phase on; a type without phase never is."""
    ranks = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 9), (4, None)], "n_regionkey int, rank int")
    return table(spark, sf_dir, "nation").join(F.broadcast(ranks), "n_regionkey").filter("rank <= 3").select("n_nationkey")


@query("p9_community_lookups", f"SELECT community, list_sort(list(node)) AS members, count(*) AS member_count FROM ({MEMBERS}) GROUP BY community")
def p9(spark, sf_dir):
    return members(spark, sf_dir).groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("members"), F.count("*").alias("member_count"))


#: A file list for each part: its own source, the lists of the parts of twice its number, and of its third, so that lists name each other in circles.
LIST_LINES = "SELECT 'p' || p_partkey || '.f' AS file, 'p' || p_partkey || '.sv' AS line FROM part UNION ALL SELECT 'p' || p_partkey || '.f', '-f p' || (p_partkey * 2) || '.f' FROM part UNION ALL SELECT 'p' || p_partkey || '.f', '-f p' || (p_partkey * 2 + 1) || '.f' FROM part UNION ALL SELECT 'p' || p_partkey || '.f', '-f p' || (p_partkey // 3) || '.f' FROM part WHERE p_partkey % 7 = 0"


@query("g11_filelist_expansion", f"WITH RECURSIVE f AS ({LIST_LINES}), w(file) AS (SELECT 'p3.f' UNION SELECT substr(line, 4) FROM w JOIN f USING (file) WHERE line LIKE '-f %') SELECT line AS source FROM w JOIN f USING (file) WHERE line NOT LIKE '-f %'")
def g11(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda c, end: F.concat(F.lit("p"), c.cast("string"), F.lit(end))
    others = F.array_compact(F.array(k * 2, k * 2 + 1, F.when(k % 7 == 0, F.floor(k / 3))))
    lines = table(spark, sf_dir, "part").select(name(k, ".f").alias("file"), F.explode(F.concat(F.array(name(k, ".sv")), F.transform(others, lambda n: F.concat(F.lit("-f "), name(n, ".f"))))).alias("line"))
    includes = lines.filter(F.col("line").like("-f %")).select(F.col("file").alias("subject"), F.expr("substring(line, 4)").alias("object"))
    start = spark.createDataFrame([("p3.f",)], "seed string")
    files = G.reachable(includes, start).select(F.col("node").alias("file")).union(start.select("seed"))
    return lines.filter(~F.col("line").like("-f %")).join(files.distinct(), "file", "left_semi").select(F.col("line").alias("source"))


@query("g12_top_modules", f"SELECT min(subject) AS top FROM ({EDGES}) WHERE subject NOT IN (SELECT object FROM ({EDGES}))")
def g12(spark, sf_dir):
    t = triples(spark, sf_dir)
    return t.select("subject").join(t.select(F.col("object").alias("subject")), "subject", "left_anti").agg(F.min("subject").alias("top"))


COUNTED = f"SELECT n_name AS name, count(*) AS mention_count FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"
LONG_WORDS = lambda c: f"list_distinct(list_filter({S.words(f'lower({c})')}, lambda w: length(w) >= 3))"
#: Every third question names no entity.
TERM_QUERIES = "SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'qq ' || (CASE WHEN item_id % 2 = 0 THEN text ELSE '' END) ELSE 'Where is ' || n_name || ' ? ' || text END AS text FROM benchmark JOIN nation ON n_nationkey = item_id % 25"


@query(
    "j11_known_terms",
    f"""
    WITH q AS (SELECT query_id, {LONG_WORDS('text')} AS ws FROM ({TERM_QUERIES})), t AS ({COUNTED}), i AS (SELECT name, mention_count, unnest({LONG_WORDS('name')}) AS word FROM t),
    h AS (SELECT DISTINCT query_id, name, mention_count FROM (SELECT query_id, unnest(ws) AS word FROM q) JOIN i USING (word)),
    b AS (SELECT * FROM t ORDER BY mention_count DESC, name LIMIT 20),
    a AS (SELECT * FROM h UNION ALL SELECT query_id, name, mention_count FROM q, b WHERE len(ws) > 0 AND query_id NOT IN (SELECT query_id FROM h))
    SELECT query_id, name AS term, CAST(row_number() OVER (PARTITION BY query_id ORDER BY mention_count DESC, name) AS INTEGER) AS rank FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mention_count DESC, name) <= 20
    """,
)
def j11(spark, sf_dir):
    from ..operators.search import known_terms

    nations = table(spark, sf_dir, "nation")
    counted = table(spark, sf_dir, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("mention_count"))
    n = F.col("item_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("qq "), F.when(n % 2 == 0, F.col("text")).otherwise(""))).otherwise(F.concat(F.lit("Where is "), "n_name", F.lit(" ? "), "text"))
    queries = table(spark, sf_dir, "benchmark").join(nations, n % 25 == F.col("n_nationkey")).select(n.alias("query_id"), text.alias("text"))
    return known_terms(queries, counted)


# ---------------------------------------------------------------- communities in an answer, hierarchy, resolution


SUMMARIES = "SELECT r_regionkey AS community, r_name || ' holds ' || string_agg(n_name, ', ' ORDER BY n_name) AS summary FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name"


@query(
    "g32_community_section",
    f"""
    WITH s AS ({SUMMARIES}), t AS (SELECT query_id, n_regionkey AS community, count(*) AS n FROM ({MATCHED}) JOIN nation ON n_name = name GROUP BY 1, 2),
    e AS (SELECT q.query_id, s.community, coalesce(t.n, 0) AS n, '[Community ' || s.community || '] (' || coalesce(t.n, 0) || ' entities touched): ' || summary AS line FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN s LEFT JOIN t ON t.query_id = q.query_id AND t.community = s.community),
    k AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY n DESC, community DESC ROWS UNBOUNDED PRECEDING) AS upto FROM e)
    SELECT query_id, '<communities>' || chr(10) || string_agg(line, chr(10) ORDER BY n DESC, community) || chr(10) || '</communities>' AS section FROM k WHERE upto <= 60 * 4 GROUP BY query_id
    """,
)
def g32(spark, sf_dir):
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    summaries = regions.groupBy(F.col("r_regionkey").alias("community"), "r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))
    summaries = summaries.select("community", F.concat("r_name", F.lit(" holds "), "names").alias("summary"))
    touched = g25(spark, sf_dir).join(regions.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("community")), "name").groupBy("query_id", "community").agg(F.count("*").alias("n"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return G.community_section(queries, summaries, touched, 60, "<communities>", "</communities>")


def hierarchy_sql(edges: str = G16, before: str = "", rounds: int = 5, least: int = 3) -> str:
    """Level 1 below the communities of level 0: label propagation on unit weights inside each. before: expressions that edges may use."""
    inner = "SELECT DISTINCT least(g.subject, g.object) AS subject, greatest(g.subject, g.object) AS object, 1 AS weight FROM g JOIN top a ON a.node = g.subject JOIN top b ON b.node = g.object WHERE a.community = b.community AND a.community IN (SELECT community FROM top GROUP BY community HAVING count(*) >= 6)"
    one = lambda k, g: propagation_steps(k, g, rounds)
    return f"""
    WITH RECURSIVE {before} g AS MATERIALIZED ({edges}), {one('a', 'g')},
    flat AS (SELECT node, community FROM a_l{rounds}),
    top AS MATERIALIZED (SELECT node, CASE WHEN count(*) OVER (PARTITION BY community) < {least} THEN '-1' ELSE community END AS community FROM flat),
    i AS MATERIALIZED ({inner.replace('FROM top GROUP', "FROM top WHERE community <> '-1' GROUP")}), {one('b', 'i')},
    parts AS (SELECT t.community AS parent, b.node, b.community FROM b_l{rounds} b JOIN top t USING (node)),
    sized AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY parent, community) < {least} THEN '-1' ELSE community END AS part FROM parts),
    kept AS (SELECT * FROM sized WHERE parent IN (SELECT parent FROM sized WHERE part <> '-1' GROUP BY parent HAVING count(DISTINCT part) >= 2))
    SELECT 0 AS level, community, node FROM top UNION ALL SELECT 1, parent || ' / ' || part, node FROM kept
    """


@query("g37_community_levels", hierarchy_sql())
def g37(spark, sf_dir):
    """Two levels."""
    return G.community_levels(g16(spark, sf_dir).select("subject", "object", "weight"), 2)


RING_COUNTS = "SELECT chr(101) || vec_id AS name, vec_id % 7 + CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END AS n FROM embeddings"


@query(
    "g42_resolution",
    f"SELECT 'also e' || vec_id AS loser, 'e' || vec_id AS winner, 'alias' AS phase FROM embeddings WHERE vec_id % 10 = 0 UNION ALL SELECT loser, winner, 'embedding' FROM ({greedy_sql(RING_COUNTS)})",
)
def g42(spark, sf_dir):
    return G.resolve(*resolution_inputs(spark, sf_dir))[2]


def resolution_inputs(spark, sf_dir):
    """Entities e0, e1, ... in a ring, each tenth also written as an alias."""
    v = vectors(spark, sf_dir)
    known = v.select(F.col("name").alias("canonical"), (F.col("place") % 7 + 1).alias("mention_count"), F.array("type").alias("sources"))
    alias = v.filter("place % 10 = 0").select(F.concat(F.lit("also "), "name").alias("alias"), F.col("name").alias("target"))
    nodes = known.unionByName(alias.select(F.col("alias").alias("canonical"), F.lit(1).cast("long").alias("mention_count"), F.array(F.lit("alias")).alias("sources")))
    edges = v.select(F.col("name").alias("subject"), F.concat(F.lit("e"), (F.col("place") + 1).cast("string")).alias("object"), F.lit("next").alias("relation"), F.lit(1).alias("weight"))
    return nodes, edges.join(v.select(F.col("name").alias("object")), "object", "left_semi"), alias, v, 0.3


RESOLVED = f"""
    mg AS MATERIALIZED ({greedy_sql(RING_COUNTS)}), ch(loser, winner) AS (SELECT loser, winner FROM mg UNION ALL SELECT ch.loser, mg.winner FROM ch JOIN mg ON mg.loser = ch.winner),
    fw AS MATERIALIZED (SELECT loser, winner FROM ch WHERE winner NOT IN (SELECT loser FROM mg)), ring AS (SELECT 'e' || a.vec_id AS s, 'e' || b.vec_id AS o FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
"""
MOVED = "SELECT coalesce(x.winner, s) AS subject, coalesce(y.winner, o) AS object, count(*) AS weight FROM ring LEFT JOIN fw x ON x.loser = s LEFT JOIN fw y ON y.loser = o WHERE coalesce(x.winner, s) <> coalesce(y.winner, o) GROUP BY 1, 2"


@query("g43_after_ingest", f"SELECT level, community, count(*) AS members FROM ({hierarchy_sql(MOVED, RESOLVED)}) GROUP BY 1, 2")
def g43(spark, sf_dir):
    from ..engine import after_ingest

    out = after_ingest(*resolution_inputs(spark, sf_dir), levels=2)
    return out["communities"].groupBy("level", "community").agg(F.count("*").alias("members"))


# ---------------------------------------------------------------- G7: what a model extracted


REPLY = """'{"entities": [{"name": " ' || n_name || ' ", "type": "nation"}, {"name": "' || n_name || '", "type": "region"}, {"name": "item ' || item_id || '", "type": "thing", "description": "an item"}, {"name": "", "type": "nation"}, {"type": "nation"}], "relationships": [{"source": "item ' || item_id || '", "relation": "mentions", "target": "' || n_name || '"}, {"source": "item ' || item_id || '", "relation": "likes", "target": "x"}, {"source": "", "relation": "mentions", "target": "x"}]}'"""
BROKEN = "item_id % 4 = 3"


def replies(spark, sf_dir):
    n = F.col("item_id").cast("string")
    item, nation = F.concat(F.lit("item "), n), F.col("n_name")
    body = F.format_string('{"entities": [{"name": " %2$s ", "type": "nation"}, {"name": "%2$s", "type": "region"}, {"name": "%1$s", "type": "thing", "description": "an item"}, {"name": "", "type": "nation"}, {"type": "nation"}], "relationships": [{"source": "%1$s", "relation": "mentions", "target": "%2$s"}, {"source": "%1$s", "relation": "likes", "target": "x"}, {"source": "", "relation": "mentions", "target": "x"}]}', item, nation)
    rows = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "nation"), F.col("item_id") % 25 == F.col("n_nationkey"))
    reply = F.when(F.expr(BROKEN), F.concat(F.lit("no JSON: "), "text")).when(F.col("item_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select(F.concat(F.lit("doc "), n).alias("source"), reply.alias("reply"))


@query("g7_extracted_entities", f"SELECT 'doc ' || item_id AS source, unnest([n_name, 'item ' || item_id]) AS name, unnest(['nation', 'concept']) AS type, unnest([NULL, 'an item']) AS description FROM benchmark JOIN nation ON n_nationkey = item_id % 25 WHERE NOT ({BROKEN})")
def g7(spark, sf_dir):
    return G.extracted(replies(spark, sf_dir), ["nation", "region"], ["mentions"], "concept")[0]


@query("g7_extracted_triples", f"SELECT 'doc ' || item_id AS source, 'item ' || item_id AS subject, 'mentions' AS relation, n_name AS object FROM benchmark JOIN nation ON n_nationkey = item_id % 25 WHERE NOT ({BROKEN})")
def g7t(spark, sf_dir):
    return G.extracted(replies(spark, sf_dir), ["nation", "region"], ["mentions"], "concept")[1]
