"""Chunking, provenance and code (K, E4, E5, S8, S9, G8 to G10 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import table_functions
from ..functions import text as T
from ..operators import chunking as C
from ..registry import query, table
from ..sources import code
from ..sources.checkpoint import checkpointed
from . import sql as S


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "k1_windows",
    "SELECT doc_id, i AS chunk_index, substr(text, CAST(i * 462 AS INTEGER) + 1, 512) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 462 + 1)) AS i FROM documents)",
)
def k1(spark, sf_dir):
    return C.windows(docs(spark, sf_dir), "doc_id")


@query("k1_recursive_chunks")
def k1r(spark, sf_dir):
    return C.recursive_chunks(docs(spark, sf_dir), "doc_id")


HEADED = "'# A ' || source || chr(10) || 'intro' || chr(10) || '## B ' || lang || chr(10) || text || chr(10) || '# C' || chr(10) || 'tail ' || doc_id"


def headed(spark, sf_dir):
    t = F.concat(F.lit("# A "), "source", F.lit("\nintro\n## B "), "lang", F.lit("\n"), "text", F.lit("\n# C\ntail "), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", t.alias("text"))


def sections_sql() -> str:
    n = "CASE WHEN regexp_matches(line, '^#{1,4}\\s+(.*\\S)\\s*$') THEN length(regexp_extract(line, '^(#{1,4})\\s+(.*\\S)\\s*$', 1)) END"
    parts = []
    for k in range(1, 5):
        parts.append(f"CASE WHEN max(CASE WHEN level = {k} THEN i END) OVER w > coalesce(max(CASE WHEN level < {k} THEN i END) OVER w, -1) THEN last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w END AS h{k}")
    return f"""
    WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, {HEADED} AS t FROM documents)),
    m AS (SELECT *, {n} AS level, CASE WHEN regexp_matches(line, '^#{{1,4}}\\s+(.*\\S)\\s*$') THEN regexp_extract(line, '^(#{{1,4}})\\s+(.*\\S)\\s*$', 2) END AS title FROM l),
    s AS (SELECT *, count(level) OVER w AS section, {', '.join(parts)} FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT doc_id, section, list_filter(arg_max([h1, h2, h3, h4], i), lambda x: x IS NOT NULL) AS path, {S.strip("string_agg(line, chr(10) ORDER BY i)")} AS content FROM s GROUP BY doc_id, section)
    SELECT doc_id, section, array_to_string(path, ' > ') AS section_path, coalesce(path[-1], '') AS heading, CAST(len(path) AS BIGINT) AS heading_level, content FROM g WHERE content <> ''
    """


@query("k2_sections", sections_sql())
def k2(spark, sf_dir):
    return C.sections(headed(spark, sf_dir), "doc_id")


@query("k3_hybrid_chunks")
def k3(spark, sf_dir):
    return C.hybrid_chunks(headed(spark, sf_dir), "doc_id", size=200, overlap=20)


@query("k3_parse_chunks")
def k3_sql(spark, sf_dir):
    """k3_hybrid_chunks as SQL, by a table function."""
    table_functions.register(spark)
    headed(spark, sf_dir).createOrReplaceTempView("headed_documents")
    return spark.sql("SELECT doc_id, c.* FROM headed_documents, LATERAL parse_chunks(text, 'markdown', 200, 20) c")


@query("s8_parse_chunks")
def s8_sql(spark, sf_dir):
    """s8_python_chunks as SQL, by the same table function."""
    table_functions.register(spark)
    sources(spark, sf_dir).createOrReplaceTempView("python_files")
    return spark.sql("SELECT item_id, concat_ws(' > ', string(item_id), nullif(name, '')) AS section_path, heading_level, chunk FROM python_files, LATERAL parse_chunks(text, 'python') c")


@query(
    "k4_semantic_groups",
    """
    WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    b AS (SELECT vec_id, label, CASE WHEN p IS NULL THEN 0 WHEN list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))) < 0.2 THEN 1 ELSE 0 END AS b FROM e)
    SELECT vec_id, CAST(sum(b) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM b
    """,
)
def k4(spark, sf_dir):
    return C.semantic_groups(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.2).select("vec_id", "group")


@query("k7_chunk_numbers", "SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(n AS BIGINT) AS total_chunks FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)")
def k7(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", T.lines(F.col("text")).alias("ls"))
    return rows.select("doc_id", F.posexplode("ls").alias("i", "l"), F.size("ls").cast("long").alias("total_chunks")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), "total_chunks")


@query("k10_whole_document")
def k10(spark, sf_dir):
    cleaned = docs(spark, sf_dir).select("doc_id", T.clean_document(F.col("text")).alias("text"))
    return C.recursive_chunks(cleaned, "doc_id")


@query(
    "e4_provenance_exact",
    "SELECT doc_id, i AS chunk_index, CAST(strpos(text, c) - 1 AS BIGINT) AS char_start, CAST(strpos(text, c) - 1 + length(c) AS BIGINT) AS char_end, 'exact_global' AS method FROM (SELECT doc_id, text, i, substr(text, CAST(i * 462 AS INTEGER) + 1, 512) AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 462 + 1)) AS i FROM documents)) WHERE c <> ''",
)
def e4x(spark, sf_dir):
    chunks = C.windows(docs(spark, sf_dir), "doc_id").filter("chunk <> ''")
    return C.provenance_exact(chunks, docs(spark, sf_dir), "doc_id", "chunk_index", "chunk", "text")


@query("e4_provenance")
def e4(spark, sf_dir):
    rows = checkpointed(docs(spark, sf_dir).select("doc_id", F.col("text").alias("original"), T.clean_document(F.col("text")).alias("refactored")), "refactored")  # chunks and texts both read it
    chunks = C.recursive_chunks(rows, "doc_id", "refactored").select("doc_id", "chunk_index", "chunk")
    return C.provenance(chunks, rows, "doc_id", "chunk_index", "chunk", "original", "refactored")


PYTHON = "import os\nfrom a.b import c\n\nLIMIT = 3\n\n\n@cached\ndef f(x):\n    return g(x)\n\n\nclass D(Base):\n    def m(self):\n        return os.getcwd()\n\n\nprint(f(1))\n"


def sources(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(PYTHON), F.lit("# "), F.col("item_id").cast("string")).alias("text"))


@query("s8_python_chunks")
def s8(spark, sf_dir):
    return code.python_chunks(sources(spark, sf_dir), "item_id")


@query("s9_python_relations")
def s9(spark, sf_dir):
    return code.python_relations(sources(spark, sf_dir), "item_id")


@query("g8_python_structure", "SELECT item_id, unnest(['module', 'module', 'D', 'module', 'module', 'module']) AS subject, unnest(['depends_on', 'depends_on', 'contains', 'contains', 'contains', 'contains']) AS relation, unnest(['os', 'a.b', 'D.m', 'LIMIT', 'f', 'D']) AS object FROM benchmark")
def g8(spark, sf_dir):
    return s9(spark, sf_dir).filter(F.col("relation").isin("contains", "depends_on"))


SHELL = "source lib.sh\n. $HOME/x.sh\nexport PATH_TO=1\nreadonly N=2\nrun() {\n  echo hi\n}\n"


@query("g9_shell_structure", "SELECT item_id, unnest(['function', 'source', 'export', 'readonly']) AS kind, unnest(['run', 'lib.sh', 'PATH_TO', 'N']) AS name FROM benchmark")
def g9(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.inline(code.by_patterns(F.lit(SHELL), code.SHELL)))


VERILOG = "import pkg::*;\nmodule top #(parameter W = 8) (\n  input logic clk,\n  output logic [7:0] q\n);\n  fifo #(.D(4)) u_fifo (.clk(clk));\nendmodule\n"


@query("g10_verilog_structure", "SELECT item_id, unnest(['module', 'parameter', 'port', 'port', 'import', 'instance']) AS kind, unnest(['top', 'W', 'clk', 'q', 'pkg', 'fifo']) AS name FROM benchmark")
def g10(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.inline(code.by_patterns(F.lit(VERILOG), code.VERILOG)))


@query(
    "k8_chosen_chunker",
    "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'recursive' WHEN item_id % 3 = 1 THEN 'code' ELSE 'markdown' END AS chunker, count(DISTINCT c) FILTER (WHERE item_id % 3 = 1) AS sections FROM benchmark, (SELECT unnest([1, 2, 3]) AS c) GROUP BY 1, 2",
)
def k8(spark, sf_dir):
    """Every third item is plain text, every third a program, and every third a program that doesn't parse."""
    n = F.col("item_id") % 3
    rows = table(spark, sf_dir, "benchmark")
    made = F.when(n == 0, F.col("text")).when(n == 1, F.concat(F.lit(PYTHON), F.lit("# "), F.col("item_id").cast("string"))).otherwise(F.concat(F.lit("def broken(:\n"), F.col("text")))
    files = rows.select("item_id", made.alias("text"), F.when(n == 0, "text").otherwise("code").alias("kind"))
    found = C.chosen_chunks(files, "item_id", "kind")
    return found.groupBy("item_id", "chunker").agg(F.count_if(F.col("chunker") == "code").alias("sections"))
