"""Parsing, cleaning and scoring of documents and pages (S, C, E rows of the inventory)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query, table
from . import sql as S

def project(name: str, source: str, key: str, text: str, function, expression: str) -> None:
    """A query of one computed text, by its length and hash, which any difference changes."""
    @query(
        name,
        f"SELECT {key}, CAST(length(v) AS BIGINT) AS n_chars_out, sha256(v) AS text_sha256 FROM (SELECT {key}, {expression} AS v FROM {source})",
    )
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, source).select(key, function(F.col(text)).alias("v"))
        return rows.select(key, F.length("v").cast("long").alias("n_chars_out"), F.sha2("v", 256).alias("text_sha256"))


# S5: HTML to Markdown
html = "html"
for level in range(1, 7):
    html = f"regexp_replace({html}, '(?is)<h{level}[^>]*>(.*?)</h{level}>', '{'#' * level} \\1', 'g')"
project("s5_html_to_markdown", "pages", "page_id", "html", T.html_to_markdown, S.strip(S.replace(html, "<[^>]+>")))


# C1: boilerplate. Look-ahead is not in RE2: the mail header block is cut by its own rule there
def boilerplate_sql(x: str) -> str:
    for pattern, flags in T.BOILERPLATE:
        by = ""
        pattern = pattern.replace(r"\z", "\x00").replace(r"\S", "\x01").replace(r"\s", f"[{S.SPACE}]").replace("\x01", f"[^{S.SPACE}]").replace(r"\w", f"[{S.WORD_CHAR}]")
        pattern = pattern.replace("\x00", r"\z").replace(r"\d", r"\p{Nd}")
        if "(?=" in pattern:
            head, _, tail = pattern.partition("(?=")
            pattern, by = f"{head}({tail}", r"\1"
        x = f"regexp_replace({x}, {S.q(f'(?m{flags}){pattern}')}, {S.q(by)}, 'g')"
    return x


project("c1_strip_boilerplate", "documents", "doc_id", "text", T.strip_boilerplate, boilerplate_sql("text"))


def typography_sql(x: str) -> str:
    return reduce(lambda t, p: f"replace({t}, {S.q(p[0])}, {S.q(p[1])})", T.TYPOGRAPHY.items(), x)


project("c2_plain_typography", "documents", "doc_id", "text", T.plain_typography, typography_sql("text"))


def whitespace_sql(x: str) -> str:
    inner = S.SPACE.replace(r"\t-\r", r"\t\x0b\f\r")
    return S.strip(S.replace(S.replace(S.replace(x, f"[{inner}]+", " "), r"\n{3,}", "\n\n"), r"(?m)[ ]+$"))


project("c3_clean_whitespace", "documents", "doc_id", "text", T.clean_whitespace, whitespace_sql("text"))


@query(
    "c5_strip_trailing_short_lines",
    f"""
    WITH l AS (
      SELECT doc_id, unnest(string_split({S.replace('text', f'[{S.SPACE}]+$')}, chr(10))) AS line, generate_subscripts(string_split({S.replace('text', f'[{S.SPACE}]+$')}, chr(10)), 1) AS i FROM documents
    ), k AS (
      SELECT *, max(CASE WHEN len({S.words('line')}) > 4 OR {S.strip('line')} = '' OR regexp_matches({S.strip('line')}, '[.?!]$') THEN i ELSE 0 END) OVER (PARTITION BY doc_id) AS last FROM l
    )
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i <= last), '') AS v FROM k GROUP BY doc_id
    """,
)
def c5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_trailing_short_lines(F.col("text")).alias("v"))


project("c7_strip_control", "documents", "doc_id", "text", T.strip_control, S.replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))


def initcap_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


UNMARKED = S.replace(S.replace("text", f"(?m)^[{S.SPACE}]*#{{1,6}}[{S.SPACE}]+"), f"(?m)^[{S.SPACE}]*={{2,}}[{S.SPACE}]*(.*?)[{S.SPACE}]*={{2,}}[{S.SPACE}]*$", r"\1")
MARKED = S.q(rf"^[{S.SPACE}]*\p{{Nd}}+(?:\.\p{{Nd}}+)*\.?[{S.SPACE}]+([A-Z][A-Z &/]+)$")


@query(
    "c4_strip_section_markers",
    f"SELECT doc_id, sha256(array_to_string(list_transform(string_split({UNMARKED}, chr(10)), lambda x: CASE WHEN regexp_matches(x, {MARKED}) THEN {initcap_sql(f'regexp_extract(x, {MARKED}, 1)')} ELSE x END), chr(10))) AS text_sha256 FROM documents",
)
def c4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.strip_section_markers(F.col("text")), 256).alias("text_sha256"))


WIKI = S.q(rf"^[{S.SPACE}]*(={{2,}})[{S.SPACE}]*(.*?)[{S.SPACE}]*={{2,}}[{S.SPACE}]*$")
NUMBERED = S.q(rf"^[{S.SPACE}]*(\p{{Nd}}+(?:\.\p{{Nd}}+)*)\.?[{S.SPACE}]+([A-Z][A-Za-z &/()\-]+(?:[{S.SPACE}]+[A-Za-z][A-Za-z &/()\-]*)*)$")


def headings_sql(x: str) -> str:
    title = S.strip(f"regexp_extract(x, {NUMBERED}, 2)")
    depth = f"length(regexp_replace(regexp_extract(x, {NUMBERED}, 1), '[^.]', '', 'g')) + 2"
    line = f"""CASE WHEN regexp_matches(x, {WIKI}) THEN repeat('#', least(length(regexp_extract(x, {WIKI}, 1)), 6)::BIGINT) || ' ' || {S.strip(f'regexp_extract(x, {WIKI}, 2)')}
        WHEN regexp_matches(x, {NUMBERED}) THEN repeat('#', least({depth}, 6)::BIGINT) || ' ' || CASE WHEN {title} = upper({title}) THEN {initcap_sql(title)} ELSE {title} END ELSE x END"""
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda x: {line}), chr(10))"


@query("c6_markdown_headings", f"SELECT doc_id, sha256({headings_sql('text')}) AS text_sha256 FROM documents")
def c6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.markdown_headings(F.col("text")), 256).alias("text_sha256"))


@query(
    "s6_rst_to_markdown",
    f"""
    WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split('Title' || chr(10) || '=====' || chr(10) || text, chr(10)) AS ls FROM documents)),
    c AS (SELECT *, lead(line) OVER w AS below, coalesce(regexp_matches(lead(line) OVER w, '^[{S.SPACE}]*[=~-]{{3,}}[{S.SPACE}]*$'), false) AND {S.strip('line')} <> '' AS may FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, may ORDER BY i) AS run FROM c),
    h AS (SELECT *, may AND row_number() OVER (PARTITION BY doc_id, may, run ORDER BY i) % 2 = 1 AS heads FROM r),
    s AS (SELECT *, coalesce(lag(heads) OVER (PARTITION BY doc_id ORDER BY i), false) AS skip FROM h)
    SELECT doc_id, sha256(string_agg(CASE WHEN heads THEN CASE substr({S.strip('below')}, 1, 1) WHEN '=' THEN '# ' WHEN '-' THEN '## ' ELSE '### ' END || {S.strip('line')} ELSE line END, chr(10) ORDER BY i)) AS text_sha256
    FROM s WHERE NOT skip GROUP BY doc_id
    """,
)
def s6(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Title\n=====\n"), F.col("text")).alias("rst"))
    return rows.select("doc_id", F.sha2(T.rst_to_markdown(F.col("rst")), 256).alias("text_sha256"))


@query(
    "clean_document",
    f"""
    WITH a AS (SELECT doc_id, {whitespace_sql(typography_sql(boilerplate_sql('text')))} AS t FROM documents), b AS (SELECT doc_id, {headings_sql('t')} AS t FROM a),
    l AS (SELECT doc_id, unnest(string_split({S.replace('t', f'[{S.SPACE}]+$')}, chr(10))) AS line, generate_subscripts(string_split({S.replace('t', f'[{S.SPACE}]+$')}, chr(10)), 1) AS i FROM b),
    k AS (SELECT *, max(CASE WHEN len({S.words('line')}) > 4 OR {S.strip('line')} = '' OR regexp_matches({S.strip('line')}, '[.?!]$') THEN i ELSE 0 END) OVER (PARTITION BY doc_id) AS last FROM l),
    j AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i <= last), '') AS t FROM k GROUP BY doc_id),
    v AS (SELECT doc_id, nfc_normalize({whitespace_sql('t')}) AS v FROM j)
    SELECT doc_id, CAST(length(v) AS BIGINT) AS n_chars_out, sha256(v) AS text_sha256 FROM v
    """,
)
def clean_document(spark, sf_dir):
    from ..functions.unicode import nfc

    cleaned = table(spark, sf_dir, "documents").select("doc_id", T.clean_document(F.col("text")).alias("c"))  # nfc() reads its column several times
    return cleaned.select("doc_id", nfc(F.col("c")).alias("v")).select("doc_id", F.length("v").cast("long").alias("n_chars_out"), F.sha2("v", 256).alias("text_sha256"))


notes = "[lower(split_part(text, chr(10), 1)), source]"
project(
    "c8_figure_notes", "documents", "doc_id", "text", lambda c: T.figure_notes(c, F.array(F.lower(F.substring_index(c, "\n", 1)), F.col("source"))),
    f"text || chr(10) || chr(10) || '## Figure Notes' || chr(10) || array_to_string(list_transform({notes}, lambda n: '- ' || n), chr(10))",
)


# C10, C11: metadata of a head that documents get from their columns
HEAD_SQL = "'Title: ' || split_part(text, chr(10), 1) || chr(10) || 'Author: A' || source || chr(10) || 'Tags: ' || lang || ', ' || source || chr(10) || 'Subject: ' || lang || chr(10) || chr(10) || text"


def head():
    return F.concat(F.lit("Title: "), F.substring_index("text", "\n", 1), F.lit("\nAuthor: A"), F.col("source"), F.lit("\nTags: "), F.col("lang"), F.lit(", "), F.col("source"), F.lit("\nSubject: "), F.col("lang"), F.lit("\n\n"), F.col("text"))


def value_sql(keys: str) -> str:
    found = f"regexp_extract_all(h, '(?mi)^[{S.SPACE}]*(?:{keys})[{S.SPACE}]*:[{S.SPACE}]*(.+)$', 1)"
    return f"CASE WHEN len({found}) > 0 THEN {S.strip(f'{found}[-1]')} END"


@query(
    "c10_metadata",
    f"""
    SELECT doc_id, {value_sql('Title|Subject')} AS title, {value_sql('Author|Prepared by')} AS author, {value_sql('Date|Last updated')} AS date_text,
           array_to_string(list_transform(string_split({value_sql('Tags')}, ','), lambda t: {S.strip('t')}), ', ') AS tags, source, 'default' AS tenant_id
    FROM (SELECT doc_id, source, {HEAD_SQL} AS h FROM documents)
    """,
)
def c10(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", head().alias("h"))
    h = F.col("h")
    return rows.select(
        "doc_id",
        T.metadata_value(h, "Title", "Subject").alias("title"),
        T.metadata_value(h, "Author", "Prepared by").alias("author"),
        T.metadata_value(h, "Date", "Last updated").alias("date_text"),
        F.array_join(F.transform(F.split(T.metadata_value(h, "Tags"), ","), T.strip), ", ").alias("tags"),
        "source",
        F.lit("default").alias("tenant_id"),
    )


# S2, S3: allowed formats and parser routing by file name
@query(
    "s3_parser_routing",
    """
    WITH f AS (SELECT doc_id, 'dir/' || CASE WHEN doc_id % 11 = 0 THEN 'Dockerfile' ELSE 'd' || doc_id || ['.md', '.PDF', '.py', '.html', '.xyz', '.json', '.rst', ''][CAST(doc_id % 8 AS INTEGER) + 1] END AS path FROM documents)
    SELECT doc_id, path, lower(regexp_extract(path, '\\.[^./]+$', 0)) IN ('.txt', '.md', '.markdown', '.rst', '.html', '.htm', '.pdf', '.docx', '.pptx') AS allowed,
           CASE WHEN path LIKE '%/Dockerfile' OR path LIKE '%/Makefile' THEN 'code'
                WHEN lower(regexp_extract(path, '\\.[^./]+$', 0)) IN ('.pdf') THEN 'document'
                WHEN lower(regexp_extract(path, '\\.[^./]+$', 0)) IN ('.py', '.json') THEN 'code' ELSE 'text' END AS parser
    FROM f
    """,
)
def s3(spark, sf_dir):
    from ..sources.files import route

    endings = F.array(*[F.lit(x) for x in (".md", ".PDF", ".py", ".html", ".xyz", ".json", ".rst", "")])
    name = F.when(F.col("doc_id") % 11 == 0, "Dockerfile").otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.get(endings, (F.col("doc_id") % 8).cast("int"))))
    return route(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("dir/"), name).alias("path")))


@query("s4_files_read", "SELECT item_id, text || ' é' || chr(10) AS text FROM benchmark WHERE item_id % 5 <> 0")
def s4(spark, sf_dir):
    """Each item as a file, half of them in Latin-1, each fifth in a format that isn't read; then the folder is scanned."""
    from ..sources.checkpoint import folder
    from ..sources.files import scan_directory

    root, said = folder(spark, "files"), F.concat("text", F.lit(" é"))
    coded = F.when(F.col("item_id") % 2 == 0, F.encode(said, "ISO-8859-1")).otherwise(F.encode(said, "UTF-8"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", coded.cast("string").alias("value"))
    rows.filter("item_id % 5 <> 0").write.partitionBy("item_id").text(f"{root}/plain")
    rows.filter("item_id % 5 = 0").write.partitionBy("item_id").option("compression", "gzip").text(f"{root}/packed")
    return scan_directory(spark, root).select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "text")


# S7, S11: structure
NO_BORDER = rf"[^{S.WORD_CHAR}]"


@query(
    "s7_structure",
    f"""
    SELECT doc_id, CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda l: {S.strip('l')}), lambda l: l LIKE '#%' AND ltrim(l, '#') <> '')) AS BIGINT) AS n_headings,
           regexp_matches(text, '!\\[[^\\]]*\\]\\([^)]+\\)') AS has_figures
    FROM documents
    """,
)
def s7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.headings(F.col("text"))).cast("long").alias("n_headings"), F.col("text").rlike(r"!\[[^\]]*\]\([^)]+\)").alias("has_figures"))


FIGURES_SQL = "'See Figure ' || doc_id || ' and fig. ' || (doc_id % 7) || 'b.' || chr(10) || '# Part ' || doc_id || chr(10) || '2.1 Overview of ' || source || chr(10)"


@query(
    "s11_structure_detection",
    f"""
    SELECT doc_id, list_slice(regexp_extract_all(t, '(?i)(?:Figure|Fig\\.)[{S.SPACE}]*\\d+[A-Za-z]?', 0), 1, 32) AS figures,
           list_transform(regexp_extract_all(t, '(?m)^[{S.SPACE}]*(?:#{{1,6}}[{S.SPACE}]+.+|\\d+(?:\\.\\d+)*\\.?[{S.SPACE}]+[A-Z].+)$', 0), lambda h: {S.strip('h')}) AS headings
    FROM (SELECT doc_id, {FIGURES_SQL} AS t FROM documents)
    """,
)
def s11(spark, sf_dir):
    t = F.concat(F.lit("See Figure "), F.col("doc_id").cast("string"), F.lit(" and fig. "), (F.col("doc_id") % 7).cast("string"), F.lit("b.\n# Part "), F.col("doc_id").cast("string"), F.lit("\n2.1 Overview of "), F.col("source"), F.lit("\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", T.figures(F.col("t")).alias("figures"), T.detected_headings(F.col("t")).alias("headings"))


@query(
    "s12_image_references",
    """
    SELECT page_id, unnest(regexp_extract_all(m, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 1)) AS alt, unnest(regexp_extract_all(m, '!\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)) AS src
    FROM (SELECT page_id, '![page ' || page_id || '](' || url || ') text ![](data:image/png;base64,AAAA)' AS m FROM pages)
    """,
)
def s12(spark, sf_dir):
    m = F.concat(F.lit("![page "), F.col("page_id").cast("string"), F.lit("]("), F.col("url"), F.lit(") text ![](data:image/png;base64,AAAA)"))
    return table(spark, sf_dir, "pages").select("page_id", F.inline(T.image_references(m)))


# E1
@query(
    "e1_quality_score",
    "SELECT doc_id, round(least(1.0, 0.4 + CASE WHEN length(text) >= 120 THEN 0.2 ELSE 0.0 END + least(0.2, length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) * 0.01::DOUBLE)), 6)::DOUBLE AS quality FROM documents",
)
def e1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.quality_score(F.col("text")), 6).alias("quality"))


# E2: most frequent keywords. Runs of word characters that aren't all ASCII become one character that is none;
# a keyword's own hyphen before such a run is at a word border and stays
@query(
    "e2_keywords",
    f"""
    WITH t AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[{S.WORD_CHAR}]+|[^{S.WORD_CHAR}]+', 0), lambda r: CASE WHEN NOT regexp_matches(r, '[^\\x00-\\x7f]') THEN r WHEN regexp_matches(r, '^[{S.WORD_CHAR}]') THEN chr(1) ELSE regexp_replace(r, '[^\\x00-\\x7f]', ' ', 'g') END), '') AS t FROM documents),
    w AS (SELECT doc_id, unnest(ks) AS keyword, generate_subscripts(ks, 1) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(t, '\\b[a-z][a-z0-9_-]+-\\x01|\\b[a-z][a-z0-9_-]{{2,}}\\b', 0), lambda k: replace(k, chr(1), '')) AS ks FROM t)),
    c AS (SELECT doc_id, keyword, count(*) AS n, min(i) AS f FROM w GROUP BY 1, 2)
    SELECT doc_id, keyword, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) <= 12
    """,
)
def e2(spark, sf_dir):
    from ..operators.enrich import keywords

    return keywords(table(spark, sf_dir, "documents"), 12)


@query(
    "e3_cross_references",
    f"""
    WITH t AS (SELECT doc_id, 'see DOC-' || doc_id || ', section  ' || (doc_id % 9) || '.2 and RFC ' || (doc_id % 2000) || '; ' || text AS t FROM documents)
    SELECT doc_id, 'document_id' AS ref_type, unnest(regexp_extract_all(t, '(?i)\\bDOC-\\d{{2,}}\\b', 0)) AS value FROM t
    UNION ALL SELECT doc_id, 'section', unnest(regexp_extract_all(t, '(?i)\\bSection[{S.SPACE}]+\\d+(?:\\.\\d+){{0,3}}\\b', 0)) FROM t
    UNION ALL SELECT doc_id, 'standard', unnest(regexp_extract_all(t, '(?i)\\bRFC[{S.SPACE}]+\\d{{3,5}}\\b', 0)) FROM t
    """,
)
def e3(spark, sf_dir):
    from ..operators.enrich import cross_references

    t = F.concat(F.lit("see DOC-"), F.col("doc_id").cast("string"), F.lit(", section  "), (F.col("doc_id") % 9).cast("string"), F.lit(".2 and RFC "), (F.col("doc_id") % 2000).cast("string"), F.lit("; "), F.col("text"))
    return cross_references(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")))


@query("e12_query_hash", "SELECT item_id, substr(sha256(text), 1, 16) AS query_hash FROM benchmark")
def e12(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).substr(1, 16).alias("query_hash"))


@query(
    "e7_summary",
    f"SELECT doc_id, CASE WHEN length(c) <= 240 THEN c ELSE regexp_replace(substr(c, 1, 240), ' [^ ]*$', '') END AS summary FROM (SELECT doc_id, {S.strip(S.collapse('text'))} AS c FROM documents)",
)
def e7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.summary(F.col("text")).alias("summary"))


@query("e18_estimated_tokens", "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens FROM documents")
def e18(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@query(
    "e20_capped_text",
    f"SELECT conv_id, turn, CASE WHEN length(c) > 220 THEN substr(c, 1, 217) || '...' ELSE c END AS capped FROM (SELECT conv_id, turn, {S.strip(S.collapse('text'))} AS c FROM conversations)",
)
def e20(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cap(F.col("text"), 220).alias("capped"))


@query(
    "e21_names",
    """
    SELECT page_id, regexp_replace(url, '[/\\\\:*?"<>|]', '_', 'g') || '.' || substr(sha1(url), 1, 8) AS mirror_stem, replace(regexp_replace(url, '[/:]', '_', 'g'), '..', '__') AS clean_key,
           'pages/' || page_id || '/' || lpad(CAST(page_id % 50 AS VARCHAR), 4, '0') || '.jpg' AS image_key
    FROM pages
    """,
)
def e21(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(T.safe_name(url), F.lit("."), F.sha1(url).substr(1, 8)).alias("mirror_stem"),
        T.safe_key(url).alias("clean_key"),
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit("/"), F.lpad((F.col("page_id") % 50).cast("string"), 4, "0"), F.lit(".jpg")).alias("image_key"),
    )


@query(
    "e13_source_preview",
    """
    SELECT doc_id, a AS window_start, b AS window_end, substr(text, CAST(a AS INTEGER) + 1, CAST(b - a AS INTEGER)) AS preview FROM (
      SELECT doc_id, text, greatest(0, least(length(text), doc_id % 400) - 60) AS a, least(length(text), greatest(0, least(length(text), doc_id % 400) - 60) + 200) AS b FROM documents)
    """,
)
def e13(spark, sf_dir):
    n = F.length("text").cast("long")
    start = F.greatest(F.lit(0), F.least(n, F.col("doc_id") % 400) - 60)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", start.alias("window_start"), F.least(n, start + 200).alias("window_end"))
    return rows.select("doc_id", "window_start", "window_end", F.col("text").substr(F.col("window_start").cast("int") + 1, (F.col("window_end") - F.col("window_start")).cast("int")).alias("preview"))


@query(
    "e14_highlight",
    """
    WITH e AS (SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS p FROM documents)
    SELECT doc_id, replace(p, 'the', '<mark>the</mark>') AS marked FROM e
    """,
)
def e14(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.highlight(F.col("text"), F.lit("the")).alias("marked"))


@query(
    "e19_token_budget",
    """
    SELECT conv_id, CAST(tokens AS BIGINT) AS tokens, round(least(100.0, greatest(0.0, tokens * 100.0 / (4096 - 512))), 1)::DOUBLE AS usage_percent FROM (
      SELECT conv_id, sum(CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END) AS tokens FROM conversations GROUP BY conv_id)
    """,
)
def e19(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))
    usage = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("tokens") * 100.0 / (4096 - 512)))
    return rows.select("conv_id", "tokens", F.round(usage, 1).alias("usage_percent"))


@query(
    "e6_chunk_enrichment",
    f"SELECT doc_id, {S.uuid5('text_key')} AS chunk_id, {S.uuid5('doc_key')} AS document_id, 'original' AS origin, 'local://' || source || '#' || doc_id AS citation FROM (SELECT *, source || ':' || doc_id || ':' || sha256(text) AS text_key, 'doc:' || source AS doc_key FROM documents)",
)
def e6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        T.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"),
        T.uuid5(F.concat(F.lit("doc:"), F.col("source"))).alias("document_id"),
        F.lit("original").alias("origin"),
        F.concat(F.lit("local://"), F.col("source"), F.lit("#"), F.col("doc_id").cast("string")).alias("citation"),
    )


K5_SQL = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[{S.SPACE}]+', '\\1' || chr(1), 'g'), '\\n\\n+', chr(1), 'g'), chr(1)), lambda s: {S.strip('s')}), lambda s: s <> '')"


@query("k5_sentences", f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, sha256(array_to_string(s, chr(10) || chr(9))) AS sentences_sha256 FROM (SELECT doc_id, {K5_SQL} AS s FROM documents)")
def k5(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha2(F.array_join("s", "\n\t"), 256).alias("sentences_sha256"))
