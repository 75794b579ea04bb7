"""Table functions for SQL: chunks of a text by LATERAL, and of documents that come as lines by PARTITION BY.

    register(spark)
    SELECT doc_id, c.* FROM documents, LATERAL parse_chunks(text, 'markdown', 512, 50) c
    SELECT * FROM parse_lines(TABLE(SELECT doc_id, i, line FROM lines) PARTITION BY doc_id ORDER BY i)

analyze() decides the columns from the kind of text: sections of Markdown have their path and heading, chunks of Python code
the name of their function or class, which is empty for the rest of the module. A null text has no chunks. Spark deals the rows; a function sees one text, or one document's lines, at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import LongType, StringType, StructType

#: White space, as Unicode has it.
BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"
HEADING = re.compile("^(#{1,4})[ \t\n\x0b\f\r]+([^\n\r\x85  ]*[^ \t\n\x0b\f\r])[ \t\n\x0b\f\r]*$")

BASE = StructType().add("chunk_index", LongType()).add("total_chunks", LongType()).add("chunk", StringType())
COLUMNS = {
    "text": BASE,
    "markdown": StructType(BASE.fields[:]).add("section_path", StringType()).add("heading", StringType()).add("heading_level", LongType()),
    "python": StructType(BASE.fields[:]).add("name", StringType()).add("heading_level", LongType()),
}


def sections(text: str) -> list[tuple[list[str], str]]:
    """The path of headings and the content of each section that isn't blank, cut at headings of level 1 to 4."""
    out, path, lines = [], {}, []

    def close():
        content = "\n".join(lines).strip(BLANK)
        if content:
            out.append(([path[n] for n in sorted(path)], content))
        lines.clear()

    for line in text.split("\n"):
        found = HEADING.match(line)
        if found:
            close()
            path = {n: t for n, t in path.items() if n < len(found[1])} | {len(found[1]): found[2]}
        lines.append(line)
    close()
    return out


def chunks_of(text: str, kind: str, size: int, overlap: int) -> list[tuple]:
    """The chunks of a text with their further columns, without numbers."""
    from ..operators.chunking import split_text
    from ..sources.code import python_structure

    if kind == "markdown":
        return [(c, " > ".join(path), path[-1] if path else "", len(path)) for path, content in sections(text) for c in ([content] if len(content) <= size else split_text(content, size, overlap))]
    if kind == "python":
        lines = text.split("\n")
        tops = [(name, first, last) for kind_, name, first, last in python_structure(text)[0] if kind_ in ("function", "class")]
        inside = {i for _, first, last in tops for i in range(first - 1, last)}
        rest = "\n".join(x for i, x in enumerate(lines) if i not in inside).strip()
        return [("\n".join(lines[first - 1 : last]), name, 2) for name, first, last in tops] + [(rest, "", 1)] * bool(rest)
    return [(c,) for c in split_text(text, size, overlap)]


def _kind(argument: AnalyzeArgument | None) -> str:
    kind = argument.value if argument is not None else "markdown"
    if kind not in COLUMNS:
        raise ValueError(f"the kind of text must be one of {', '.join(COLUMNS)}, as a constant")
    return kind


class ParseChunks:
    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument | None = None, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("parse_chunks takes a string")
        return AnalyzeResult(schema=COLUMNS[_kind(kind)])

    def eval(self, text, kind="markdown", size=512, overlap=50):
        made = chunks_of(text, kind, size, overlap) if text is not None else []
        for i, (chunk, *rest) in enumerate(made):
            yield (i, len(made), chunk, *rest)


class ParseLines:
    """Chunks of Markdown documents that come as rows of lines: PARTITION BY the document, ORDER BY the line's number."""

    def __init__(self):
        self.key, self.lines = None, []

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or len(table.dataType.fields) < 2:
            raise ValueError("parse_lines takes a table whose first column is the document and whose last is the line")
        first = table.dataType.fields[0]
        return AnalyzeResult(schema=StructType(StructType().add(first.name, first.dataType).fields + COLUMNS["markdown"].fields))

    def eval(self, row):
        self.key = row[0]
        self.lines.append(row[len(row) - 1] or "")

    def terminate(self):
        made = chunks_of("\n".join(self.lines), "markdown", 512, 50)
        for i, (chunk, *rest) in enumerate(made):
            yield (self.key, i, len(made), chunk, *rest)


def register(spark: SparkSession) -> None:
    """Make parse_chunks and parse_lines known to the session's SQL."""
    spark.udtf.register("parse_chunks", udtf(ParseChunks))
    spark.udtf.register("parse_lines", udtf(ParseLines))
