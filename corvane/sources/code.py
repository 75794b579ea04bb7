"""Structure of source code: Python by its syntax tree, shell and SystemVerilog by patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices

#: Kind and pattern of what a shell script defines or reads.
SHELL = [
    ("function", r"(?m)^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)\s*\{"),
    ("source", r"(?m)^\s*(?:source|\.)\s+[\"']?([^\s\"'$;]+)[\"']?"),
    ("export", r"(?m)^\s*export\s+([A-Za-z_]\w*)"),
    ("readonly", r"(?m)^\s*readonly\s+([A-Za-z_]\w*)"),
]
VERILOG = [
    ("module", r"(?m)^\s*module\s+(\w+)"),
    ("interface", r"(?m)^\s*interface\s+(\w+)"),
    ("package", r"(?m)^\s*package\s+(\w+)"),
    ("parameter", r"(?m)\bparameter\s+(?:\w+\s+)?(\w+)\s*="),
    ("port", r"(?m)\b(?:input|output|inout)\s+(?:wire|reg|logic)?\s*(?:\[[^\]]*\]\s*)?(\w+)"),
    ("import", r"(?m)^\s*import\s+(\w+)::"),
    ("instance", r"(?m)^\s*(?!module|interface|package|parameter|import|input|output|assign|return|else)(\w+)\s+(?:#\s*\([^;]*?\)\s*)?\w+\s*\("),
]


def by_patterns(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """An array of (kind, name)."""
    parts = []
    for kind, pattern in patterns:
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        parts.append(F.arrays_zip(F.array_repeat(F.lit(kind), F.size(names)).alias("kind"), names.alias("name")))
    return F.concat(*parts)


def python_structure(text: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[str, str, str]]]:
    """Definitions (kind, name, first and last line) and relations (subject, relation, object) of a Python file."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    found, relations = [], []
    for node in tree.body:
        if isinstance(node, ast.Import):
            relations += [("module", "depends_on", a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            relations.append(("module", "depends_on", "." * node.level + (node.module or "")))
        elif isinstance(node, ast.Assign):
            found += [("constant", t.id, node.lineno, node.end_lineno) for t in node.targets if isinstance(t, ast.Name) and t.id.isupper()]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append(("function", node.name, node.lineno, node.end_lineno))
            relations += _inside(ast, node, node.name)
        elif isinstance(node, ast.ClassDef):
            found.append(("class", node.name, node.lineno, node.end_lineno))
            relations += [(node.name, "extends", ast.unparse(b)) for b in node.bases]
            for item in node.body:
                if isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    name = f"{node.name}.{item.name}"
                    found.append(("method", name, item.lineno, item.end_lineno))
                    relations.append((node.name, "contains", name))
                    relations += _inside(ast, item, name)
    relations += [("module", "contains", name) for kind, name, *_ in found if kind != "method"]
    return found, relations


def _inside(ast, node, name: str) -> list[tuple[str, str, str]]:
    calls = sorted({ast.unparse(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)})
    return [(name, "calls", c) for c in calls] + [(name, "decorated_by", ast.unparse(d)) for d in node.decorator_list]


def parses(text: Column) -> Column:
    """Whether a text is a Python program."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ast

        def good(text) -> bool:
            try:
                ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
            return True

        for texts in parts:
            yield texts.map(good).astype(bool)

    return run(text)


def python_chunks(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section_path, heading_level, chunk): a chunk per top-level function or class and one for the rest."""

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = (t or "").split("\n")
                rest = list(lines)
                for kind, name, first, last in python_structure(t or "")[0]:
                    if kind in ("function", "class"):
                        out.append((k, f"{k} > {name}", 2, "\n".join(lines[first - 1 : last])))
                        rest[first - 1 : last] = [None] * (last - first + 1)
                if module := "\n".join(x for x in rest if x is not None).strip():
                    out.append((k, str(k), 1, module))
            kinds = (batch.column("key").type, pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], [key, "section_path", "heading_level", "chunk"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, f"{key} {kind}, section_path string, heading_level long, chunk string")


def python_relations(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, subject, relation, object)."""

    def read(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            out = [(k, *r) for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True) for r in python_structure(t or "")[1]]
            kinds = (batch.column("key").type, pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], [key, "subject", "relation", "object"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(read, f"{key} {kind}, subject string, relation string, object string")
