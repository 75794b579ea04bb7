"""Reading and routing of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The formats that are read, and the parser for a file name or an ending.
ALLOWED = [".txt", ".md", ".markdown", ".rst", ".html", ".htm", ".pdf", ".docx", ".pptx"]
PARSERS = {
    "document": [".pdf", ".docx", ".pptx", ".xlsx", ".png", ".jpg", ".jpeg", ".tiff", ".bmp"],
    "code": [
        ".py", ".rs", ".go", ".ts", ".tsx", ".js", ".jsx", ".java", ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".cs", ".rb", ".kt", ".swift", ".scala",
        ".sh", ".bash", ".zsh", ".yaml", ".yml", ".toml", ".json", "Dockerfile", "Makefile",
    ],
    "text": [".md", ".txt", ".rst", ".html", ".htm"],
}


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def route(files: DataFrame, path: str = "path") -> DataFrame:
    """Whether a file's format is allowed, and its parser: by name first, then by ending, else text."""
    name = F.regexp_extract(F.col(path), r"[^/]*$", 0)
    by = {k: parser for parser, keys in PARSERS.items() for k in keys}
    parser = F.lit(None).cast("string")
    for kind in PARSERS:
        parser = F.coalesce(parser, F.when(name.isin([k for k in by if by[k] == kind and k[0] != "."]), kind))
    for kind in PARSERS:
        parser = F.coalesce(parser, F.when(ending(F.col(path)).isin([k for k in by if by[k] == kind and k[0] == "."]), kind))
    return files.withColumns({"allowed": ending(F.col(path)).isin(ALLOWED), "parser": F.coalesce(parser, F.lit("text"))})


def scan_directory(spark: SparkSession, root: str, allowed: list[str] = ALLOWED) -> DataFrame:
    """path, source_key, version (modification time in ns), content and text of each allowed file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.filter(ending(F.col("path")).isin(allowed)).dropDuplicates(["path"])
    return files.select(
        "path", F.concat_ws(":", F.lit("local_fs"), F.sha1("path")).alias("source_key"), (F.unix_micros("modificationTime") * 1000).alias("version"), "content", decode(F.col("content")).alias("text")
    )


def decode(content: Column) -> Column:
    """UTF-8 where it is that, else Latin-1, which never fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def log_tail(spark: SparkSession, paths: list[str], last: int = 200) -> DataFrame:
    """The last lines of up to three files, numbered from each file's end."""
    rows = spark.read.text(paths[:3], wholetext=True).select(F.input_file_name().alias("path"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("lines"))
    return rows.select("path", F.posexplode(F.slice("lines", F.greatest(F.lit(1), F.size("lines") - last + 1), last)).alias("place", "line"))
