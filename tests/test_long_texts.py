"""Cleaning of texts of any number of lines, by patterns that must match what the written ones match."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corvane import plans, registry
from corvane.functions import text as T

plans.register()

ATOMS = [
    "\n", "\n", "\n", " ", "\t", "===", "====", "=", "---", "-- ", "--", "[TOC]", "1. a", "2.", "x", "Subject: a", "From: b", "Date: c", "Hi everyone", "Best,", "Thanks", "DRAFT", "[1] z",
    "Following up on", "write-up", "knowledge base", "session", "Friday", "meeting", "Monday", "Last updated: ", "Prepared by : x", "See also: https://a.b", "Senior dev", "word", "\r", " ", " \n", "\n\n\n",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_steady_patterns_match_the_written_ones(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(ATOMS, k=rng.randint(0, 40))) for _ in range(8000)]
    written = F.col("t")
    for pattern, flags in T.BOILERPLATE:
        written = F.regexp_replace(written, f"(?dmU{flags}){pattern}", "")
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").repartition(4)
    out = df.select("t", written.alias("a"), T.strip_boilerplate(F.col("t")).alias("b"))
    assert out.filter(~F.col("a").eqNullSafe(F.col("b"))).limit(3).collect() == []
    assert out.filter("a <> t").count() > 4000


def test_headings_of_words_match_the_written_pattern(spark):
    rng = random.Random(3)
    texts = [rng.choice(["1 ", "1.2. ", "3\t", " 4 "]) + "".join(rng.choices(["1", ".2", ".", " ", "\t", "A", "b", "&", "-", "\r", " ", "(", "Abc", "  "], k=rng.randint(0, 9))) for _ in range(20_000)]
    written = r"(?U)^\s*(\d+(?:\.\d+)*)\.?\s+([A-Z][A-Za-z &/()\-]+(?:\s+[A-Za-z][A-Za-z &/()\-]*)*)$"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    heading = T.markdown_headings(F.col("t")).rlike("(?s)^#")
    assert df.filter(heading != F.col("t").rlike(written)).limit(3).collect() == []


N = 1_000_000
LONG = {
    "banner that isn't closed": ("====\n" + "short line\n" * N, 11 * N + 1),
    "banner": ("====\n" + "short line\n" * N + "====\nend of it", 10),
    "contents": ("[TOC]\n" + "1. a line\n" * N + "end", 3),
    "empty lines": ("a\n" + "\n" * N + "b", N + 3),
    "mail headers without an end": ("From: x\nfoo\n" * (N // 4), 3 * N),
    "a word again and again": ("session " * N, 8 * N),
    "numbers": ("1" + ".1" * N + " Abc", 2 * N + 5),
    "a heading of many words": ("1 A" + " b" * N + " 9", 2 * N + 5),
}


@pytest.mark.parametrize("name", LONG)
def test_a_million_lines(spark, name):
    text, left = LONG[name]
    began = time.perf_counter()
    df = spark.createDataFrame([(text,)], "t string")
    stripped, cleaned = df.select(F.length(T.strip_boilerplate(F.col("t"))), F.length(T.clean_document(F.col("t")))).first()
    assert stripped == left and cleaned <= left
    assert time.perf_counter() - began < 120


def test_registered_query_on_long_blocks(spark, tmp_path):
    texts = [LONG["banner that isn't closed"][0], LONG["contents"][0], None, ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_chars_out for r in registry.QUERIES["c1_strip_boilerplate"](spark, str(tmp_path)).collect()}
    assert got == {0: 11 * N + 1, 1: 3, 2: None, 3: 0}


def test_a_document_is_cleaned_once(spark, sf_dir):
    """No stage is written out again for each place that reads its result."""
    plan = registry.QUERIES["clean_document"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("This email and any attachments") == 1


@pytest.mark.parametrize("name", ["e4_provenance", "k10_whole_document"])
def test_what_chunks_a_document_cleans_it_once(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("This email and any attachments") <= 1


def test_texts_without_what_a_pattern_needs_pass_it_by(spark):
    flags = dict(T.BOILERPLATE)
    assert all("i" not in flags[p] for p in T.NEEDED) and all("i" in flags[p] for p in T.NEEDED_MATCH)
    held = [
        "===\na\n===", "Page 3 of 4", "Hi everyone,", "Best,", "Regards", "Cheers,", "Thanks", "a\n--\nme", "[TOC]\n1. a\n2. b\n", "[12] see", "See also: http://x.y", "Internal wiki https://x.y", "-=-", "=-=", "---", "===",
        "we are Following up on your write-up", "so Let me know if you have questions, ok", " Staff engineer", "Principal x", "Senior y", "Lead z", "a dRaFt b", "do not diſtribute", "tech talk on FRIDAY", "Meeting next weeK", "session", "Friday",
    ]
    rows = [(f"above\n{h}\nbelow",) for h in held] + [(h,) for h in held] + [(h.swapcase(),) for h in held] + [(None,), ("",)]
    plain = F.col("t")
    for pattern, more in T.BOILERPLATE:
        plain = F.regexp_replace(plain, f"(?dmU{more}){pattern}", "")
    stripped = spark.createDataFrame(rows, "t string").select("t", plain.alias("a"), T.strip_boilerplate(F.col("t")).alias("b"))
    got = stripped.collect()
    assert [r.b for r in got] == [r.a for r in got] and sum(r.t != r.b for r in got) > 40
    assert stripped.select("b")._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") > len(T.NEEDED)
