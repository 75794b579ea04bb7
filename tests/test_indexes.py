"""Stored indexes of vectors and texts against exact searches, through changes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.operators import search as R
from corvane.operators import text_index as T
from corvane.operators import vector_index as V
from corvane.sources.checkpoint import folder


def best(found):
    return sorted((r.query_id, r["rank"], r.id, r.dense) for r in found.collect())


def exact(rows, asked, k=10):
    return R.top(R.dense(rows, asked, k=k), "dense", k).select("query_id", "id", "dense", "rank")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 3000)] + rng.normal(scale=0.4, size=(3000, 16))
    rows = [(i, p.astype(float).tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame([*rows, (3000, None), (3001, [0.0] * 16), (3002, rows[0][1])], "vec_id long, embedding array<double>")


def test_all_lists_and_rows_are_exact(spark, vectors):
    asked = vectors.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = V.VectorIndex.build(vectors, folder(spark, "index"), lists=30, parts=5, sample=900)
    assert best(index.search(asked, probes=None, candidates=None)) == best(exact(vectors, asked))
    again = V.VectorIndex(spark, index.segments.root)  # from its files alone
    assert best(again.search(asked, k=3, probes=None, candidates=None)) == best(exact(vectors, asked, 3))


def test_recall_of_probed_lists(spark, vectors, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 25)
    asked = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = V.VectorIndex.build(vectors, folder(spark, "index"), lists=40, parts=8, sample=1500)
    probes = index.probes_for(asked, 0.97)
    assert probes < 30
    found = index.search(asked, probes=probes, candidates=60)
    assert V.recall(found, exact(vectors, asked)) >= 0.9
    scores = {(r.query_id, r.id): r.dense for r in R.dense(vectors, asked).collect()}
    assert all(abs(scores[q, i] - d) < 2e-6 for q, _, i, d in best(found))


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index = V.VectorIndex.build(rows, folder(spark, "index"), lists=64, sample=1000)
    assert V.recall(index.search(asked, probes=index.probes_for(asked, 0.97), candidates=200), exact(rows, asked)) >= 0.9


def test_changes_of_an_index(spark, vectors):
    asked = vectors.filter("vec_id % 100 = 7").withColumnRenamed("vec_id", "query_id")
    index = V.VectorIndex.build(vectors.filter("vec_id < 2000"), folder(spark, "index"), lists=20, parts=4)
    index.remove(vectors.filter("vec_id % 5 = 0").select("vec_id"))
    index.add(vectors.filter("vec_id % 10 = 0 and vec_id < 1000"))  # after they were removed
    index.add(vectors.filter("vec_id >= 2000"))
    now = vectors.filter("vec_id >= 2000 or vec_id % 5 <> 0 or (vec_id % 10 = 0 and vec_id < 1000)")
    assert best(index.search(asked, probes=None, candidates=None)) == best(exact(now, asked))
    assert V.recall(index.search(asked, probes=20, candidates=100), exact(now, asked)) > 0.95


def test_hot_list_and_nothing(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [random.Random(i).random(), 1.0]) for i in range(900)], "vec_id long, embedding array<double>")
    index = V.VectorIndex.build(rows, folder(spark, "index"), lists=8, parts=2)
    asked = rows.filter("vec_id in (1, 3)").withColumnRenamed("vec_id", "query_id")
    assert best(index.search(asked, probes=3, candidates=50))[:2] == best(exact(rows, asked))[:2]
    assert index.search(asked.filter("false")).count() == 0
    with pytest.raises(ValueError):
        V.VectorIndex.build(rows.filter("false"), folder(spark, "index"))
    assert rows.select(F.max("vec_id")).first()[0] == 899


def test_ids_of_two_segments_are_scored_once_each(spark, vectors):
    """Exact searches take each stored row against the block where it is: no pair of query and id is joined with the rows of that id."""
    asked = vectors.filter("vec_id in (50, 100)").withColumnRenamed("vec_id", "query_id")
    index = V.VectorIndex.build(vectors, folder(spark, "index"), lists=10, parts=4, sample=500)
    index.add(vectors.filter("vec_id = 50"))  # stands beside the first
    twice = vectors.unionByName(vectors.filter("vec_id = 50"))
    assert best(index.search(asked, probes=None, candidates=None)) == best(exact(twice, asked))
    some = best(index.search(asked, k=5, probes=2, candidates=None))  # the rows of two lists alone
    scores = {(q, i): d for q, _, i, d in best(exact(twice, asked, 4000))}
    assert len(some) == 10 and all(scores[q, i] == d for q, _, i, d in some)


def test_pairs_hold_what_can_be_among_the_best():
    rng = np.random.default_rng(5)
    scores, held = np.round(rng.normal(size=(6, 4000)), 2), V._Pairs(7, 8)
    held.room = 100
    for i in range(0, 4000, 50):
        held.put(np.array([0, 1, 2, 4, 5, 7]), pa.array(np.arange(i, i + 50)), scores[:, i : i + 50])
        assert sum(map(len, held.held)) <= 100 + 6 * 50
    (table,) = held.rest()
    want = [(q, i) for row, q in enumerate((0, 1, 2, 4, 5, 7)) for i in sorted(range(4000), key=lambda i: (-scores[row, i], i))[:7]]
    assert list(zip(table.column("q").to_pylist(), table.column("id").to_pylist(), strict=True)) == want
    assert (held.floor[[3, 6]] == -np.inf).all() and (held.floor[[0, 1]] > 1).all()


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_late_interaction_by_parts(spark, monkeypatch, most):
    """Rows of one and of several patches, and rows of more patches than are multiplied at a time."""
    monkeypatch.setattr(R, "PRODUCTS", most)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=(int(n), 3)).tolist()) for i, n in enumerate([*rng.integers(1, 5, 30), *[4] * 20, 90])]
    frame = spark.createDataFrame(rows, "vec_id long, patches array<array<double>>")
    found = R.late_interaction_search(frame, frame.filter("vec_id % 7 = 0").withColumnRenamed("vec_id", "query_id"))
    got = {(r.query_id, r.id): r.maxsim for r in found.collect()}
    want = {(q, i): (np.array(a) @ np.array(b).T).max(axis=1).sum() for q, a in rows if q % 7 == 0 for i, b in rows}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)


def test_mean_of_patches_rounds_as_its_sql(spark, tmp_path):
    """Means that round to zero from below, and means next to a half of the last digit."""
    import duckdb

    import __spark_entry__ as entry

    rng = np.random.default_rng(7)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([rng.normal(scale=1e-7, size=(50, 64)), rng.integers(-4000, 4000, (400, 64)) / 1000]))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {v: list(map(str, p)) for v, p in connection.sql(entry.oracle_sql()["v14_mean_of_patches"]).fetchall()}
    got = {r.vec_id: list(map(str, r.pooled)) for r in entry.queries()["v14_mean_of_patches"](spark, str(tmp_path)).collect()}
    assert got == want and any("-0.0" in p for p in want.values())


# ---------------------------------------------------------------- texts


WORDS = [f"w{i}" for i in range(400)]


def texts(n, seed=1, first=0):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [(first + i, " ".join(["common", *rng.choices(WORDS, weights, k=rng.randint(0, 60))])) for i in range(n)]


def hits(found):
    return sorted((r.query_id, r["rank"], r.id, r.bm25) for r in found.collect())


def plain(docs, queries, k=10):
    return hits(R.top(R.bm25(docs, queries, k=k), "bm25", k))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [*texts(1500), (5000, None), (5001, ""), (5002, "common"), (5003, "common"), (5004, "w1 " * 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))) for i in range(30)]
    return spark.createDataFrame([*rows, (100, None), (101, "unknown words"), (102, "common"), (103, "common w399 w399"), (104, "")], "item_id long, text string")


@pytest.mark.parametrize(("k", "size"), [(10, 16), (3, 64), (500, 7)])
def test_index_gives_the_hits_of_a_scan(spark, corpus, questions, k, size):
    index = T.TextIndex(spark, folder(spark, "text"))
    index.add(corpus, size=size)
    assert hits(index.search(questions, k=k)) == plain(corpus, questions, k)


def test_index_skips_blocks_and_reads_no_texts(spark, corpus, questions, tmp_path):
    path = str(tmp_path / "docs")
    corpus.write.parquet(path)
    index = T.TextIndex(spark, folder(spark, "text"))
    index.add(spark.read.parquet(path), size=8)
    share = index.read_share(questions, k=5).first()
    assert 0 < share.blocks_read < 0.6 * share.blocks
    assert not any(f.startswith(f"file:{path}") for f in index.search(questions, k=5).inputFiles())


def test_index_through_changes(spark, corpus, questions, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BLOCK", 9)
    monkeypatch.setattr(T, "NAMED_TERMS", 5)
    index = T.TextIndex(spark, folder(spark, "text"))
    assert index.search(questions).count() == 0
    fresh = spark.createDataFrame(texts(200, 9, first=1000), "doc_id long, text string")  # other texts of ids that are there
    index.add(corpus, size=20)
    index.remove(fresh)
    index.add(fresh, size=20)
    index.remove(corpus.filter("doc_id % 7 = 0"))
    now = corpus.filter("doc_id < 1000 or doc_id >= 1200").unionByName(fresh).filter("doc_id % 7 <> 0")
    want = plain(now, questions)
    assert hits(index.search(questions)) == want
    index.compact(size=30)
    assert [len(index.segments.names(kind)) for kind in ("blocks", "lengths", "removed")] == [1, 1, 0]
    assert hits(T.TextIndex(spark, index.segments.root).search(questions)) == want


def test_blocks_without_their_lengths_do_not_count(spark, corpus, questions):
    index = T.TextIndex(spark, folder(spark, "text"))
    index.add(corpus.filter("doc_id < 300"))
    index.segments.write(index._stored().drop("begun"), "blocks")  # a writer that was cut off
    assert hits(index.search(questions)) == plain(corpus.filter("doc_id < 300"), questions)


def test_first_groups_meet_the_blocks_where_they_are(spark, tmp_path, monkeypatch):
    """k groups a query at most are sent to the blocks; these aren't dealt out for them."""
    from corvane.operators.text_index import TextIndex

    plans, scores = [], TextIndex._scores

    def noted(self, *args, **named):
        made = scores(self, *args, **named)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(TextIndex, "_scores", noted)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        index = TextIndex(spark, f"{tmp_path}/index")
        index.add(spark.createDataFrame([(i, f"word{i % 7} other{i % 5} all") for i in range(60)], "doc_id long, text string"), size=8)
        found = index.search(spark.createDataFrame([(1, "word3 other2")], "item_id long, text string"), k=2).collect()
    finally:
        spark.conf.set(setting, before)
    assert [r.id for r in sorted(found, key=lambda r: r.rank)] == [17, 52]
    joins = [[line for line in p.splitlines() if "Join [grp" in line] for p in plans]
    assert "BroadcastHashJoin" in joins[0][0] and "SortMergeJoin" in joins[1][0]
