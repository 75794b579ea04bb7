"""Queries that SQL can't express, and operators at their edges, against plain Python on whole tables."""

import ast
import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from corvane import registry
from corvane.functions import guard, models
from corvane.operators import chunking, dedup, graph, isolation, metrics, search
from corvane.plans.chunks import sources
from corvane.sources import code, store
from corvane.sources.checkpoint import folder
from corvane.streaming import events


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in registry.table(spark, sf_dir, "documents").collect()}


# ---------------------------------------------------------------- search


def bm25(docs, queries, k):
    tokens = lambda t: [w for w in re.split(search.NOT_TOKEN, (t or "").lower()) if w]
    split = {d: tokens(t) for d, t in docs}
    mean = sum(map(len, split.values())) / len(split)
    out = []
    for q, text in queries:
        scored = []
        for d, words in split.items():
            total, hit = 0.0, False
            for term in set(tokens(text)):
                tf, df = words.count(term), sum(term in w for w in split.values())
                if tf:
                    hit = True
                    total += np.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
            if hit:
                scored.append((q, d, round(total, 6)))
        out += sorted(scored, key=lambda s: (-s[2], s[1]))[:k]
    return out


def test_bm25_and_dense_equal_brute_force(spark, monkeypatch):
    """Many ties and copies, several blocks of queries, rows without text or tokens, ids that aren't numbers."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    random.seed(1)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"d{i:03}", " ".join(random.choices(words, k=random.randint(1, 9)))) for i in range(150)] + [("x", None), ("y", " ,; "), *((f"e{i:03}", "w1 W2 w1") for i in range(60))]
    queries = [(i, " ".join(random.choices([*words, "none"], k=3))) for i in range(8)] + [(90, None), (91, "absent")]
    d, q = spark.createDataFrame(docs, "doc_id string, text string").repartition(5), spark.createDataFrame(queries, "item_id long, text string")
    want = bm25(docs, queries, 7)
    got = search.top(search.bm25(d, q, k=7), "bm25", 7)
    assert sorted((r.query_id, r.id, r.bm25) for r in got.collect()) == sorted(want)
    assert sorted(map(tuple, search.bm25(d, q).select("query_id", "id", "bm25").collect())) == sorted(bm25(docs, queries, 10**6))
    assert search.bm25(d.filter("false"), q, k=3).count() == search.bm25(d, q.filter("false"), k=3).count() == 0

    vectors = [(i, [float(random.randint(-2, 2)) for _ in range(4)]) for i in range(120)] + [(500, [0.0] * 4), (501, None)]
    v = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    asked = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")

    def cosine(a, b):
        return float(np.dot(a, b) / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)))

    want = []
    for i, a in vectors:
        if i % 20 == 0 and a:
            want += sorted(((i, j, round(cosine(a, b), 6) + 0.0) for j, b in vectors if b), key=lambda s: (-s[2], s[1]))[:5]
    got = search.top(search.dense(v, asked, k=5), "dense", 5)
    assert sorted((r.query_id, r.id, r.dense) for r in got.collect()) == sorted(want)
    assert search.dense(v, asked.filter("false"), k=5).count() == 0


def test_hybrid_alpha_at_its_ends(spark, sf_dir):
    docs, items, vectors = (registry.table(spark, sf_dir, n) for n in ("documents", "benchmark", "embeddings"))
    asked = vectors.withColumnRenamed("vec_id", "query_id").filter("query_id < 40")
    order = lambda df, score: [(r.query_id, r.id) for r in search.top(df, score, 5).orderBy("query_id", "rank").collect()]
    hybrid = lambda alpha: [(r.query_id, r.id) for r in search.hybrid_search(docs, vectors, items, asked, alpha, 5).orderBy("query_id", "rank").collect()]
    assert hybrid(0.0) == order(search.bm25(docs, items, k=5), "bm25")
    assert hybrid(1.0) == order(search.dense(vectors, asked, k=5), "dense")


def test_late_interaction_of_ragged_patches(spark):
    data = [(1, [[1.0, 0.0], [0.0, 1.0]]), (2, [[0.5, 0.5]]), (3, []), (4, None), (5, [[-1.0, 0.0], [2.0, 0.0], [0.0, 3.0]])]
    df = spark.createDataFrame(data, "vec_id long, patches array<array<double>>")
    got = {(r.query_id, r.id): r.maxsim for r in search.late_interaction_search(df, df.withColumnRenamed("vec_id", "query_id")).collect()}
    some = [(i, p) for i, p in data if p]
    assert got == {(i, j): sum(max(float(np.dot(x, y)) for y in b) for x in a) for i, a in some for j, b in some}


# ---------------------------------------------------------------- percentiles, isolation, store, streams


def test_nearest_rank_equals_sorting(spark, monkeypatch):
    monkeypatch.setattr(metrics, "ACCURACY", 50)
    random.seed(2)
    data = [("a", random.random()) for _ in range(700)] + [("b", float(random.randint(0, 2))) for _ in range(400)] + [("c", None), ("d", 1.5), (None, 2.0)] + [("e", v) for v in [None] * 3 + [1.0, 2.0, 3.0, 4.0]]
    got = {r[0]: tuple(r)[1:] for r in metrics.nearest_rank(spark.createDataFrame(data, "g string, v double"), "g", "v", [0, 50, 95, 100]).collect()}
    for g in {g for g, _ in data}:
        values = sorted(v for h, v in data if h == g and v is not None)
        assert got[g] == tuple(values[round(p / 100 * (len(values) - 1))] if values else None for p in (0, 50, 95, 100)), g


def test_isolated_rows(spark):
    df = spark.createDataFrame([(1, "[1, 2]"), (2, "[oops"), (3, "[]"), (4, None)], "id long, text string")
    good, bad = isolation.isolated(df, "id", lambda r: [(x,) for x in json.loads(r["text"])], "n long", "parse")
    assert sorted(rows(good)) == [(1, 1), (1, 2)]
    assert sorted((r.id, r.stage, r.error) for r in bad.collect()) == [(2, "parse", "JSONDecodeError"), (4, "parse", "TypeError")]


def test_store_shows_committed_batches_alone(spark):
    s = store.Store(spark, folder(spark, "store"))
    assert s.objects().count() == 0
    put = lambda *kv: spark.createDataFrame([(k, v, {"n": v}) for k, v in kv], "key string, content string, metadata map<string,string>")
    s.put(put(("a/b:c", "1"), ("..", "2")))
    s.put(put(("a/b:c", "3")))
    assert {(r.key, r.safe_key, r.content, r.metadata["n"]) for r in s.objects().collect()} == {("a/b:c", "a_b_c", "3", "3"), ("..", "__", "2", "2")}
    s.write(s.objects().withColumn("deleted", F.lit(True)))  # no marker
    assert s.objects().count() == 2
    s.delete(spark.createDataFrame([("..",), ("never",)], "key string"))
    assert {tuple(r) for r in s.exists(spark.createDataFrame([("..",), ("a/b:c",)], "key string")).collect()} == {("..", False), ("a/b:c", True)}


def test_ingest_takes_the_newest_of_a_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), folder(spark, "t")
    schema = "id long, text string, at long"
    progress = folder(spark, "p")
    for batch in ([(1, "a", 1), (1, "b", 2), (2, "x", 1)], [(2, "x", 1), (3, "new", 5)], [(1, "c", 9)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        events.ingest(spark.readStream.schema(schema).parquet(source), target, "id", progress, ["at"])
    got = events.ingested(spark, target, "id", schema + ", content_hash string, version long")
    assert sorted((r.id, r.text, r.version) for r in got.collect()) == [(1, "c", 2), (2, "x", 0), (3, "new", 1)]


# ---------------------------------------------------------------- merges, communities, duplicates


def test_merges_follow_their_winners(spark):
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "loser string, winner string")
    assert sorted(rows(graph.final_winners(merges))) == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")]


def test_similar_names_and_greedy_merges(spark, monkeypatch):
    monkeypatch.setattr(graph, "SIMILAR_BLOCK", 7)
    random.seed(3)
    data = [(f"n{i}", "t" if i % 3 else "u", i, [random.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [("zero", "t", 99, [0.0] * 3)]
    counts = {n: random.randint(1, 4) for n, *_ in data}
    pairs = {}
    for n, t, p, v in data:
        for m, u, o, w in data:
            if t == u and p < o and any(v) and any(w) and (s := float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))) >= 0.9:
                pairs[n, m] = (t, s)
    found = graph.similar_names(spark.createDataFrame(data, "name string, type string, place long, vector array<double>"), 0.9)
    got = {(r.a, r.b): (r.type, r.similarity) for r in found.collect()}
    assert got.keys() == pairs.keys() and all(got[k][0] == pairs[k][0] and got[k][1] == pytest.approx(pairs[k][1]) for k in pairs)
    gone, want = set(), set()
    for t in ("t", "u"):
        for a, b in sorted(k for k, (u, _) in pairs.items() if u == t):
            if not {a, b} & gone:
                w, lost = (b, a) if counts[b] > counts[a] else (a, b)
                gone.add(lost)
                want.add((lost, w))
    merged = graph.greedy_merges(found, spark.createDataFrame(list(counts.items()), "canonical string, mention_count long"))
    assert set(rows(merged)) == want and len(want) > 5


def test_resolution_equals_sequential_merges(spark, sf_dir):
    from corvane.plans.graph import resolution_inputs

    nodes, edges, alias, vectors, threshold = resolution_inputs(spark, sf_dir)
    after, moved, merges = graph.resolve(nodes, edges, alias, vectors, threshold)
    count = {r.canonical: r.mention_count for r in nodes.collect()}
    for a, t in rows(alias):
        count[t] += count.pop(a)
    v = {r.name: (r.type, r.place, np.array(r.vector, float)) for r in vectors.collect()}
    pairs = sorted((t, a, b) for a, (t, p, x) in v.items() for b, (u, o, y) in v.items() if t == u and p < o and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold)
    into, frozen = {}, dict(count)
    for _, a, b in pairs:
        if a not in into and b not in into:
            w, lost = (b, a) if frozen[b] > frozen[a] else (a, b)
            into[lost] = w

    def last(n):
        while n in into:
            n = into[n]
        return n

    total = {}
    for n, c in count.items():
        total[last(n)] = total.get(last(n), 0) + c
    assert {r.canonical: r.mention_count for r in after.collect()} == total
    assert sum(r.phase == "alias" for r in merges.collect()) == alias.count() and merges.count() == alias.count() + len(into)
    assert all(r.subject in total and r.object in total for r in moved.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_clusters_equal_brute_force(spark, monkeypatch, kind):
    """Chains of near copies across blocks, exact copies, blank and null texts."""
    monkeypatch.setattr(dedup, "BLOCK", 8)
    random.seed(5)
    data, base = [], [f"t{i}" for i in range(200)]
    for chain in range(6):
        words = [f"c{chain}{w}" for w in base]
        for _ in range(9):
            words[random.randrange(200)] = f"x{random.random()}"
            words[random.randrange(200)] = f"x{random.random()}"
            data.append((len(data), " ".join(words)))
    data += [(200, data[3][1] + " "), (201, None), (202, None), (203, ""), (204, " "), (205, "one two"), (206, "One  two")]
    data = [(f"k{i:03}" if kind == "string" else i, t) for i, t in data]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()

    sets, part = {i: grams(t) for i, t in data}, {i: i for i, _ in data}
    norm = {i: None if t is None else " ".join(t.split()) for i, t in data}
    links = [(a, b) for a, _ in data for b, _ in data if a < b and ((norm[a] is not None and norm[a] == norm[b]) or (sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9))]
    for _ in data:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = dict(rows(dedup.near_duplicate_clusters(spark.createDataFrame(data, f"id {kind}, text string"), "id", threshold=0.9)))
    assert got == part and len(set(part.values())) < len(data) - 30


# ---------------------------------------------------------------- whole tables


def test_recursive_chunks(spark, sf_dir):
    texts = documents(spark, sf_dir)
    got = {}
    for r in registry.QUERIES["k1_recursive_chunks"](spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.total_chunks, r.chunk))
    for doc, text in texts.items():
        chunks = [c for _, _, c in sorted(got.get(doc, []))]
        assert [(i, n) for i, n, _ in sorted(got.get(doc, []))] == [(i, len(chunks)) for i in range(len(chunks))]
        assert all(0 < len(c) <= chunking.SIZE for c in chunks)
        ends = {0}
        for c in chunks:  # in order, each beginning at most the overlap before the last one's end, nothing but white space left out
            reach = {e: len(text) - len(text[e:].lstrip()) for e in ends}
            ends = {at + len(c) for e in ends for at in range(max(0, e - chunking.OVERLAP - 2), reach[e] + 1) if text.startswith(c, at)}
            assert ends
        assert any(not text[e:].strip() for e in ends)


def test_embeddings(spark, sf_dir):
    texts = documents(spark, sf_dir)
    for r in registry.QUERIES["v1_embed_offline"](spark, sf_dir).collect():
        assert r.dimensions == models.DIMENSIONS and r.length in (0.0, 1.0) and (r.length == 1.0 or not any(models.hashed_words([texts[r.doc_id]])[0]))


def test_remembered_vectors():
    asked = []
    encode = models.remembered(lambda texts: asked.append(texts) or [[float(len(t))] for t in texts], 2)
    assert encode(["a", "bb", "a"]) == [[1.0], [2.0], [1.0]] and encode(["a"]) == [[1.0]] and encode(["ccc", "a"]) == [[3.0], [1.0]]
    assert encode(["bb"]) == [[2.0]] and asked == [["a", "bb"], ["ccc"], ["bb"]]


def test_models_by_row_where_a_batch_fails(spark):
    df = spark.createDataFrame([(1, "Ann met Bob"), (2, "boom"), (3, None)], "id long, text string")

    def names():
        def run(texts):
            if "boom" in texts:
                raise RuntimeError
            return [[{"name": w, "type": "person", "score": 0.5} for w in t.split() if w.istitle()] for t in texts]

        return run

    got = {r.id: r for r in df.select("id", models.recogniser(names)("text").alias("e"), models.classifier(lambda: lambda ts: [float(len(t)) for t in ts])("text").alias("n"), models.rewriter()("text").alias("same"), models.rewriter(lambda: lambda ts: [t.upper() if t != "boom" else 1 / 0 for t in ts])("text").alias("up")).collect()}
    assert [e.name for e in got[1].e] == ["Ann", "Bob"] and got[2].e is None and got[3].e == []
    assert [got[i].n for i in (1, 2, 3)] == [11.0, 4.0, 0.0]
    assert (got[1].same, got[1].up, got[2].up) == ("Ann met Bob", "ANN MET BOB", "boom")


def test_unicode_injection(spark, sf_dir):
    from corvane.plans.rails import asked

    texts = {r.item_id: r.t for r in asked(spark, sf_dir).collect()}
    want = {i: any(re.search(p, unicodedata.normalize("NFKD", t), re.I) for p in guard.RAIL_INJECTION) for i, t in texts.items()}
    assert dict(rows(registry.QUERIES["r2_unicode_injection"](spark, sf_dir))) == want


def test_python_chunks_and_relations(spark, sf_dir):
    files = {r.item_id: r.text for r in sources(spark, sf_dir).collect()}
    chunks, relations = {}, {}
    for r in registry.QUERIES["s8_python_chunks"](spark, sf_dir).collect():
        chunks.setdefault(r.item_id, []).append(r.chunk)
    for r in registry.QUERIES["s9_python_relations"](spark, sf_dir).collect():
        relations.setdefault(r.item_id, set()).add((r.subject, r.relation, r.object))
    for item, text in files.items():
        tree = ast.parse(text)
        tops = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert {ast.get_source_segment(text, n) for n in tops} <= set(chunks[item]) and len(chunks[item]) == len(tops) + 1
        imports = {a.name for n in tree.body if isinstance(n, ast.Import) for a in n.names} | {n.module for n in tree.body if isinstance(n, ast.ImportFrom)}
        assert {o for _, r, o in relations[item] if r == "depends_on"} == imports
        assert {o for s, r, o in relations[item] if r == "calls" and s == "D.m"} == {"os.getcwd"}
    assert code.python_structure("def broken(:")[0] == []


def test_provenance_spans(spark, sf_dir):
    texts = documents(spark, sf_dir)
    found = registry.QUERIES["e4_provenance"](spark, sf_dir).collect()
    exact = [r for r in found if "->exact" in r.method]
    assert len(exact) > len(found) / 2
    chunks = {}
    for r in registry.QUERIES["k10_whole_document"](spark, sf_dir).collect():
        chunks[r.doc_id, r.chunk_index] = r.chunk
    assert len(found) == len(chunks)
    for r in exact:
        assert texts[r.doc_id][r.original_start : r.original_end] == chunks[r.doc_id, r.chunk_index] and r.confidence == 1.0
    for r in found:
        if r.method.endswith("unmapped"):
            assert r.original_start == r.original_end == -1


def test_relations_equal_plain_patterns(spark, sf_dir):
    """Extraction and clean-up of every document, sentence by sentence."""
    lead = "TensorFlow is a library for numbers. Deep Learning is a subset of machine learning. Frameworks such as PyTorch, and JAX exist. TensorFlow uses graphs with nodes.\n"
    docs = registry.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(lead), "text").alias("text"))
    want, cleaned = [], []
    for doc, text, known in docs.select("doc_id", "text", graph.entities(F.col("text"))).collect():
        for s in re.split(r"[.!?\n]\s*", re.sub(r"(?m)^#{1,6}\s+.*$", "", text)):
            if len(s.strip()) < 10:
                continue
            found = {name: re.search(p, s) for name, p in graph.RELATIONS}
            made = []
            if found["subset_of"]:
                made = [(found["subset_of"][1].strip(), "subset_of", found["subset_of"][2].strip())]
            else:
                for name, m in found.items():
                    if m and name != "subset_of":
                        subject = m[1].strip()
                        if name not in ("is_a", "uses") or any(subject in e or e in subject for e in known):
                            made.append((subject, name, " ".join(m[2].split()[:4])))
                if m := re.search(graph.SUCH_AS, s):
                    parts = [e.strip() for e in re.split(r",\s*(?:and\s+)?", re.sub(r"[., ]+$", "", m[2]))]
                    made += [(e, "is_a", m[1].strip()) for e in parts if e[:1].isupper() and len(e.split()) <= 4]
            want += [(doc, *x) for x in made]
    assert sorted(rows(registry.QUERIES["g3_relations"](spark, sf_dir))) == sorted(want) and len(want) > 400
    for doc, subject, relation, obj in want:
        a, b = subject.split(), obj.split()
        if len(a) > 4 or len(b) > 4 or (a and (a[0].lower() in ("the", "a", "an") or a[-1].lower() in graph.TRAILING_ADVERBS)) or (b and b[0].lower() in graph.VERB_STARTS):
            continue
        obj = re.sub(graph.TRAILING_JUNK, "", obj).strip()
        if len(obj) >= 3 and not (len(obj.split()) == 1 and obj[0].islower() and len(obj) < 5):
            cleaned.append((doc, subject, relation, obj))
    assert sorted(rows(registry.QUERIES["g4_clean_relations"](spark, sf_dir))) == sorted(cleaned)
    names = [(doc, n) for doc, known in docs.select("doc_id", graph.entities(F.substring("text", len(lead) + 1, 10**9))).collect() for n in known]
    names += [(doc, n) for doc, s, _, o in cleaned for n in (s, o)]
    first, count = {}, {}
    for doc, n in sorted(names):
        first.setdefault(n.lower(), n)
    for _, n in names:
        count[first[n.lower()]] = count.get(first[n.lower()], 0) + 1
    assert dict(rows(registry.QUERIES["g44_chunk_ingest"](spark, sf_dir))) == count
