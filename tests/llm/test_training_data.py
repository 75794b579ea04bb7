"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from corvane.llm import chat_format, common, edit_match, language_id, odd_sketch, packing, quality_rules, stages, token_files, tokenize, toxicity, unigram, warc
from corvane.llm.tokenize import BytePairEncoder, encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Rows that every operator must take: null text, empty text, a repeated row, a null id, a long text, extra columns with names that operators use.
WORDS = "the red fox met a blue owl near old mill by green river and told him of seven small boats".split()


def odd_rows(n=12, seed=1):
    random.seed(seed)
    texts = [None, "", " \n ", " ".join(random.choices(WORDS, k=9000)), "naïve café 日本 🙂\t<|endoftext|> x"]
    texts += [" ".join(random.choices(WORDS, k=random.randint(1, 60))) for _ in range(n)]
    rows = [(i, t, "s", "en", i) for i, t in enumerate(texts)]
    return rows + [rows[-1], (None, texts[-2], "s", None, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, source string, lang string, score long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- tokenizer


def test_memoised_encoder_equals_library():
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    random.seed(0)
    texts = ["", " ", "  a", "a  b ", "a\n b \n c", "<|endoftext|> x", "don't 's x's", "été 1 22 ##", "a \x1c b", "x" * 500]
    texts += ["".join(random.choice("ab é\n\t 'sd1#🙂 .") for _ in range(random.randint(0, 80))) for _ in range(300)]
    texts += [None, "l'été. Œuvre, non.. ABC.,", "日本。 語, ok.", "a" * 70 + ". end", *(" ".join(random.choices(["the.", "the", "of,", "naïve.", "3.14", "x.y", "Ab"], k=40)) for _ in range(20))]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time with all units remembered
        ids, sizes = encoder(BPE).encode(texts)
        assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == want
    small = BytePairEncoder(BPE, capacity=20)  # forgets again and again
    for at in range(0, len(texts), 7):
        assert small.encode(texts[at : at + 7])[0].tolist() == sum(want[at : at + 7], [])
    assert [x.tolist() for x in encoder(BPE).encode([])] == [[], []]


def test_encoder_cuts_long_texts(monkeypatch):
    monkeypatch.setattr(tokenize, "STRETCH", 60)
    library = Tokenizer.from_file(BPE)
    random.seed(3)
    texts = [" ".join(random.choices([*WORDS, "a.", "\n", ""], k=n)) for n in (3, 500, 0, 90, 1, 700)]
    ids, sizes = encoder(BPE).encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


# ---------------------------------------------------------------- 1: WARC


def test_warc_round_trip(spark):
    big = "y" * 1500
    pages = [(1, "http://a\r\nX: y", big, 1), (2, None, big, 2), (9, "u", big, 3), (9, "u", big, 3), (3, "u", "small", 4), (4, "u", "small", 5), (5, "u", None, 6), (None, "u", big, 7), (None, "u", None, 8), (-6, "u", "é" * 700, 9)]
    pages += [(100 + i, "u", f"<p>page {i} {'lorem ipsum ' * (i % 17)}</p>", i) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest long")
    path = common.scratch(spark, "t")
    warc.write_archives(df, path)
    got = rows_of(warc.read_archives(spark, path, with_payload=True))
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in by[9]] == ["response", "response"]
    for k in (1, 2):
        assert (by[k][0]["record_type"], by[k][0]["refers_to"], by[k][0]["payload_bytes"]) == ("revisit", 9, 1500)
        assert by[k][0]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and by[k][0]["payload"] is None
    assert by[3][0]["record_type"] == by[4][0]["record_type"] == "response"
    assert by[5][0]["payload"] == b"" and by[5][0]["payload_bytes"] == 0
    assert sorted((r["record_type"], r["refers_to"]) for r in by[None]) == sorted([("revisit", 9), ("response", None)], key=str)
    assert by[-6][0]["payload_bytes"] == 1400
    assert all(r["payload"] == p[2].encode() for p in pages[10:] for r in by[p[0]])
    contents = [r["content"] for r in warc.common.read_files(spark, path).collect()]
    assert all(c[:4] == b"\x5d\x2a\x4d\x18" for c in contents)  # a leading dictionary frame


def test_warc_a_third_of_equal_large_pages(spark):
    """Copies in many partitions, a very long page, several archives a task."""
    random.seed(2)
    body = "".join(random.choices("abcdefgh <>", k=120_000))
    pages = [(i, f"u{i}", body if i % 3 == 0 else f"<p>{random.random()}</p>" * (1 + i % 90)) for i in range(600)]
    pages += [(700, "u", "".join(random.choices("abcdefgh <>", k=3_000_000)))]
    path = common.scratch(spark, "t")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7), path, archive_bytes=40_000)
    got = {r["page_id"]: r for r in rows_of(warc.read_archives(spark, path, with_payload=True))}
    assert len(got) == len(pages) and common.read_files(spark, path).count() > 7
    for page, _, html in pages:
        revisit = html == body and page != 597
        assert (got[page]["record_type"], got[page]["refers_to"]) == (("revisit", 597) if revisit else ("response", None))
        assert got[page]["payload"] == (None if revisit else html.encode()) and got[page]["payload_bytes"] == len(html)


def test_warc_cold_copies_are_joined(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 0)  # none is hot
    pages = [(i, "u", f"{i // 2} " * 900) for i in range(60)]
    path = common.scratch(spark, "t")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    got = {r["page_id"]: r["refers_to"] for r in rows_of(warc.read_archives(spark, path))}
    assert got == {i: i + 1 if i % 2 == 0 else None for i in range(60)}


def test_warc_records_alone_and_cut_off():
    records = [warc.make_record(i, "u", f"text {i} of many alike".encode() * 9, 9 * len(f"text {i} of many alike"), hashlib.sha1(f"text {i} of many alike".encode() * 9).digest(), None, "2000-01-01T00:00:00Z") for i in range(200)]
    (archive,) = warc.archives(iter(records))
    assert list(warc.decompressed(archive)) == records
    assert list(warc.decompressed(archive, slice_bytes=7)) == records
    with pytest.raises(ValueError):
        list(warc.decompressed(archive[:-5]))
    assert [list(warc.decompressed(a)) for a in warc.archives(iter(records), 300)] != [records]
    assert sum((list(warc.decompressed(a)) for a in warc.archives(iter(records), 300)), []) == records
    (few,) = warc.archives(iter(records[:2]))  # too few to train on: the text itself
    assert few[:4] == b"\x5d\x2a\x4d\x18" and list(warc.decompressed(few)) == records[:2]
    assert [warc.page_of(warc.record_id(x)) for x in (None, 0, 7, -1, 2**63 - 1, -(2**63))] == [None, 0, 7, -1, 2**63 - 1, -(2**63)]


def test_warc_of_nothing(spark):
    path = common.scratch(spark, "t")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


# ---------------------------------------------------------------- 2: unigram counts


def test_unigram_equals_library_with_ties():
    random.seed(5)
    for _ in range(60):
        vocabulary = {"<unk>": 0.0} | {"".join(random.choice("abc▁") for _ in range(random.randint(1, 4))): -float(random.randint(0, 3)) for _ in range(9)}
        library = Tokenizer(models.Unigram(list(vocabulary.items()), 0, False))
        library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = unigram.UnigramCounter(list(vocabulary.items()), False)
        for _ in range(20):
            text = "".join(random.choice("abcd ▁") for _ in range(random.randint(0, 14)))
            assert counter.count(text)[0] == len(library.encode(text, add_special_tokens=False).ids), (text, vocabulary)


def test_unigram_bytes_and_rows(docs, empty):
    vocabulary = unigram.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = rows_of(unigram.count_tokens(docs, vocabulary))
    want = sorted((r[0] is None, r[0] or 0, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == want
    assert unigram.count_tokens(empty, vocabulary).count() == 0


# ---------------------------------------------------------------- 3: near-duplicates


def brute_components(rows, words, percent):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = set() if not w else {tuple(w)} if len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    random.seed(words)
    base = [random.choices(WORDS + [f"w{i}" for i in range(200)], k=120) for _ in range(12)]
    rows = []
    for i in range(220):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 3, 5, 8])):
            w[random.randrange(len(w))] = f"x{random.random()}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two  words"), (904, "two words")]
    got = rows_of(odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), odd_sketch.Similarity(words, percent)))
    parts, sizes = brute_components(rows, words, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == parts
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(docs, empty):
    got = rows_of(odd_sketch.near_duplicates(docs))
    assert len(got) == docs.count()
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert odd_sketch.near_duplicates(empty).count() == 0


def test_pipeline_keeps_the_texts_of_repeated_ids(spark):
    """Of rows that share an id only equal texts and near copies go; which row stays is fixed."""
    from corvane.llm import stages

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a, "x"), (5, a, "x"), (2, b, "x"), (5, b, "x"), (5, c, "z"), (5, c, "y"), (7, d, "x"), (7, c + " end", "x"), (8, d + " end", "x"), (9, "", "x"), (9, "", "x"), (None, a, "x")]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got = sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in rows_of(stages.drop_near_duplicates(spark, docs, "")))
        assert got == sorted([(0, a, "x"), (1, a, "x"), (2, b, "x"), (5, c, "y"), (7, d, "x"), (9, "", "x")])


@pytest.mark.parametrize("wide", [48, 0])
def test_large_bucket_is_whole(spark, monkeypatch, wide):
    """More members than a block, most of them not similar enough to the first: links across blocks are found, with further bands (wide 0) as well."""
    monkeypatch.setattr(odd_sketch, "BLOCK", 16)
    monkeypatch.setattr(odd_sketch, "WIDE", wide)
    random.seed(8)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in random.sample(range(100), random.choice([0, 2, 4, 6, 7])):
            w[k] = f"x{i % 40}-{k}"
        rows.append((i, " ".join(w)))
    got = rows_of(odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), odd_sketch.Similarity(3, 85)))
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 3, 85)[0]


def test_groups_of_a_bucket_hold_all_pairs_across_components(spark, monkeypatch):
    monkeypatch.setattr(odd_sketch, "BLOCK", 8)
    random.seed(4)
    rows = []
    for bucket, parts in enumerate(([60, 1], [30, 25, 9], [1] * 40, [3, 2], [50, *[1] * 7])):
        node = 1000 * bucket
        for n in parts:
            first = node
            rows += [(bucket, 0, 0, node + i, first, 5, [1], b"") for i in range(n)]
            node += n
    members = spark.createDataFrame(rows, "bucket long, sub long, band int, node long, component long, n_shingles long, bands array<long>, sketch binary")
    dealt = rows_of(odd_sketch._deal(members, odd_sketch._main(members)))
    groups = {}
    for r in dealt:
        groups.setdefault(tuple(r[k] for k in odd_sketch.GROUP), []).append(r)
    met = set()
    for group in groups.values():
        sides = {r["block"] for r in group}
        assert len(group) <= 16 * 3  # two blocks dealt by a hash
        for x in group:
            for y in group:
                if x["node"] < y["node"] and x["component"] != y["component"] and ((len(sides) == 1 and x["kind"] == 1) or x["block"] != y["block"]):
                    met.add((x["node"], y["node"]))
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert met == {(x[3], y[3]) for group in by.values() for x in group for y in group if x[3] < y[3] and x[4] != y[4]}
    assert sum(r["bucket"] == 0 for r in dealt) <= 60 + 1 * 8 + 1  # one member outside: a row a member, and its own row for each block


def test_odd_sketch_estimates():
    random.seed(2)
    how = odd_sketch.Similarity(3, 85)
    a = np.unique(np.array([random.getrandbits(64) for _ in range(1000)], np.uint64))
    near = np.concatenate([a[:925], np.array([random.getrandbits(64) for _ in range(75)], np.uint64)])
    far = np.concatenate([a[:300], np.array([random.getrandbits(64) for _ in range(700)], np.uint64)])
    s = odd_sketch.sketches(np.array([odd_sketch.signature(x) for x in (a, near, far)]))
    bits = lambda i, j: int(np.bitwise_count(s[i] ^ s[j]).sum())
    assert bits(0, 0) == 0 and bits(0, 1) <= how.most_bits < bits(0, 2)


def test_components_of_chains_and_stars(spark):
    from corvane.operators.components import connected_components

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in rows_of(connected_components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 4: quality rules


def brute_statistics(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, copies, seen = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0, set()
    for x in lines:
        copies += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered)]


def test_rule_statistics_equal_brute_force():
    random.seed(4)
    texts = [None, "", "a", "é b c\nx\n\nx\n \n", "# $ a|b <c>"] + [" ".join(random.choices("a b c d e".split(), k=40)) + "\n" + random.choice(["q", "q\nq", ""]) for _ in range(40)]
    for t in texts:
        assert quality_rules.statistics(None if t is None else t.encode())[0] == brute_statistics(t), t


def test_forest_isolates_outliers_and_threshold():
    random = np.random.default_rng(0)
    usual, odd = random.normal(0, 1, (2000, 4)), random.normal(9, 1, (20, 4))
    forest = quality_rules.Forest(np.vstack([usual, odd]))
    assert forest.scores(odd).min() > np.quantile(forest.scores(usual), 0.99)
    assert quality_rules.best_threshold([(400, 1, 95), (700, 1, 5), (700, 0, 10)], 0.9) > 0.4
    assert quality_rules.best_threshold([(400, 1, 95)], 0.9) == 1.0
    assert len(quality_rules.Forest(np.empty((0, 8))).scores(np.zeros((3, 8)))) == 3


def test_forest_scores_equal_walks():
    random_ = np.random.default_rng(3)
    rows = random_.normal(size=(400, len(quality_rules.FEATURES)))
    forest = quality_rules.Forest(rows, trees=7, tree_rows=64)

    def path(root, row):
        node, steps = root, 0
        while forest.feature[node] >= 0:
            node = forest.left[node] + (row[forest.feature[node]] >= forest.value[node])
            steps += 1
        return forest.length[node], steps

    usual = 2 * (np.log(63) + 0.5772156649015329) - 2 * 63 / 64
    want = [2 ** (-np.mean([path(r, row)[0] for r in forest.roots]) / usual) for row in rows[:60]]
    assert np.allclose(forest.scores(rows[:60]), want)
    assert all(length >= steps for length, steps in (path(r, row) for r in forest.roots for row in rows[:20]))
    assert not forest.scores(rows[:0]).size


def test_judge_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = rows_of(quality_rules.judge(docs, labels))
    assert len(got) == docs.count() and all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert quality_rules.judge(empty, labels.filter("false")).count() == 0


# ---------------------------------------------------------------- 5: language


def test_language_learns_and_calibrates(spark, docs, empty):
    random.seed(6)
    words = {"en": "the and that with from they".split(), "de": "der und nicht mit sich auch".split(), "fr": "les une dans pour avec être".split()}
    rows = [(i, " ".join(random.choices(words[k], k=25)), k) for i, k in enumerate(random.choices(list(words), k=400))]
    rows += [(900, None, "en"), (901, "123 !?", "en"), (902, "the and that with", None), (None, "und nicht mit sich", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows_of(language_id.add_language(df, language_id.fit(df)).drop("text"))}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:400])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[902]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in rows_of(language_id.add_language(docs.select("text"), language_id.fit(empty)))} == {"und"}


def test_learnable_split(spark):
    df = spark.range(200).toDF("doc_id")
    got = {r["doc_id"]: r["h"] for r in rows_of(df.select("doc_id", common.held_out().alias("h")))}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_ftrl_is_sparse():
    rows = [(np.array([i % 2, 5 + i % 7]), np.array([1.0, 0.01])) for i in range(200)]
    w, _ = language_id.train(rows, np.array([i % 2 for i in range(200)]), 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and not w[2:5].any() and not w[5:12].any()


def test_ftrl_equals_plain_python():
    """The same steps, one coordinate at a time."""
    random.seed(5)
    alpha, beta, l1, l2, classes = 0.5, 1.0, 0.02, 0.02, 3
    rows = []
    for _ in range(50):
        at = sorted(random.sample(range(40), random.randint(1, 6)))
        rows.append((np.array(at), np.array([random.random() for _ in at], np.float32)))
    marks = [random.randrange(classes) for _ in rows]
    z, n = {}, {}

    def weight(i, k):
        lead = z.get((i, k), 0.0)
        if abs(lead) <= l1:
            return 0.0
        return -(lead - (l1 if lead > 0 else -l1)) / ((beta + n.get((i, k), 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(3):
        for r in order.permutation(len(rows)):
            entries = [*zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True), ("bias", 1.0)]
            scores = [sum(v * weight(i, k) for i, v in entries) for k in range(classes)]
            total = sum(np.exp(s) for s in scores)
            old = {(i, k): weight(i, k) for i, _ in entries for k in range(classes)}
            for i, v in entries:
                for k in range(classes):
                    g = v * (np.exp(scores[k]) / total - (k == marks[r]))
                    before = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * old[i, k]
                    n[i, k] = before + g * g
    w, bias = language_id.train(rows, np.array(marks), classes)
    assert np.allclose([[weight(i, k) for k in range(classes)] for i in range(40)], w[:40], atol=1e-6)
    assert np.allclose([weight("bias", k) for k in range(classes)], bias, atol=1e-6) and not w[40:].any()


def test_grams_equal_brute_force(monkeypatch):
    texts = ["", "a", "Straße İx", "one two three " * 9, "日本🙂x"]
    whole = [np.sort(np.concatenate([*language_id.grams(t), np.empty(0, np.int32)])) for t in texts]
    assert [len(w) for w in whole] == [max(len(t.lower()) - k, 0) + max(len(t.lower()) - k - 1, 0) + max(len(t.lower()) - k - 2, 0) for t in texts for k in [0]]
    for size in (1, 2, 3, 10):
        monkeypatch.setattr(language_id, "STRETCH", size)
        assert all(np.array_equal(np.sort(np.concatenate([*language_id.grams(t), np.empty(0, np.int32)])), w) for t, w in zip(texts, whole, strict=True))


def test_rows_of_one_id_are_all_learned_from(spark):
    """More rows than the sample holds, all of one id (or none): the sample is of rows, not of ids."""
    for doc in (13, 8, None):
        rows = spark.range(3000).selectExpr(f"cast({doc or 'null'} as bigint) as doc_id", "if(id % 2 = 0, 'aa', 'bb') as lang", "concat(if(id % 2 = 0, 'qu qua ', 'zw zwo '), id) as text")
        model = language_id.fit(rows, sample=200)
        assert model.languages == ([] if doc is None else ["aa", "bb"])  # rows without id are not learned from
        drawn = common.draw(rows, 200)
        assert drawn.count() == 200 and sorted(drawn.columns) == ["doc_id", "h", "lang", "text"]
        copies = rows.withColumn("text", F.when(F.col("text").endswith("1"), "the same").otherwise(F.col("text")))
        assert common.draw(copies, 200).filter("text = 'the same'").count() <= 2
        assert rows_of(common.draw(rows.repartition(7), 200)) == rows_of(drawn)
    measured = spark.range(2000).selectExpr("cast(7 as bigint) as doc_id", "false as base_failed", "array(cast(id as double), 0, 0, 0, 0, 0, 0, 0) as features")
    assert len(quality_rules.grow_forest(measured).roots) == quality_rules.TREES


# ---------------------------------------------------------------- 6: chat


def test_prefix_examples(spark):
    talks = [(1, 0, "user", "hi # <b>"), (1, 1, "assistant", "</turn>\n### user\nx \\h"), (1, 2, "user", None), (1, 3, "assistant", "two"), (1, 4, "user", "bye"),
             (2, 0, "us\ner#", "only"), (3, 0, "assistant", ""), (4, 1, "user", "b"), (4, 1, "user", "b"), (4, None, None, "first"), (None, 0, "assistant", "é🙂")]
    df = spark.createDataFrame([(*t, "x") for t in talks], "conv_id long, turn long, role string, text string, example string")
    ex = rows_of(chat_format.prefix_examples(df))
    mine = sorted((r for r in ex if r["conv_id"] == 1), key=lambda r: r["example"])
    assert len(mine) == 3 and [r["whole"] for r in mine] == [False, False, True] and mine[2]["loss_chars"] == 0
    assert mine[1]["text"].startswith(mine[0]["text"])
    assert mine[1]["text"][mine[1]["loss_start"] :][: mine[1]["loss_chars"]] == "two"
    got = {r["conv_id"]: r for r in rows_of(chat_format.digests(chat_format.prefix_examples(df)))}
    for conv in {t[0] for t in talks}:
        own = sorted((t for t in talks if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest(), conv
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.prefix_examples(df.filter("false"))).count() == 0


# ---------------------------------------------------------------- 7: token files


def test_simple8b_round_trips(monkeypatch):
    random = np.random.default_rng(1)
    cases = [[], [0], [0] * 1000, range(5000), random.integers(0, 2**32, 900), random.integers(0, 2**63, 700), np.where(random.random(3000) < 0.9, 0, random.integers(0, 70000, 3000)), [2**30 - 1, 2**30, 0, 2**64 - 1], [0] * 239 + [1] + [0] * 130]
    for case in cases:
        ids = np.array(case, np.uint64)
        packed = token_files.pack(ids)
        assert np.array_equal(token_files.unpack(*packed, len(ids)), ids)
        with monkeypatch.context() as m:
            m.setattr(token_files, "SLAB", 512)
            assert all(np.array_equal(a, b) for a, b in zip(token_files.pack(ids), packed, strict=True))
        if len(ids) > 600:
            assert np.array_equal(token_files.unpack(*packed, len(ids), 1, 2), ids[256:512])


def test_token_files(spark, docs, empty, monkeypatch):
    path = common.scratch(spark, "t")
    token_files.write_token_files(docs.repartition(5), path, BPE)
    got = sorted(rows_of(token_files.read_token_files(spark, path, with_ids=True)), key=lambda r: r["start"])
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    at = 0
    want = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    for r, w in zip(got, want, strict=True):
        ids = library.encode(w[1] or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (w[0], at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    # one id for many rows, several files a task, frames of a few documents
    rows = [(5 if i % 2 else None, f"{i} {' '.join(WORDS)}", 0) for i in range(400)] + [(5, "the same", 1)] * 200
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    path = common.scratch(spark, "t")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, file long").repartition(6), path, BPE, file_frames=3)
    assert common.read_files(spark, path).count() > 6
    got = sorted(rows_of(token_files.read_token_files(spark, path, with_ids=True)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 200 + [5] * 400
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert sorted(tuple(r["ids"]) for r in got) == sorted((*library.encode(r[1], add_special_tokens=False).ids, 2) for r in rows)
    path = common.scratch(spark, "t")
    token_files.write_token_files(empty, path, BPE)
    assert token_files.read_token_files(spark, path).count() == 0


# ---------------------------------------------------------------- 8: edit matching


def brute_search(pattern, text, anchored):
    row = [j if anchored else 0 for j in range(len(text) + 1)]
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_brute_force():
    random.seed(3)
    for _ in range(300):
        p, t = "".join(random.choices("ab ", k=random.randint(1, 70))), "".join(random.choices("ab ", k=random.randint(0, 60)))
        for anchored in (False, True):
            assert edit_match.search(p, t, anchored)[0] == brute_search(p, t, anchored)


def test_every_match_within_budget_is_found():
    random.seed(9)
    items = [(i, "".join(random.choices("abcdefgh ", k=random.randint(20, 90))).strip()) for i in range(20)]
    index = edit_match.ItemIndex([*items, (90, None), (91, "  ")], 0.1)
    for i, item in items:
        text = list(edit_match.normal(item))
        budget = int(len(text) * 0.1)
        for _ in range(budget):
            at, kind = random.randrange(len(text)), random.random()
            text[at : at + 1] = [] if kind < 0.3 else ["z", text[at]] if kind < 0.6 else ["z"]
        doc = "".join(random.choices("mnop ", k=300)) + "".join(text) + "".join(random.choices("mnop ", k=50))
        found = {m[0]: m for m in index.matches(doc)}
        assert i in found and found[i][1] <= budget
        assert brute_search(edit_match.normal(item), edit_match.normal(doc), False) == found[i][1]
        assert brute_search(edit_match.normal(item), edit_match.normal(doc)[found[i][2] : found[i][3]], True) == found[i][1]


def test_find_items_rows_and_blocks(spark, docs, empty):
    items = spark.createDataFrame([(1, "Seven small boats told him of old mill by green river"), (2, "seven small  boats told him of old mill by green river"), (3, None), (4, "nothing like that is in here")], "item_id long, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, "x " + "seven small boats tld him of old mill by green river" + " y"), (77, "seven small boats")], "doc_id long, text string"))
    whole = sorted(map(tuple, edit_match.find_items(more, items).collect()), key=str)
    assert {(r[0], r[1]) for r in whole if r[0] == 77} == {(77, 1), (77, 2)}
    assert sorted(map(tuple, edit_match.find_items(more, items, block_bytes=60).collect()), key=str) == whole
    assert edit_match.without_items(more, items).count() == more.count() - len({(r[0], r[3]) for r in whole})
    assert edit_match.find_items(empty, items).count() == edit_match.find_items(docs, items.filter("false")).count() == 0


# ---------------------------------------------------------------- 9: packing


def test_first_fit_decreasing_equals_brute_force():
    random.seed(7)
    for _ in range(30):
        lengths = np.array([random.randint(1, 100) for _ in range(random.randint(0, 80))], np.int64)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(100)
            want[i] = (k, 100 - room[k])
            room[k] -= lengths[i]
        assert {i: (int(bins[i]), int(offsets[i])) for i in range(len(lengths))} == want


def test_pack_documents(docs, empty):
    got = rows_of(packing.pack_documents(docs, BPE, sequence=64, group_docs=5))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    want = []
    for r in odd_rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0], s, zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    assert sorted(((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=str) == sorted(want, key=str)
    assert packing.pack_documents(empty, BPE).count() == 0


def test_pack_a_document_larger_than_a_group(spark):
    rows = [(1, " ".join(random.choices(WORDS, k=30_000))), *((i, "short") for i in range(2, 40))]
    pieces = packing.cut_documents(spark.createDataFrame(rows, "doc_id long, text string"), BPE, 4, 64)
    assert pieces.filter("sequence_id is null").count() <= 39  # whole sequences are in no group
    got = rows_of(packing.pack_pieces(pieces, 64))
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) == pieces.count()
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 64


# ---------------------------------------------------------------- 10: toxicity


def test_toxicity_learns_and_is_fair_to_groups():
    random.seed(1)
    rows, toxic = [], []
    for i in range(600):
        words = set(random.choices(WORDS, k=8))
        bad = i % 4 == 0
        if bad and random.random() < 0.6:
            words.add("idiot")
        if random.random() < (0.8 if bad else 0.1):
            words.add("muslim")  # named more often in toxic rows
        rows.append(words)
        toxic.append(float(bad))
    fair, bias = toxicity.fit_weights(rows, np.array(toxic), fairness=50.0)
    plain, _ = toxicity.fit_weights(rows, np.array(toxic), fairness=0.0)
    assert plain.get("muslim", 0) > 4 * abs(fair.get("muslim", 0)) and fair["idiot"] > 2
    model = toxicity.Model(fair, bias)
    assert model.score(b"the IDIOT!! told him") > 0.5 > 0.3 > model.score(b"a muslim told him of boats")
    assert toxicity.Model(*toxicity.fit_weights(rows, np.zeros(600))).score(b"idiot") < 1e-9


def test_toxicity_weights_are_a_minimum():
    """The objective in plain Python; no small step of a weight or of the bias lowers it."""
    random.seed(8)
    rows = [set(random.sample([*"abcdefgh", "man", "woman", "girl", "boy"], random.randint(2, 7))) for _ in range(50)]
    toxic = np.array([float("a" in r or ("man" in r and random.random() < 0.7)) for r in rows])
    named = [sorted(r & {"man", "woman", "girl", "boy"}) for r in rows]
    weights, bias = toxicity.fit_weights(rows, toxic, named, l1=0.5, fairness=5.0, steps=6000)
    names = [w for w in sorted(set().union(*rows)) if sum(w in r for r in rows) >= toxicity.LEAST_ROWS]

    def objective(w, b):
        total = 0.0
        for r, y in zip(rows, toxic, strict=True):
            s = b + sum(w.get(x, 0.0) for x in r)
            total += np.log1p(np.exp(-s if y else s))
        total += 0.5 * sum(abs(v) for v in w.values())
        for sentence in named:
            total += 2.5 * sum((w.get(a, 0.0) - w.get(b_, 0.0)) ** 2 for a, b_ in toxicity.swaps(set(sentence)))
        return total + 2.5 * sum(w.get(t, 0.0) ** 2 for t in names if t in toxicity.IDENTITY_TERMS["gender"])

    best = objective(weights, bias)
    for name in names:
        for step in (-0.02, 0.02):
            assert objective(weights | {name: weights.get(name, 0.0) + step}, bias) >= best - 1e-5
    assert min(objective(weights, bias - 0.02), objective(weights, bias + 0.02)) >= best - 1e-5 and weights["a"] > 0.5


def test_toxicity_words(monkeypatch):
    quoted = "\u201cFool\u201d \u2014 naïve\u00a0fool's «girl». Man!\nno".encode()
    assert toxicity.words(quoted) == {w.encode() for w in ("fool", "naïve", "s", "girl", "man", "no")}
    assert toxicity.mentions(quoted) == [["girl"], ["man"]] and toxicity.mentions(None) == []
    whole = toxicity.words(b"ab cd, ef gh " * 50)
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    assert toxicity.words(b"ab cd, ef gh " * 50) == whole


def test_toxicity_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(17)] + [(1, None)], "doc_id long, toxic int")
    name = stages._own(docs, "score")
    got = rows_of(toxicity.add_toxicity(docs, toxicity.fit(docs, labels), name=name))
    assert name != "score" and len(got) == docs.count() and all(0 <= r[name] <= 1 for r in got)
    assert toxicity.add_toxicity(empty, toxicity.fit(empty, labels), name=name).count() == 0


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages_keep_columns_and_decide(spark, sf_dir):
    import corpus_pipeline

    docs = common.load(spark, sf_dir, "documents")
    extra = docs.limit(1).withColumn("doc_id", docs.doc_id + 10**6)
    docs = docs.unionByName(extra)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stage(stage(spark, docs, sf_dir), name)
        assert after.schema.names == docs.schema.names
        assert 0.6 * n < after.count() <= n
        if name == "near_duplicates":
            assert after.filter("doc_id >= 1000000").count() == 0
        docs, n = after, after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == n


def tables(spark, folder, documents, columns="doc_id long, text string, lang string, source string, n_chars long"):
    """A folder of the tables that the pipeline reads."""
    learn = [(i, f"you stupid idiot {i}" if i % 3 == 0 else f"the fox and the owl number {i}", "en", "s", 9) for i in range(2000, 2200)]
    rows = spark.createDataFrame(documents, columns)
    for c in rows.columns[5:]:
        learn = [(*r, None) for r in learn]
    rows.unionByName(spark.createDataFrame(learn, columns)).write.parquet(f"{folder}/documents.parquet")
    marks = [(r[0], 1, int("stupid" in r[1])) for r in learn]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(WORDS)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, repeated ids with other texts and with the same one, empty and long texts, and columns with the stages' own names."""
    import corpus_pipeline

    random.seed(6)
    long = " ".join(random.choices(["a", "the", "of", "and", *WORDS], k=30_000))
    odd = [(1, None), (2, ""), (3, long), (4, long + " tail"), (5, "one text about the red fox of the mill"), (5, "another text about an old blue owl"), (6, "same words here for the two of us all"), (6, "same words here for the two of us all"), (None, "no id but a text of the usual words"), (7, "you stupid idiot"), (8, "before " + " ".join(WORDS) + " behind")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, lang_pred string, lang_score double, digest string, node long, place int, h long"
    rows = [(d, t, "en", "s", 1, 0.5, "x", 0.1, "d", 1, 2, 3) for d, t in odd]
    folder = str(tmp_path)
    learn = spark.createDataFrame(rows, columns)
    tables(spark, folder, [tuple(r) for r in learn.collect()], columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, folder), name)
        assert docs.columns == learn.columns
    left = {(r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id < 2000}
    assert (3, long) in left and (4, long + " tail") not in left and (7, "you stupid idiot") not in left and not any(d == 8 for d, _ in left)
    assert {(5, odd[4][1]), (5, odd[5][1]), (6, odd[6][1]), (None, odd[8][1])} <= left
    packed = rows_of(corpus_pipeline.run(spark, folder))
    pieces = {}
    for r in packed:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert sum(n for _, n, _ in pieces[3]) == pieces[3][0][2] and len(pieces[6]) == 1 and len(pieces[5]) == 2


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    for name, columns in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


CONTRACT = {
    "op1_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


def test_registered_queries_hold_their_contract(spark, sf_dir):
    from corvane.llm.queries import queries

    registered = queries()
    assert [n.split("_")[0] for n in registered if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in registered
    for name, run in registered.items():
        out = run(spark, sf_dir)
        kinds = [f"{n} {k}" for n, k in out.dtypes]
        assert set(CONTRACT.get(name, "").split(", ")) - {""} <= set(kinds), name
        found = out.collect()
        table, key = {"op1_warc": ("pages", "page_id"), "op6_chat_format": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
        ids = {r[0] for r in common.load(spark, sf_dir, table).select(key).collect()}
        if name == "op6_chat_format":
            (row,) = [r for r in found if r.conv_id == -7]
            said = chat_format.LOOKALIKE
            assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
            assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
            ids = ids | {-7}
        if name in CONTRACT:
            assert {r[key] for r in found} == ids and (len(found) == len(ids) or name == "op9_packing"), name
        if name == "op9_packing":
            used = {}
            for r in found:
                used.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert all(sum(n for _, n in u) <= 1024 and [o for o, _ in sorted(u)] == np.cumsum([0, *(n for _, n in sorted(u))])[:-1].tolist() for u in used.values())
            assert len(used) <= 1 + -(-sum(r.length for r in found) // 1024) * 1.02
