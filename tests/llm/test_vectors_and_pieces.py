"""Vector codes, merge pieces and hard negatives against plain versions, the library, and odd tables."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from corvane.llm import fixed_point, heap_lloyd, merge_pieces, queries, radix_mining

VECTORS = "vec_id long, embedding array<float>, label int, error string, code int"


def odd_vectors(n=60, dimension=8, seed=3):
    rng = random.Random(seed)
    rows = [(10 * i, [rng.choice([-0.5, 0.25, 0.0, 0.125, 0.3]) for _ in range(dimension)], rng.choice([0, 1, None, 2]), "x", 1) for i in range(n)]
    bad = [(5, None, 1, "x", 1), (6, [0.1] * 7 + [None], 1, "x", 1), (7, [math.nan] * 8, 1, "x", 1), (8, [math.inf] + [0.0] * 7, 1, "x", 1), (9, [0.1] * 3, 1, "x", 1)]
    return rows + bad + [rows[3], rows[3], (None, rows[4][1], 2, None, None), (-200, [1e30, -1e30] + [0.5] * 6, 1, "x", 1)] + [(1000 + i, rows[0][1], 1, "x", 1) for i in range(40)]


def kept_of(rows, scale, bits=62):
    whole = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    first = min(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(first[1])
    most = min(fixed_point.bound(d, bits), 1 << 30)
    return [(r[0], r[2], [math.floor(max(-most, min(most, float(np.float32(x)) * scale))) for x in r[1]]) for r in whole if len(r[1]) == d]


# ---------------------------------------------------------------- 11: codes


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Lloyd's rounds with every part compared with every entry, in Python's whole numbers."""
    kept = sorted(kept_of(rows, scale), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cuts = [0, *np.cumsum([len(p) for p in np.array_split(np.arange(len(kept[0][2])), parts)]).tolist()]
    cut = [[v[a:b] for a, b in zip(cuts, cuts[1:])] for _, _, v in kept]  # noqa: B905
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(p, c[p]), []).append(c[p])
            books[p] = [[sum(col) // len(groups[e]) for col in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    out = []
    for (i, label, _), c in zip(kept, cut, strict=True):
        at = [near(p, c[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e in at), sum(far(c[p], books[p][e]) for p, e in enumerate(at))))
    totals = {}
    for _, label, _, e in out:
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[label]) for i, label, c, e in out), key=str), digest


@pytest.mark.parametrize(("entries", "parts", "block"), [(16, 4, 7), (256, 4, 2048), (5, 3, 16), (1, 2, 9)])
def test_codes_equal_plain_rounds(spark, monkeypatch, entries, parts, block):
    monkeypatch.setattr(heap_lloyd, "BLOCK", block)
    rows = odd_vectors()
    codes, books = heap_lloyd.quantise(spark.createDataFrame(rows, VECTORS).repartition(3), parts, entries)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in heap_lloyd.with_label_error(codes).collect()), key=str)
    assert (got, heap_lloyd.digest(books)) == plain_codes(rows, parts, entries)


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    codes, _ = heap_lloyd.quantise(spark.createDataFrame(odd_vectors(), VECTORS), 2, 4)
    want = sorted(map(str, heap_lloyd.with_label_error(codes).collect()))
    monkeypatch.setattr(heap_lloyd, "FEW_LABELS", 0)
    assert sorted(map(str, heap_lloyd.with_label_error(codes).collect())) == want


def test_heaps_pop_what_may_move_alone():
    """After a small step most parts stay in their heaps, and all have their nearest entry."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (20, 4))
    points = (centres[rng.integers(0, 20, 3000)] + rng.integers(-60, 60, (3000, 4))).astype(np.int64)
    entries = centres.astype(np.int64)
    heaps, drift = heap_lloyd.Heaps.of_all(points, entries), np.zeros(20)
    looked = 0
    for _ in range(6):
        moved = entries + rng.integers(-15, 16, entries.shape)
        way = np.sqrt(((moved - entries) ** 2).sum(axis=1))
        drift = drift + way + np.array([np.delete(way, e).max() for e in range(20)])
        entries = moved
        looked += len(heaps.advance(points, entries, drift)[0])
        assert heaps.owners().tolist() == heap_lloyd.nearest(points, entries)[0].tolist()
    assert looked < 6 * 3000 / 4


def test_nearest_of_large_numbers_is_exact():
    far = 1 << 27
    points = np.array([[far, -far], [0, 0]], np.int64)
    entries = np.array([[far - 1, -far], [far, -far + 1], [-far, far]], np.int64)
    at, best, second = heap_lloyd.nearest(points, entries)
    assert at.tolist() == [0, 0] and best[0] == 1 and second[0] == 1 and best[1] == (far - 1) ** 2 + far**2


def test_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    bad = spark.createDataFrame([(1, None, 1, "x", 1), (2, [math.nan], 1, "x", 1)], VECTORS)
    for rows in (none, bad):
        codes, books = heap_lloyd.quantise(rows)
        assert books == [] and heap_lloyd.with_label_error(codes).count() == 0
        assert radix_mining.mine(rows, "id % 2 = 0").count() == 0


# ---------------------------------------------------------------- 12: pieces


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as f:
        return f.read()


def test_pieces_equal_library(model):
    codec, library = merge_pieces.PieceCodec(model), SentencePieceProcessor(model_proto=model)
    rng = random.Random(4)
    parts = ["a", "b", "the", "e", "n", "s", " ", "  ", "▁", "é", "日本", "🙂", "\n", "\t", "<0x0A>", "<s>", "</s>", "ing", "xxxxx", "\u0000", "1", "!!", "https://", "ﬁ", "́"]
    texts = ["", " ", "   ", "▁", "naïve  café\n", "x" * 3000, "ab" * 2000 + " end ", "​", *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000))]
    for _ in range(2):  # the second time from memory
        assert [codec.encode(t) for t in texts] == library.encode(texts)
    small = merge_pieces.PieceCodec(model, capacity=3)
    small.tracker.capacity = 10
    assert [small.encode(t) for t in texts[:600]] == library.encode(texts[:600])


def test_every_short_text_of_a_tricky_vocabulary():
    """Backtracking and merging agree on all texts of three letters, with pieces that can't be built and unknown characters."""
    from itertools import product

    rng = random.Random(9)
    for _ in range(25):
        pieces = ["".join(rng.choices("abc", k=rng.randint(2, 4))) for _ in range(8)]
        scores = {p: -float(k) for k, p in enumerate(dict.fromkeys(["a", "b", *pieces]))}
        tracker = merge_pieces.Backtracker(scores)
        for n in range(8):
            for letters in product("abc", repeat=n):
                text = "".join(letters)
                assert tracker.split(text) == merge_pieces.merge(text, scores), (scores, text)


def test_trained_models_of_other_kinds(model):
    """User-defined pieces, unknown ids without bytes, spaces behind words, another normaliser; other model types are refused."""
    from sentencepiece import sentencepiece_model_pb2 as messages

    def changed(f):
        proto = messages.ModelProto.FromString(model)
        f(proto)
        return proto.SerializeToString()

    def own(proto):
        for piece in ("tion", "wörd", "wör"):
            proto.pieces.add(piece=piece, score=0.0, type=messages.ModelProto.SentencePiece.USER_DEFINED) if piece != "tion" else [setattr(p, "type", messages.ModelProto.SentencePiece.USER_DEFINED) for p in proto.pieces if p.piece == piece]

    def no_bytes(proto):
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == messages.ModelProto.SentencePiece.BYTE:
                p.type = messages.ModelProto.SentencePiece.CONTROL

    def tidy(proto):
        proto.normalizer_spec.remove_extra_whitespaces = True
        proto.normalizer_spec.add_dummy_prefix = False

    texts = ["the wörds in motions tion", "日本 🙂🙂 x🙂", "  a   b  ", "wörwörd nation", ""]
    for f in (own, no_bytes, tidy):
        proto = changed(f)
        assert [merge_pieces.PieceCodec(proto).encode(t) for t in texts] == SentencePieceProcessor(model_proto=proto).encode(texts), f.__name__
    for f in (lambda p: setattr(p.trainer_spec, "model_type", messages.TrainerSpec.UNIGRAM), lambda p: setattr(p.pieces[500], "type", messages.ModelProto.SentencePiece.UNUSED)):
        with pytest.raises(ValueError):
            merge_pieces.PieceCodec(changed(f))


def test_encoded_documents(spark, model):
    library = SentencePieceProcessor(model_proto=model)
    texts = [None, "", "\n ", "one two", "one two", "longer text 🙂 " * 20_000, "▁<0x0A>"]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "one two", None, 1)], "doc_id long, text string, decoded string, ids int")
    out = merge_pieces.encode_documents(docs, model).orderBy("doc_id").collect()
    assert len(out) == len(texts) + 1
    for r, t in zip(out, ["one two", *texts], strict=True):
        want = library.encode(t or "") + [library.eos_id()]
        assert r.ids == want and r.decoded == library.decode(want)
    assert merge_pieces.encode_documents(docs.filter("false"), model).count() == 0
    assert merge_pieces.encode_documents(docs, model, end=False, decode=False).columns == ["doc_id", "text", "decoded", "ids"]


def test_piece_query_equals_library(spark, sf_dir, model):
    library = SentencePieceProcessor(model_proto=model)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.queries()["op12_merge_pieces"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id]) + [library.eos_id()]
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))


# ---------------------------------------------------------------- 13: hard negatives


def plain_negatives(rows, chosen, positives=5, negatives=10, low=30, high=90):
    kept = [(i, label, v) for i, label, v in kept_of([r for r in rows if r[0] is not None and r[2] is not None], 256, 52)]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in kept if chosen(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in kept)
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:positives]:
            found = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(i, j, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("negatives", "room", "block"), [(10, 64, 1024), (3, 0, 2), (1, 1, 3), (200, 0, 1024)])
def test_negatives_equal_brute_force(spark, monkeypatch, negatives, room, block):
    monkeypatch.setattr(radix_mining, "ROOM", room)
    rows = odd_vectors(90)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(tuple(r) for r in radix_mining.mine(df, "id % 30 = 0", negatives=negatives, block=block).collect())
    want = plain_negatives(rows, lambda i: i % 30 == 0, negatives=negatives)
    assert got == want and len(want) > 20


def test_ties_are_settled_by_digits_of_ids(spark, monkeypatch):
    """Thousands of rows with one score, with ids far apart and below zero: the first of them by id."""
    monkeypatch.setattr(radix_mining, "ROOM", 2)
    rng = random.Random(2)
    ids = rng.sample(range(-(1 << 40), 1 << 40), 3000)
    rows = [(0, [1.0, 0.0], 1, "x", 1), (1, [1.0, 0.5], 1, "x", 1)] + [(2 * i + 3, [0.5, 0.25], 2, "x", 1) for i in ids] + [(5, [0.5, 0.1], 2, "x", 1)] * 30
    got = sorted(tuple(r) for r in radix_mining.mine(spark.createDataFrame(rows, VECTORS).repartition(4), "id = 0").collect())
    assert got == plain_negatives(rows, lambda i: i == 0) and len(got) == 10


def test_equal_rows_in_great_number(spark, monkeypatch):
    """A third of all rows has one id and one vector: of these no more than asked for are gathered from a task."""
    monkeypatch.setattr(radix_mining, "ROOM", 0)
    rows = [(0, [1.0, 0.0], 1, "x", 1), (1, [1.0, 0.5], 1, "x", 1)] + [(7, [0.5, 0.25], 2, "x", 1)] * 500 + [(9 + i, [0.25, 0.0], 2, "x", 1) for i in range(50)]
    got = sorted(tuple(r) for r in radix_mining.mine(spark.createDataFrame(rows, VECTORS).repartition(4), "id = 0").collect())
    assert got == plain_negatives(rows, lambda i: i == 0) and {r[3] for r in got} == {7}


def test_digits_count_the_key():
    w = radix_mining.Windows(np.array([0]), np.array([-5]), np.array([70_000]), 3, 1, -3, 4)
    score, ids = np.array([70_000, 69_000, -5, 4_464]), np.array([-3, 4, 9, 250])
    assert w.digits(0, score, ids).tolist() == [0, 0, 1, 1]
    w.learn({0: (1, 2, 90)})
    assert (w.level[0], w.score[0], w.before[0], bool(w.open[0])) == (1, 1, 2, True)
    assert w.digits(0, score, ids).tolist() == [-1, -1, 70_005 >> 8 & 255, 0]
    assert w.taken(0, score, ids).tolist() == [True] * 4
    w.learn({})
    assert not w.open[0] and w.whole[0]


def test_fixed_point_rows(spark):
    rows, dimension = fixed_point.fixed(spark.createDataFrame(odd_vectors(), VECTORS), 1024)
    assert dimension == 8
    got = sorted(((r.id, r.label, r.v) for r in rows.collect()), key=str)
    assert got == sorted(kept_of(odd_vectors(), 1024), key=str)
    assert rows.filter(F.col("id") == 9).count() == 0
