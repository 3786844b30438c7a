import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from liasse.llm import minhash
from liasse.llm import shingles as sh
from tests.llm.odd import odd_documents


def plain(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()) + " "


def weights(t):
    return sh.weighted(sh.column_shingles(pa.array([plain(t)]))[0])


def naive(a, b):
    a, b = dict(zip(*map(list, a), strict=True)), dict(zip(*map(list, b), strict=True))
    total = 0.0
    for d in set(a) & set(b):
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b))
    return total


def brute_groups(rows, threshold=0.8):
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    ws = [weights(t) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if ws[i][0].size and ws[j][0].size and minhash.probability_jaccard(ws[i], ws[j]) >= threshold:
                up[top(i)] = top(j)
    out = {}
    for i, t in rows:
        out.setdefault(top(texts.index(t or "")), []).append(i)
    return sorted(sorted(map(str, g)) for g in out.values())


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(str(r["class_id"]), []).append(r["doc_id"])
    return sorted(sorted(map(str, g)) for g in out.values())


def test_probability_jaccard_is_the_defined_sum():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (sh.weighted(rng.integers(0, 15, rng.integers(1, 40)).astype(np.uint64)) for _ in range(2))
        assert abs(minhash.probability_jaccard(a, b) - naive(a, b)) < 1e-9


def test_slots_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**60, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**60, 60).astype(np.uint64), a[:40]])
    wa, wb = sh.weighted(a), sh.weighted(b)
    same = (minhash.signature(*wa, 2048) == minhash.signature(*wb, 2048)).mean()
    assert abs(same - minhash.probability_jaccard(wa, wb)) < 0.05


def test_one_shingle_fills_every_slot():
    assert set(minhash.signature(np.array([7], np.uint64), np.array([3.0]))) == {7}


def test_pieces_don_t_change_hashes(monkeypatch):
    texts = pa.array([plain("ein Wort " * 50), " ", plain("x" * 300 + " y")])
    whole = sh.hashed_words(texts)
    monkeypatch.setattr(sh, "PIECE", 16)
    cut = sh.hashed_words(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_groups_as_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(3000)]
    base = [vocab[i] for i in rng.integers(0, 3000, 120)]
    rows = []
    for i in range(120):  # one large group of copies with 0 to 8 changed words, and texts of their own
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 9)):
            words[k] = vocab[rng.integers(0, 3000)]
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(vocab[k] for k in rng.integers(0, 3000, 40))) for i in range(60)]
    rows += [(300 + i, rows[i % 5][1]) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert groups(minhash.near_duplicates(df)) == brute_groups(rows)


def test_a_spectrum_of_variants_as_by_brute_force(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(4000)]
    base = [vocab[i] for i in rng.integers(0, 4000, 150)]
    rows = []
    for i in range(500):  # from near the first text to far from it
        words = list(base)
        for k in rng.integers(0, 150, int(rng.integers(0, 1 + i // 20))):
            words[k] = vocab[rng.integers(0, 4000)]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_groups(rows)
    assert 20 < len(want) < 480 and groups(minhash.near_duplicates(df)) == want


def test_long_chains_are_one_component(spark):
    pairs = [(f"{i:04d}".encode(), f"{(i * 7 + 7) % 1000:04d}".encode()) for i in range(0, 400)]
    pairs += [(f"{i:04d}".encode(), f"{i + 1:04d}".encode()) for i in range(500, 560)]
    found = minhash.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    assert {bytes(r["node"]): bytes(r["root"]) for r in found} == {n: top(n) for n in list(up)}


def test_odd_input(spark):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = minhash.near_duplicates(docs)
    assert got.count() == len(rows)
    by = {r["doc_id"]: r["class_id"] for r in got.filter("doc_id is not null").collect()}
    assert by[1] == by[2] == 1 and by[6] == by[7] == 6 and by[3] == by[4] == 3 and by[5] == 5 and by[8] == 8
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 3, 5, 6, None, 8, 9, 10, 11, 12]))
    empty = docs.filter(F.lit(False))
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_the_prune_loses_no_more_than_the_bands():
    n, p = minhash.SLOTS, minhash.SIMILARITY
    least = math.ceil(n * (p - minhash.MARGIN) - 1e-9)  # agreeing slots that a pair needs to be verified
    lost = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least))
    assert lost <= (1 - p**minhash.ROWS) ** minhash.BANDS


def test_pairs_within_the_margin_meet(spark):
    sig = np.zeros(512, np.uint8)
    off = sig.copy()
    off[:150] = 1  # agree on 362 of 512 slots
    keys = [b"p", b"x", b"y"]
    buckets = spark.createDataFrame([(0, 5, k, b"p") for k in keys], "no int, band long, node binary, pivot binary")
    near = spark.createDataFrame([(b"x", b"p", 0.79), (b"y", b"p", 0.79)], "a binary, b binary, similarity double")
    roots = spark.createDataFrame([], "node binary, root binary")
    one = spark.createDataFrame([(k, s.view(np.int64).tolist(), [5]) for k, s in zip(keys, (sig, sig, off), strict=True)],
                                "text_key binary, sig array<long>, bands array<long>")
    met = minhash._meetings(buckets, near, roots, one, minhash.SIMILARITY, minhash.MARGIN, minhash.SLOTS).collect()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in met] == [(b"y", b"x")]


def test_ids_join_no_groups(spark):
    own = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, own("a")), (1, own("b")), (2, own("a")), (None, own("c")), (None, own("d")), (None, own("e")), (None, own("e")), (None, own("b"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = minhash.near_duplicates(df).collect()
    assert len(found) == len(rows) and len({bytes(r["root"]) for r in found}) == 5
    assert len({(bytes(r["root"]), bytes(r["text_key"])) for r in found}) == 5
    kept = [tuple(r) for r in minhash.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([rows[i] for i in (0, 1, 3, 4, 5)], key=str)


def test_differing_slots_are_counted(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, 512).astype(np.uint8)
    b = np.where(rng.random(512) < 0.3, rng.integers(0, 256, 512), a).astype(np.uint8)
    df = spark.createDataFrame([(a.view(np.int64).tolist(), b.view(np.int64).tolist())], "a array<long>, b array<long>")
    assert df.select(minhash.differing(F.col("a"), F.col("b"))).first()[0] == int((a != b).sum())


def test_what_texts_have_alone_bounds_their_similarity(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(500)]
    base = [vocab[i] for i in rng.integers(0, 500, 80)]
    texts = {}
    for i in range(60):  # changed, lengthened and cut copies
        words = list(base[: int(rng.integers(40, 81))])
        for k in rng.integers(0, len(words), int(rng.integers(0, 6))):
            words[k] = vocab[rng.integers(0, 500)]
        texts[bytes([255 - i] + [200] * 15)] = plain(" ".join(words + base[: int(rng.integers(0, 30))]))
    df = spark.createDataFrame(list(texts.items()), "text_key binary, _text string").repartition(3)
    got = {bytes(r["node"]): r["odds"] for r in minhash.own_odds(df).collect()}
    held = {k: weights(t) for k, t in texts.items()}
    for k, (keys, w) in held.items():
        others = np.concatenate([v[0] for o, v in held.items() if o != k])
        own = w[~np.isin(keys, others)].sum() / w.sum()
        assert abs(got.get(k, 0.0) - own / (1 - own)) < 1e-9
    for k in held:
        for o in held:
            assert k == o or minhash.probability_jaccard(held[k], held[o]) <= 1 / (1 + got.get(k, 0) + got.get(o, 0)) + 1e-9


def test_texts_with_much_of_their_own_don_t_meet(spark):
    sig = np.zeros(512, np.uint8).view(np.int64).tolist()
    keys = [b"p", *[b"x%d" % i for i in range(40)]]
    buckets = spark.createDataFrame([(0, 5, k, b"p") for k in keys], "no int, band long, node binary, pivot binary")
    near = spark.createDataFrame([(k, b"p", 0.79) for k in keys[1:]], "a binary, b binary, similarity double")
    roots = spark.createDataFrame([], "node binary, root binary")
    one = spark.createDataFrame([(k, sig, [5]) for k in keys], "text_key binary, sig array<long>, bands array<long>")
    # two with little of their own, one that may be linked to the first of them only, others that can't be linked at all
    odds = spark.createDataFrame([(b"x1", 0.05), (b"x2", 0.22), *[(k, 0.3) for k in keys[4:]]], "node binary, odds double")
    met = minhash._meetings(buckets, near, roots, one, minhash.SIMILARITY, minhash.MARGIN, minhash.SLOTS, odds).collect()
    assert {(bytes(r["a"]), bytes(r["b"])) for r in met} == {(b"x1", b"x0"), (b"x2", b"x0")}
