import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from liasse.llm import digest as dg
from liasse.llm import shingles as sh
from tests.llm.odd import LONG, odd_documents

RANKS = dg.ranked(np.random.default_rng(0).integers(0, 10_000, dg.CLASSES))


def plain_class(window):
    total = sum(round(c * math.log2(c) * dg._UNIT) for c in Counter(window).values())
    most = round(dg.WINDOW * math.log2(dg.WINDOW) * dg._UNIT)
    return (most - total) * (dg.CLASSES - 1) // most


def plain_hash(window):
    h = 0
    for i, b in enumerate(window):
        h = (h * 0x100000001B3 + int(sh._BYTE[b]) * int(dg._MULT[i])) % 2**64
    return int(sh.mix(np.array([h], np.uint64))[0])


def brute(text):
    raw = text.encode()
    if not raw:
        return ""
    n = len(raw) - dg.WINDOW + 1
    if n <= 0:
        hashes = [int.from_bytes(hashlib.md5(raw).digest()[:8], "little")]
    else:
        classes = [plain_class(raw[i : i + dg.WINDOW]) for i in range(n)]
        key = [(int(RANKS[c]), i) for i, c in enumerate(classes)]
        votes = Counter(min(key[i : i + dg.RUN])[1] for i in range(n - dg.RUN + 1))
        chosen = sorted(i for i, v in votes.items() if v >= dg.VOTES and classes[i] >= dg.EVEN) or [min(key)[1]]
        hashes = [plain_hash(raw[i : i + dg.WINDOW]) for i in chosen]
    hashes = list(dict.fromkeys(hashes))
    filters = []
    for at in range(0, len(hashes), dg.FEATURES):
        bits = np.zeros(dg.BITS, np.uint8)
        for h in hashes[at : at + dg.FEATURES]:
            for k in range(dg.HASHES):
                bits[(h >> (11 * k)) % dg.BITS] = 1
        filters.append(np.packbits(bits))
    return dg.written(np.stack(filters))


def plain_like(a, b):
    def one(x, y):
        total = weight = 0
        for f in x:
            best = 0.0
            for g in y:
                p, q, e = int(f.sum()), int(g.sum()), int((f & g).sum())
                chance, most = p * q / dg.BITS, min(p, q)
                floor = chance + dg.SIGMA * math.sqrt(chance * (1 - p / dg.BITS) * (1 - q / dg.BITS))
                best = max(best, 1.0 if e >= most else (e - floor) / (most - floor) if floor < most else 0.0)
            total, weight = total + best * int(f.sum()), weight + int(f.sum())
        return total / weight

    if not a or not b:
        return float(a == b)
    a, b = ([np.unpackbits(f) for f in dg.read(x)] for x in (a, b))
    if len(a) == len(b):
        return (one(a, b) + one(b, a)) / 2
    return one(a, b) if len(a) < len(b) else one(b, a)


def texts(seed=1, n=60):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 12))) for _ in range(400)] + ["é", "中文", "\U0001f600"]
    made = [" ".join(words[i] for i in rng.integers(0, len(words), rng.integers(1, 400))) for _ in range(n)]
    return made + ["", "x", "a" * 31, "b" * 32, "c" * 500, "ab" * 300, made[0][:40], made[1][:63], made[2][:64], made[3][:80]]


def test_fingerprints_as_by_brute_force():
    some = texts()
    assert [dg.written(f) for f in dg.fingerprints(some, RANKS)] == [brute(t) for t in some]


def test_long_texts_in_pieces(monkeypatch):
    long = " ".join(texts(2, 30))
    whole = dg.written(dg.fingerprints([long], RANKS)[0])
    assert whole == brute(long)
    monkeypatch.setattr(dg, "PIECE", 1000)
    assert dg.written(dg.fingerprints([long], RANKS)[0]) == whole
    even = "ab" * 3000
    assert dg.written(dg.fingerprints([even], RANKS)[0]) == brute(even)


def test_likeness_as_by_brute_force():
    prints = [dg.written(f) for f in dg.fingerprints(texts(3, 20) + [" ".join(texts(4, 20))], RANKS)]
    for a in prints[::2]:
        for b in prints:
            assert abs(dg.likeness(dg.read(a), dg.read(b)) - plain_like(a, b)) < 1e-9
            assert dg.likeness(dg.read(a), dg.read(b)) == dg.likeness(dg.read(b), dg.read(a))
        assert dg.likeness(dg.read(a), dg.read(a)) == 1


def test_many_filters_in_blocks(monkeypatch):
    a, b = dg.fingerprints([" ".join(texts(5, 60)), " ".join(texts(6, 50))], RANKS)
    whole = dg.likeness(a, b)
    monkeypatch.setattr(dg, "BLOCK", 2)
    assert abs(dg.likeness(a, b) - whole) < 1e-12


def expected(rows):
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + u[:half]
        f, g = brute(t), brute(changed)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), f, g, round(plain_like(f, g), 9), round(plain_like(f, brute(u)), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))
                   for r in df.collect()), key=str)


def test_next_documents_over_all_ranges(spark):
    rows = [(i * 7 % 71, t) for i, t in enumerate(texts(7, 61))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(dg.compared_with_next(df, ranks=RANKS)) == expected(sorted(rows))
    got = dg.compared_with_next(df.filter("doc_id = 3"), ranks=RANKS).collect()
    assert len(got) == 1 and got[0]["near_next"] == 1


def test_rarity_counts_every_window(spark):
    some = texts(8, 20)
    df = spark.createDataFrame([(t,) for t in [*some, None]], "text string").repartition(3)
    seen = np.zeros(dg.CLASSES, np.int64)
    for t in some:
        raw = t.encode()
        for i in range(len(raw) - dg.WINDOW + 1):
            seen[plain_class(raw[i : i + dg.WINDOW])] += 1
    assert (dg.rarity(df) == dg.ranked(seen)).all()


def test_copies_are_alike_and_half_copies_half(spark, sf):
    rows = dg.compared_with_next(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    large = [r for r in rows if r["n_chars"] > 500]
    assert 0.3 < sum(r["near_edited"] for r in large) / len(large) < 0.7
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert sum(r["near_edited"] > r["near_next"] for r in large) > 0.9 * len(large)


def test_odd_input(spark):
    docs = odd_documents(spark)
    got = dg.compared_with_next(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[3][0]["fingerprint"] == by[4][0]["fingerprint"] == "" and by[3][0]["near_next"] == 1
    assert by[6][0]["fingerprint"] == by[7][0]["fingerprint"] and by[6][0]["near_next"] == 1
    assert by[8][0]["fingerprint"] == by[8][1]["fingerprint"] and sorted(r["near_next"] for r in by[8])[1] == 1
    assert by[9][0]["n_chars"] == len(LONG) and len(dg.read(by[9][0]["fingerprint"])) > 5
    assert len(by[None]) == 2
    assert dg.compared_with_next(docs.filter(F.lit(False))).count() == 0
