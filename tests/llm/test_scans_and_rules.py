import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from liasse.llm import licenses, rules, secrets, sharding
from tests.llm.odd import odd_documents

KIND = ("assign", "access", "hex", "entropy")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def all_spans(t):
    base = base_spans(t)
    hot = []
    for pattern, _, bits in secrets.CLASSES.values():
        for m in re.finditer(pattern, t):
            if any(re.search(a, m[0]) for a in secrets.ALLOWED) or any(b[0] <= m.start() and b[2] >= m.end() for b in base):
                continue
            piece = m[0].upper() if bits < 3.5 else m[0]
            for i in range(len(piece) - secrets.WINDOW + 1):
                c = collections.Counter(piece[i : i + secrets.WINDOW])
                if -sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in c.values()) >= bits - 1e-7:
                    hot.append((m.start() + i, m.start() + i + secrets.WINDOW))
    joined = []
    for a, b in sorted(hot):
        if joined and joined[-1][1] >= a:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return sorted(base + [(a, 3, b) for a, b in joined if not any(x[0] <= a and x[2] >= b for x in base)])


def written(spans):
    return ",".join(f"{KIND[k]}:{a}:{b}" for a, k, b in spans)


@pytest.mark.parametrize("step, block", [(secrets.STEP, secrets.BLOCK), (2, 3)])
def test_secrets_as_by_brute_force(spark, monkeypatch, step, block):
    monkeypatch.setattr(secrets, "STEP", step)
    monkeypatch.setattr(secrets, "BLOCK", block)
    rnd = random.Random(3)
    bits = ["token=token:abcdefg", "TOKEN = 'x1'", "api-key", "apikey:abc=def", "AKIA" + "Z9" * 8, "AKIA123", "deadbeef" * 4, "0123456789ABCDEF0123CAFE", "é\U0001f600", " ", "\n",
            "a" * 30, "Password : \"p4ss/w0rd+longer\"", "https://host/path", "550e8400-e29b-41d4-a716-446655440000", "example_Qx7Zk29LmPfT3vWb8RyUo", "plainlowercaselettersonlyhere"]
    alphabet = secrets.BASE64
    rows = []
    for i in range(150):
        parts = rnd.choices(bits, k=rnd.randrange(0, 8)) + ["".join(rnd.choices(alphabet[: rnd.choice([16, 40, 66])], k=rnd.randrange(5, 60))) for _ in range(rnd.randrange(3))]
        rnd.shuffle(parts)
        rows.append((i, rnd.choice(["", " ", "\n", "="]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.report(df).collect()}
    for i, t in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(written(base_spans(t)).encode()).hexdigest(), t
        assert got[i]["spans"] == written(all_spans(t)), t
    assert sum(r["n_entropy"] for r in got.values()) > 20
    red = {r["doc_id"]: r["text"] for r in secrets.redacted(df, mark="#").collect()}
    for i, t in rows:
        joined, out, at = [], "", 0
        for a, _, b in all_spans(t):
            if joined and joined[-1][1] >= a:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        for a, b in joined:
            out, at = out + t[at:a] + "#", b
        assert red[i] == out + t[at:]


def test_secrets_of_very_long_texts(spark):
    rnd = random.Random(5)
    run = "".join(rnd.choices(secrets.BASE64, k=1_000_000))
    many = " ".join(f"password = {rnd.randrange(10**9):x}zzzzzz" for _ in range(100_000))
    df = spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in secrets.report(df).collect()}
    assert time.time() - start < 120
    assert got[2]["n_assign"] == 100_000 and got[2]["base_sha256"] == hashlib.sha256(written(base_spans(many)).encode()).hexdigest()
    hot = [tuple(map(int, s.split(":")[1:])) for s in got[1]["spans"].split(",") if s.startswith("entropy")]
    covered = {i for a, b in hot for i in range(a, b)}
    for i in rnd.sample(range(len(run) - secrets.WINDOW), 2000):
        c = collections.Counter(run[i : i + secrets.WINDOW])
        if -sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in c.values()) >= 3.9:
            assert covered.issuperset(range(i, i + secrets.WINDOW))
    red = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    assert red[2] == " ".join(["[secret]"] * 100_000)


def test_secrets_of_odd_input(spark):
    docs = odd_documents(spark)
    got = {r["doc_id"]: r for r in secrets.report(docs).collect()}
    assert got[3]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[11]["spans"] == "assign:0:41,hex:9:41" and got[11]["n_hex"] == 1
    out = secrets.redacted(docs)
    assert out.schema.names == docs.schema.names
    by = {r["doc_id"]: r["text"] for r in out.filter("doc_id is not null").collect()}
    assert by[3] is None and by[11] == "[secret]\" and\nnothing else" and by[4] == ""
    assert secrets.report(docs.filter(F.lit(False))).count() == 0


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    spots = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(spots)


def test_rules_as_by_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice(["a ", "b", "c\n", " ", "\t", "\r", "é", "#", " ", "word ", "x y z ", "\n\n"]) for _ in range(rnd.randrange(0, 120)))) for i in range(200)]
    rows += [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect() if r["doc_id"] and r["doc_id"] != 8]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    got = {r["doc_id"]: r for r in rules.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        r, want = got[i], brute_rules(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r["kept"] or not r["base_failed"])
    assert rules.report(odd_documents(spark).filter(F.lit(False))).count() == 0


def test_policies_and_ablations_follow_from_the_bits(spark):
    book = spark.createDataFrame([(i, f) for i, f in enumerate([0, 0, 1, 2, 3, 4, 5, 64])], "doc_id long, failed long")
    got = {(r["version"], r["rule"]): (r["kept"], r["kept_without"], r["only_this"]) for r in rules.ablations(book, {"a": 3, "b": 5}).collect()}
    assert got == {("a", "few_words"): (4, 6, 2), ("a", "repeated_words"): (4, 5, 1), ("b", "few_words"): (4, 6, 2), ("b", "symbols"): (4, 5, 1)}


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT text"]
    changed = mit.replace("merge", "combine").replace("free of charge", "without charge")
    rows = [(1, "Text.\nReleased under the MIT license!\nMore."), (2, "\n".join(changed.split(", ")) + "\n\nother text"), (3, "released under the terms of this other thing entirely"),
            (4, mit + "\nReleased under the MIT License."), (5, "MIT"), (6, None), (7, "Licensed under the Apache License, Version 2.0.\n" * 500)]
    got = {r["doc_id"]: (r["n_units"], r["licenses"], r["dice"]) for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (1, "MIT", 1.0) and got[3] == (0, "", None) and got[5] == (0, "", None) and got[6] == (0, "", None)
    assert got[2][:2] == (1, "MIT text") and 0.8 <= got[2][2] < 1
    assert got[4] == (3, "MIT,MIT text", 1.0) and got[7] == (2, "Apache-2.0", 1.0)
    docs = odd_documents(spark)
    assert licenses.report(docs).count() == docs.count() and licenses.report(docs.filter(F.lit(False))).count() == 0


def test_bounds_prune_no_match():
    for n in range(1, 60):
        for m in range(1, 60):
            if 2 * min(n, m) / (n + m) >= licenses.LEAST:
                low, high = licenses.bounds(m)
                assert low - 1e-9 <= n <= high + 1e-9


def test_shards_are_exact_and_gapless(spark):
    docs = odd_documents(spark)
    for df, n in ((docs, docs.count()), (spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(5), 1003), (docs.filter(F.lit(False)), 0), (docs.limit(3), 3)):
        rows = sharding.report(df).collect()
        assert len(rows) == n
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        sizes = [len(slots[s]) for s in range(8)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    by = {r["doc_id"]: r for r in sharding.report(docs).collect()}
    assert by[3]["size"] == 1 and by[3]["text_crc32"] == 0
    text = {r["doc_id"]: r["text"] for r in docs.collect()}[12]
    assert by[12]["size"] == len(text.encode()) + 1 and by[12]["text_crc32"] == zlib.crc32(text.encode())


def test_hypergeometric_law():
    rng = np.random.Generator(np.random.PCG64(1))
    good, bad, drawn = 7, 9, 6
    counts = collections.Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(20_000))
    for k in range(7):
        want = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs(counts[k] / 20_000 - want) < 0.012
    many = [sharding.hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(many) - 750) < 5 and 9 < np.std(many) < 19


def test_matrix_sums():
    sizes = [5, 0, 17, 300, 1]
    m = np.array(sharding.matrix(sizes, 8, 3))
    assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()


def test_places_are_uniform(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(4)
    hits = np.zeros(8)
    for seed in range(12):
        rows = sharding.shuffled(df, 8, seed).filter("doc_id < 50").collect()
        for r in rows:
            hits[r["shard"]] += 1
    assert hits.sum() == 600 and abs(hits - 75).max() < 35
