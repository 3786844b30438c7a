import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from liasse.llm import phrases as ph
from tests.llm.odd import odd_documents


def pieces(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", t)]


def brute(rows, least, top, longest=3):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for ws in pieces(text):
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i : i + k])] += 1
    out = []
    for lang in n:
        found = []
        for (g_lang, p), a in f.items():
            if g_lang != lang or len(p) < 2 or a < least:
                continue
            inside = [q for (x, q), b in f.items() if x == lang and len(q) > len(p) and b >= least and 100 * b >= 50 * a
                      and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if inside:
                continue
            score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(seed, rows=120):
    rng = np.random.default_rng(seed)
    words = ["La", "maison", "de", "la", "Cour", "é", "Straße", "x", "a", "b", "İ"]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".\n", " . ", ";", "!? "]
    out = []
    for _ in range(rows):
        text = "".join(words[i] + marks[j] for i, j in zip(rng.integers(0, len(words), rng.integers(0, 60)), rng.integers(0, len(marks), 60)))
        out.append((text, ["fr", "de", None, "und"][rng.integers(0, 4)]))
    shared = "au nom de la loi et du peuple réuni, " * 3
    return out + [(shared + out[i][0] + shared, "fr") for i in range(30)] + [(None, "fr"), ("", None), (" \t ", "zz"), ("...", "fr"), ("x", None)]


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_phrases_as_by_brute_force(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for period in (1, 2, 16):
        assert rows_of(ph.collocations(df, least=3, top=40, period=period)) == brute(rows, 3, 40)
    assert rows_of(ph.collocations(df, least=4, top=1000, longest=2)) == brute(rows, 4, 1000, 2)
    assert rows_of(ph.collocations(df, least=4, top=None, longest=4, period=3)) == brute(rows, 4, 10**6, 4)


def test_each_gram_counts_once_in_the_dictionary(spark):
    rows = made(2, 40)
    chunks = ph.dictionary(spark.createDataFrame(rows, "text string, lang string"), period=2)
    totals = {r["lang"]: r["n"] for r in chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n")).collect()}
    want = Counter()
    for t, lang in rows:
        want[lang or "und"] += sum(map(len, pieces(t)))
    assert totals == {k: v for k, v in want.items() if v}
    assert chunks.filter("n > 20").count() > 0  # shared passages give equal chunks


def test_long_rows_are_cut_as_short_ones(monkeypatch):
    texts = pa.array([t + "\n" for t, _ in made(3, 30) if t] + ["wort " * 500 + "\n", "\n", "ende\n"])
    cut = lambda: sorted((int(r), c, int(o)) for rows, chunks, own in ph.row_chunks(texts, 2, 3) for r, c, o in zip(rows, chunks.to_pylist(), own))
    whole = cut()
    for piece in (8, 64):
        monkeypatch.setattr(ph, "PIECE", piece)
        assert cut() == whole


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    grams = spark.createDataFrame([("a", 1, "x", big + 7), ("a", 1, "y", big + 11), ("a", 2, "x y", big)], "lang string, size int, phrase string, f long")
    (r,) = ph.scored(grams).collect()
    assert r["score"] == 1_000_000 * big * big // ((big + 7) * (big + 11))


def test_the_bit_table_lets_frequent_parts_pass(spark):
    grams = spark.createDataFrame([("fr", f"w{i} é{i}") for i in range(500)], "lang string, phrase string")
    table = ph.bit_table(grams, 2)
    chunk = pa.array(["w1 é1 w2 é2\n", "w3 é4 w5\n"])
    row, found = ph._grams(chunk, np.array([4, 3]), ph._lang_hashes(pa.array(["fr", "fr"])), 3, table)
    assert not len(found) and 500 <= np.unpackbits(table).sum() + 5
    more = ph.bit_table(spark.createDataFrame([("fr", "w1 é1"), ("fr", "é1 w2"), ("de", "w3 é4"), ("fr", "é4 w5")], "lang string, phrase string"), 2)
    row, found = ph._grams(chunk, np.array([4, 3]), ph._lang_hashes(pa.array(["fr", "fr"])), 3, more)
    assert found.to_pylist() == ["w1 é1 w2"]


def test_odd_input(spark):
    docs = odd_documents(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect() if len(r["text"] or "") < 10_000]
    few = docs.filter("text is null or length(text) < 10000")
    assert rows_of(ph.collocations(few, least=2)) == brute(rows, 2, 2000)
    found = ph.collocations(docs, least=2)
    assert found.count() > 0 and found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert ph.collocations(docs.filter(F.lit(False))).count() == 0
