import random
import re
import unicodedata

from pyspark.sql import functions as F

from liasse.functions import text as T


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


def test_fold_equals_unicode_rule(spark):
    samples = ["Élève  ÉTÉ né", "ﬁn … ½", "ÀÇÑÖ ŒUVRE", "ＡＢＣ １２", "é", "İstanbul Ωμέγα", "", "a\t\nb"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
           .orderBy("i").select(T.norm_text(F.col("t"))).collect()]

    def rule(s):
        s = unicodedata.normalize("NFKC", s).lower()
        s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")
        return re.sub(r"\s+", " ", s).strip()

    assert got == [rule(s) for s in samples]


def greedy(sents, size, overlap):
    done, cur, used = [], "", 0
    for s in sents:
        if used + len(s) > size and cur:
            done.append(cur)
            cur = cur[-overlap:].strip() if overlap else ""
            used = len(cur)
        cur = f"{cur} {s}".strip()
        used += len(s) + 1
    return done + ([cur] if cur else [])


def test_packing_covers_every_sentence(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join("x" * rnd.randint(1, 30) + rnd.choice([".", "!", "", " ?"]) for _ in range(rnd.randint(0, 200)))) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, t string")
    for size, overlap in ((800, 120), (100, 0), (50, 20)):
        for r in df.select("i", T.sentences(F.col("t")).alias("s"), T.pack_chunks(T.sentences(F.col("t")), size, overlap).alias("c")).collect():
            assert list(r.c) == greedy(r.s, size, overlap)
            assert all(any(s in c for c in r.c) for s in r.s)


def test_json_fences_truncation(spark):
    assert one(spark, 'Bien sûr : {"a": "1"} voilà', lambda c: T.extract_json(c, "a string"))["a"] == "1"
    assert one(spark, "rien", lambda c: T.extract_json(c, "a string")) is None
    assert one(spark, "{pas du json}", lambda c: T.extract_json(c, "a string")) is None
    assert one(spark, "﻿```md\n# T\nx\n```", T.strip_fences) == "# T\nx"
    assert one(spark, "```\nsans fin", T.strip_fences) == "```\nsans fin"
    long = "x" * 250
    assert one(spark, long, lambda c: T.looks_truncated(c, False)) is True
    assert one(spark, long + ".", lambda c: T.looks_truncated(c, False)) is False
    assert one(spark, "court", lambda c: T.looks_truncated(c, True)) is True
    assert one(spark, "court", lambda c: T.looks_truncated(c, False)) is False
    assert one(spark, "", lambda c: T.looks_truncated(c, False)) is True


def test_small_columns(spark):
    assert one(spark, "N0M et PRÉN0M", T.fix_ocr) == "NOM et PRÉNOM"
    assert one(spark, "Query: déjà", lambda c: T.embed_prefix(c, "query")) == "Query: déjà"
    assert one(spark, "quoi", lambda c: T.embed_prefix(c, "query")) == "query: quoi"
    assert one(spark, "<a href='x'>", T.safe_context) == "&lt;a href=&#x27;x&#x27;&gt;"
    got = one(spark, "J. Dupont; jean dupont, JD | jd", lambda c: T.alias_array(c, F.lit("Jean Dupont")))
    assert list(got) == ["J. Dupont", "JD"]
    assert one(spark, "a" * 500, T.clean_value) == "a" * 450
    assert one(spark, "﷽ ｶﾞ ①", lambda c: T.clean_ws(c, full_nfkc=True)) == unicodedata.normalize("NFKC", "﷽ ｶﾞ ①")


def test_folding_by_table_is_that_by_pattern(spark):
    def strip(s):
        return "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", s)) if unicodedata.category(c) != "Mn")

    def flat(s):
        return re.sub(r"[\t-\r\x1c-\x20]+", " ", "".join(" " if c.isspace() else c for c in s)).strip(" ")

    odd = ["  Été\t\r\n à  Nîmes\x1f. Œuvre « ½ ﬁn » … №3 ™", "été  x　y", "ＡＢＣ １２", "\t", "", "plain  text ", "a\x85b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(T.norm_text(F.col("t"))).collect()] == [flat(strip(t.lower())) for t in odd]
    got = [r[0] for r in df.select(T.sentences(F.col("t"))).collect()]
    assert got[0] == ["Été à Nîmes .", "Œuvre « 1⁄2 fin » .", ".", ".", "No3 TM"] and got[3:6] == [[], [], ["plain text"]]
    value = [r[0] for r in df.select(T.clean_value(F.col("t"))).collect()]
    assert value == [re.sub(r"[\t-\r \x85\xa0  　]+", " ", t).strip(" ") for t in odd]
