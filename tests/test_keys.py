"""Keys that repeat, look alike or are missing."""

import pytest
from pyspark.sql import functions as F

from liasse.operators import context, dense, entities, evidence, lexical, segment
from liasse.plans.ordering import page_block, running_total
from liasse.sources import corpus


def test_case_names_stay_text(spark, tmp_path):
    names = ["001", "1", "1.0", "1e3", "2021-03-12"]
    df = spark.createDataFrame([(c, "s", i, "t") for i, c in enumerate(names)], "case_id string, source string, chunk_ord bigint, text string")
    corpus.write_corpus({"chunks": df.withColumn("batch", F.lit("007"))}, str(tmp_path))
    back = corpus.read_table(spark, str(tmp_path), "chunks")
    assert sorted((r.case_id, r.batch) for r in back.collect()) == sorted((c, "007") for c in names)
    assert [r.chunk_ord for r in corpus.read_table(spark, str(tmp_path), "chunks", ["001"]).collect()] == [0]


def test_equal_query_ids_of_two_cases(spark):
    chunks = spark.createDataFrame([(c, i, t) for c in "AB" for i, t in enumerate(["le chat noir", "le chien", "un chat"])], "case_id string, chunk_ord bigint, text string")
    q = spark.createDataFrame([(1, "A", "chat noir"), (1, "B", "chien")], "query_id bigint, case_id string, text string")
    got = {(r.case_id, r.chunk_ord): r["rank"] for r in lexical.bm25(chunks, q, limit=5).collect()}
    assert got == {("A", 0): 1, ("A", 2): 2, ("B", 1): 1}


def test_a_word_of_every_chunk_still_finds_them(spark):
    chunks = spark.createDataFrame([("c", i, f"bonjour le dossier {i}") for i in range(3)], "case_id string, chunk_ord bigint, text string")
    q = spark.createDataFrame([(1, "c", "bonjour")], "query_id bigint, case_id string, text string")
    assert [r.chunk_ord for r in lexical.bm25(chunks, q).orderBy("rank").collect()] == [0, 1, 2]


def test_citations_stay_in_their_case(spark):
    chunks = spark.createDataFrame([("A", "f", 3), ("B", "f", 3)], "case_id string, source string, chunk_ord bigint")
    answers = spark.createDataFrame([(1, 1, "A", "voir [source: f, chunk 3] et [source: f, chunk 9]")], "conv_id int, turn int, case_id string, text string")
    assert [(r.case_id, r.chunk_ord, r.resolved) for r in context.resolve_citations(answers, chunks).orderBy("cite_no").collect()] == [("A", 3, True), ("A", 9, False)]
    with pytest.raises(ValueError):
        context.resolve_citations(answers.drop("case_id"), chunks)


def test_pages_that_come_twice_stay_two(spark):
    pages = spark.createDataFrame([("c", "f", 1, "a"), ("c", "f", 1, "a"), ("c", "f", 2, "b")], "case_id string, source string, page int, text string")
    assert segment.number_units(pages).count() == 3


def test_running_total_keeps_rows_without_a_place(spark):
    df = spark.createDataFrame([("k", 1, 5), ("k", None, 7), ("k", 600, 2)], "k string, page int, n int")
    got = running_total(df, ["k"], ["page"], F.col("n"), page_block("page"), "before").collect()
    assert {(r.page, r.before) for r in got} == {(1, 0), (600, 5), (None, 7)}


def test_rows_without_a_person_are_counted(spark):
    rows = [("c", p, "phone", "+33611111111", "s", i, "texte", True, 0) for p in (1, None) for i in range(2)]
    occ = spark.createDataFrame(rows, "case_id string, person_id bigint, kind string, value string, source string, chunk_ord bigint, snippet string, linked boolean, start int")
    assert {r.base_class for r in evidence.classify_occurrences(occ).collect()} == {"charge"}


def test_names_are_masked_in_one_go(spark):
    df = spark.createDataFrame([("ligne au nom de jean person", ["jean person", "person", "zz"])], "_folded string, terms array<string>")
    assert df.select(entities.mask_names("_folded", "terms")).first()[0] == f"ligne au nom de {entities.NAME_TOKEN}"


def test_scores_come_in_tiles(monkeypatch):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(30, 4)), rng.normal(size=(50, 4))
    whole = pd.concat(dense._best(np.arange(30), q, "c", np.arange(50)[::-1].copy(), v, 5))
    monkeypatch.setattr(dense, "TILE_BYTES", 8 * 50 * 7)
    parts = list(dense._best(np.arange(30), q, "c", np.arange(50)[::-1].copy(), v, 5))
    assert len(parts) == 5 and pd.concat(parts).reset_index(drop=True).equals(whole.reset_index(drop=True))


def test_joins_agree_on_rows_that_come_twice(spark):
    from liasse.plans.matching import contains_join, word_join

    texts = spark.createDataFrame([("c", 1, "le chat noir dort"), ("c", 1, "le chat noir dort"), ("c", 2, "la chatte"), ("d", 1, "chat")],
                                  "case_id string, chunk_ord bigint, text string")
    pats = spark.createDataFrame([("c", "chat"), ("c", "noir dort"), ("c", "le"), ("c", "dort"), ("d", "zz")], "case_id string, pat string")
    got = [sorted(map(tuple, contains_join(texts, pats, ["case_id"], "text", "pat", ["case_id", "chunk_ord"], small).collect())) for small in (None, False)]
    assert got[0] == got[1] and sum(r[1] == 1 for r in got[0]) == 8
    words = [sorted(map(tuple, word_join(texts, pats, ["case_id"], "text", "pat", ["case_id", "chunk_ord"], small).select(
        "case_id", "chunk_ord", "text", "pat").collect())) for small in (True, False)]
    assert words[0] == words[1] and len(words[0]) == 6


def test_key_joins_against_brute_force(spark):
    """Strings of every length, with accents, inside and across windows, in several cases; few rows pass the bit table."""
    import random

    from liasse.plans import keys as filters
    from liasse.plans.matching import contained_ids, contains_join, word_join, words

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé d1") for _ in range(n))
    texts = [(rng.choice("cde"), i, word(rng.choice([0, 1, 3, 4, 7, 40, 90]))) for i in range(300)] + [("c", 300, None), (None, 301, "abcdabcd"), ("c", 302, "x" * 300_000 + "jean dupont17")]
    pats = {(rng.choice("cde"), word(rng.randint(1, 9))) for _ in range(150)} | {("c", "x" * n) for n in range(1, 20)}
    pats |= {(c, t[i:i + n]) for c, _, t in texts[:300] for n in (2, 5, 8, 12, 13, 16, 21) for i in (0, len(t) - n) if i >= 0}
    pats = [(c, k, p) for k, (c, p) in enumerate(sorted(pats))] + [("c", 9000, "jean dupont1"), ("c", 9001, "jean dupont17"), ("c", 9002, "jean dupont17"), (None, 9003, "abcd"), ("c", 9004, None), ("c", 9005, "")]
    df = spark.createDataFrame(texts, "case_id string, chunk_ord bigint, text string")
    pf = spark.createDataFrame(pats, "case_id string, id bigint, pat string")
    want = {(i, k) for c, i, t in texts for pc, k, p in pats if c is not None and c == pc and t and p and p in t}
    got = [(r.chunk_ord, r.id) for r in contains_join(df, pf, ["case_id"], "text", "pat", ["case_id", "chunk_ord"], False).select("chunk_ord", "id").collect()]
    assert len(got) == len(want) and set(got) == want
    rows = contained_ids(df, pf, ["case_id"], "text", "pat", "id", ["case_id", "chunk_ord"], "ids", False).collect()
    assert len(rows) == len(texts) and {(r.chunk_ord, k) for r in rows for k in r.ids} == want

    told = word_join(df, pf, ["case_id"], "text", "pat", ["case_id", "chunk_ord"], False).select("chunk_ord", "id").collect()
    every = df.withColumn("w", F.explode(words(F.lower("text")))).join(pf.withColumnRenamed("pat", "w"), ["case_id", "w"]).select("chunk_ord", "id").collect()
    assert sorted(map(tuple, told)) == sorted(map(tuple, every)) and told

    names = spark.range(2000).select(F.lit("c").alias("case_id"), F.concat(F.lit("jean dupont"), F.col("id").cast("string")).alias("pat"))
    pages = spark.range(1000).select(F.lit("c").alias("case_id"), F.col("id").alias("chunk_ord"), F.concat(
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 4), F.when(F.col("id") % 10 == 0, F.concat(F.lit(" jean dupont"), F.col("id").cast("string")))
        .otherwise("")).alias("text"))
    keyed = filters.own_keys(names, ["case_id"], "pat")
    passed = filters.candidates(pages, keyed, ["case_id"], "text", "pat").count()
    assert 100 <= passed <= 600  # 1 000 texts of 256 characters and more; 100 of them hold names, each up to three
