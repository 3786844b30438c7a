import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from liasse.operators import context, dense, digests, fusion, lexical, signals
from liasse.plans.ordering import capped_concat, page_block, running_total
from liasse.plans.search import hybrid_search


def test_bm25_by_hand(spark):
    texts = ["le chat dort", "le chien dort le jour", "le chat et le chien", "le le"]
    df = spark.createDataFrame([("c", "s", i, i, t) for i, t in enumerate(texts)], "case_id string, source string, page int, chunk_ord bigint, text string")
    q = spark.createDataFrame([(1, "c", "Le chat chat")], "query_id bigint, case_id string, text string")
    toks = [t.split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    dfs = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - c + .5) - math.log(c + .5) for w, c in dfs.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (.25 * mean if v < 0 else v) for w, v in idf.items()}
    want = {}
    for i, t in enumerate(toks):
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (.25 + .75 * len(t) / avg)) for w in ["le", "chat", "chat"])
        if {"le", "chat"} & set(t):
            want[i] = round(s, 6)
    assert {r.chunk_ord: r.score for r in lexical.bm25(df, q).collect()} == want


def test_mmr_equals_plain_greedy(spark):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(40, 8)), rng.normal(size=8)
    v = spark.createDataFrame([("c", i, [float(a) for a in r]) for i, r in enumerate(x)], "case_id string, chunk_ord bigint, embedding array<float>")
    qv = spark.createDataFrame([(1, "c", [float(a) for a in q])], "query_id bigint, case_id string, embedding array<float>")
    params = spark.createDataFrame([(1, "c", 10, 0.7)], "query_id bigint, case_id string, top_k int, mmr_lambda double")
    cands = dense.dense(v, qv, 30)
    got = [r.chunk_ord for r in dense.mmr(cands, v, qv, params).orderBy("rank").collect()]
    xn, qn = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q)
    pool = [r.chunk_ord for r in cands.orderBy("rank").collect()]
    chosen = []
    while len(chosen) < 10:
        best = max((c for c in pool if c not in chosen), key=lambda c: .7 * xn[c] @ qn - .3 * max((xn[c] @ xn[s] for s in chosen), default=0))
        chosen.append(best)
    assert got == chosen


def test_dense_skips_other_dimensions_and_blocks_agree(spark):
    rng = np.random.default_rng(5)
    rows = [("c", i, [float(a) for a in rng.normal(size=8)]) for i in range(100)] + [("c", 999, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "case_id string, chunk_ord bigint, embedding array<float>")
    qv = spark.createDataFrame([(k, "c", rows[k][2]) for k in range(5)], "query_id bigint, case_id string, embedding array<float>")
    one = {(r.query_id, r.chunk_ord, r.rank) for r in dense.dense(v, qv, 7).collect()}
    two = {(r.query_id, r.chunk_ord, r.rank) for r in dense.dense(v, qv, 7, small=False).collect()}
    assert one == two and len(one) == 35 and all(o != 999 for _, o, _ in one)


def test_rrf_boost_repeats_the_list(spark):
    ranks = spark.createDataFrame([(1, "c", o, r) for r, o in enumerate([10, 11, 12], 1)], "query_id bigint, case_id string, chunk_ord bigint, rank int")
    got = {r.chunk_ord: r.score for r in fusion.rrf({"identity": ranks}).collect()}
    want = {o: 1 / (60 + r) + 1 / (60 + r + 3) for r, o in enumerate([10, 11, 12], 1)}
    assert all(abs(got[o] - want[o]) < 1e-8 for o in want)


def test_intents(spark):
    q = spark.createDataFrame([(1, "c", "Liste tous les PV"), (2, "c", "Où est-il né le 3 mars ?"), (3, "c", "bonjour"), (4, "c", "")], "query_id bigint, case_id string, text string")
    got = {r.query_id: (r.is_identity, r.is_inventory, r.top_k, r.n_candidates, r.max_per_source) for r in signals.retrieval_params(q).collect()}
    assert got[1] == (False, True, 36, 144, 0) and got[2] == (True, False, 12, 72, 3) and got[3][:2] == (False, False) and got[4][:2] == (False, False)


def test_search_is_whole_at_any_partition_count(spark, sf):
    from liasse.workload import bindings as b
    q, docs = b.queries(spark, sf), b.documents(spark, sf)
    runs = []
    for parts in (1, 8):
        got = hybrid_search(docs.repartition(parts), q, shape="budgeted", total=5000)
        runs.append(sorted((r.query_id, r.rank, r.chunk_ord, len(r.text)) for r in got.collect()))
        totals = Counter()
        for r in runs[-1]:
            totals[r[0]] += r[3]
        assert max(totals.values()) <= 5000
    assert runs[0] == runs[1]


def test_hot_key_totals_and_caps(spark):
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id",
                               F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = running_total(df, ["k"], ["id"], F.lit(1), page_block("id", 100), "pos").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.id):
        assert r.pos == by.get(r.k, 0)
        by[r.k] = r.pos + 1
    assert sum(by.values()) == n
    for cap in (1, 50, 51, 1000):
        texts = {r.k: r.text for r in capped_concat(df, ["k"], ["id"], page_block("id", 100), "text", cap).collect()}
        whole = "\n\n".join(f"t{i}" for i in range(0, n, 3))
        assert texts["hot"] == whole[:cap]


def test_block_packing_is_greedy_at_any_segment_size(spark):
    rnd = random.Random(1)
    lens = [rnd.choice([1, 5, 30, 300, 700]) for _ in range(400)]
    df = spark.createDataFrame([("c", i, "x" * n) for i, n in enumerate(lens)] + [("c", 1000, "  ")], "case_id string, chunk_ord bigint, text string")
    want, cur, block = [], 0, 0
    for n in lens:
        if cur and cur + n + 2 > 500:
            block, cur = block + 1, 0
        cur += n + 2
        want.append(block)
    for seg, fan in ((3, 2), (7, 3), (50, 64), (10_000, 2)):
        got = {r.chunk_ord: r.block_id for r in digests.pack_blocks(df, 500, seg, fan).collect()}
        assert [got[i] for i in range(len(lens))] == want and 1000 not in got


def test_history_cuts_only_a_first_oversized_turn(spark):
    turns = [(1, 0, "user", "a" * 400), (1, 1, "assistant", "b" * 400), (2, 0, "user", "c" * 9000), (3, 0, "system", "  ")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    new = {(r.conv_id, r.turn): r.block for r in context.history_window(df, 150).collect()}
    assert set(new) == {(1, 1), (2, 0)} and new[2, 0] == "Utilisateur : " + "c" * ((150 - 3) * 4) + "\n"
    old = {(r.conv_id, r.turn) for r in context.history_window(df, 150, newest_first=False).collect()}
    assert old == {(1, 0)}


def test_neighbors_keep_base_first(spark):
    chunks = spark.createDataFrame([("c", i, f"s{i % 2}", f"t{i}") for i in range(10)], "case_id string, chunk_ord bigint, source string, text string")
    hits = spark.createDataFrame([(1, "c", 4, 1), (1, "c", 0, 2)], "query_id bigint, case_id string, chunk_ord bigint, rank int")
    params = spark.createDataFrame([(1, "c", 2, 0)], "query_id bigint, case_id string, top_k int, max_per_source int")
    got = [r.chunk_ord for r in fusion.expand_neighbors(hits, chunks, params).orderBy("rank").collect()]
    assert got == [4, 0, 3, 5]


def test_parts_make_up_the_whole(spark):
    from liasse.plans.ordering import parted_concat

    texts = ["a" * 7, "", "bb", None, "c" * 40, "d", "e" * 9]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)], "k string, id int, text string")
    whole = "\n\n".join(t for t in texts if t)
    for size in (1, 10, 1000):
        parts = parted_concat(df, ["k"], ["id"], page_block("id", 2), "text", size).orderBy("part").collect()
        assert "\n\n".join(r.text for r in parts) == whole and (size > 10 or len(parts) > 2)


def template_case(spark):
    rng = random.Random(4)
    first = ["jean", "marie", "paul"]
    rows = [("c" if i % 3 else "e", f"IDENTITE_{i % 11}.pdf" if i % 4 == 0 else f"dossier_{i % 7}", i, f"{' '.join(rng.choices(['audition', 'de', 'le', 'né', 'rien', 'vu'], k=rng.randint(1, 12)))} {rng.choice(first)} nom{i % 60}")
            for i in range(400)]
    chunks = spark.createDataFrame(rows, "case_id string, source string, chunk_ord bigint, text string").repartition(5)
    asked = [(i, "c" if i % 3 else "e", f"{first[i % 2]} nom{i} première audition identité de né le de") for i in range(40)] + [(99, "c", "absent"), (98, "e", "nom7 nom8 nom9 nom10")]
    return rows, chunks, spark.createDataFrame(asked, "query_id bigint, case_id string, text string")


def test_queries_from_one_template_as_one_by_one(spark):
    _, chunks, q = template_case(spark)
    toks = lexical.tokenized(chunks)
    for limit in (3, 20, 150):
        want = lexical.word_scores(toks, lexical.weighted_words(toks, q))
        want = sorted(tuple(r) for r in lexical.first_rows(want, ["query_id", "case_id"], [F.desc("score"), "chunk_ord"], limit, rank="rank").select(
            "query_id", "case_id", "chunk_ord", "score", "rank").collect())
        for few in (0, 20_000):
            got = lexical.bm25(chunks, q, limit=limit, few=few).select("query_id", "case_id", "chunk_ord", "score", "rank").collect()
            assert sorted(map(tuple, got)) == want and want


def test_a_slice_holds_a_bound_of_scores(spark, monkeypatch):
    from liasse.operators import best

    rng = np.random.default_rng(1)
    code, chunk = np.arange(30) % 10, np.repeat(np.arange(10), 3)
    asked = lambda: best.Asked(np.repeat(np.arange(10), 5), np.tile(np.arange(5), 10), rng.permutation(50) / 7, 3.0)
    one = asked()
    whole, cut = best.Best(one, 2), best.Best(one, 2)
    args = (chunk, code, np.ones(30, np.int64), np.arange(10) * 2, np.full(10, 3))
    whole.add(*args)
    monkeypatch.setattr(best, "CELLS", 5)  # one chunk at a time
    cut.add(*args)
    assert whole.batch("c").to_pydict() == cut.batch("c").to_pydict() and whole.batch("c").num_rows == 10


def test_name_hits_rank_once_for_queries_that_meet_the_same_names(spark):
    rows, chunks, q = template_case(spark)
    want = []
    for r in q.collect():
        words = [w for w in r.text.replace("é", "e").replace("è", "e").split()]
        scored = sorted((-sum(w in s.lower() for w in words), o) for c, s, o, _ in rows if c == r.case_id and any(w in s.lower() for w in words))
        want += [(r.query_id, r.case_id, o, float(-n), k) for k, (n, o) in enumerate(scored[:30], 1)]
    assert sorted(map(tuple, signals.name_hits(chunks, q, 30).collect())) == sorted(want) and want
