import json
import os
import re

from pyspark.sql import functions as F

from liasse.functions.dates import fact_time
from liasse.operators import evidence, persons as P
from liasse.plans.ingest import ingest_batch
from liasse.sources import corpus, pages as S
from liasse.streaming.ingest import ingest_stream, page_stream

CHUNK = "case_id string, source string, page int, chunk_ord bigint, text string"


def people(spark, rows):
    return spark.createDataFrame(rows, "person_id bigint, case_id string, name string, aliases array<string>")


def test_mentions_either_order_within_forty(spark):
    texts = ["Jean, dit le petit, DUPONT", "DUPONT Jean", "Jean " + "x" * 45 + " Dupont", "Jeanne Dupont", "né Jéan dupont", "le Gros arrive", "legros"]
    df = spark.createDataFrame([("c", "s", i, i, t) for i, t in enumerate(texts)], CHUNK)
    who = people(spark, [(1, "c", "Jean Dupont", []), (2, "c", "Paul Martin", ["Gros"]), (3, "d", "Jean Dupont", [])])
    for small in (True, False):
        got = {(r.person_id, r.chunk_ord) for r in P.mentions(df, who, small).collect()}
        assert got == {(1, 0), (1, 1), (1, 4), (2, 5)}


def test_civil_neighbours_and_fallback(spark):
    texts = ["avant", "Première audition de Jean Dupont, né le 3 mai 1980 à Lyon, domicilié au 4 rue B.", "après", "Luc Petit passe"]
    df = spark.createDataFrame([("c", "s", i, i, t) for i, t in enumerate(texts)], CHUNK)
    who = people(spark, [(1, "c", "Jean Dupont", []), (2, "c", "Luc Petit", [])])
    civil = P.civil_snippets(df, who)
    mine = {r.chunk_ord: r.score for r in civil.filter("person_id = 1").collect()}
    assert set(mine) == {0, 1, 2} and mine[0] == mine[1] - 1

    def search(q):
        return q.select("query_id", "case_id", F.lit(0).cast("bigint").alias("chunk_ord"), F.lit(1).alias("rank")).join(df, ["case_id", "chunk_ord"])

    both = P.with_fallback(civil, who, search, "{} identité", 30, 40, min_score=8)
    assert {(r.person_id, r.from_search) for r in both.collect()} == {(1, False), (2, True)}
    b = P.birth_info(civil).filter("person_id = 1").first()
    assert b.birth_date == "3 mai 1980" and b.birth_place == "Lyon"


def test_address_vote(spark):
    texts = ["Jean Dupont demeurant au 1 rue A.", "Jean Dupont, domicilié au 2 rue B ; parti", "Jean Dupont Demeurant au 1 rue A, seul."]
    df = spark.createDataFrame([("c", "s", i, i, t) for i, t in enumerate(texts[:1] * 2 + texts[1:2])], CHUNK)
    v = P.address_vote(P.address_snippets(df, people(spark, [(1, "c", "Jean Dupont", [])]))).first()
    assert v.main_address == "demeurant au 1 rue A" and v.n_votes == 2 and v.other_addresses == ["domicilié au 2 rue B"]


def test_evidence_statement_by_type(spark):
    sn = spark.createDataFrame([(1, "c", 1, "s", 1, 1, 0, None, None, "pv_gav", "la balise et l'ADN", 1.0)],
                               "person_id bigint, case_id string, rank int, source string, page int, chunk_ord bigint, unit_index int, unit_title string, doc_date string, doc_type string, text string, score double")
    got = {(r.family, r.category) for r in evidence.dedup_evidence(evidence.classify_evidence(sn)).collect()}
    assert got == {("procedure", "balise"), ("science", "adn"), ("statements", "audition")}


def test_classes_and_timeline(spark):
    rows = [(1, "c", "phone", "+331", 1, "s", 1, "appel reçu le 31/02/2020 puis le 2020-03-04 à 25h puis 9h05", True, 0),
            (1, "c", "phone", "+332", 2, "s", 1, "rien", True, 0), (1, "c", "phone", "+332", 3, "s", 1, "rien", True, 0),
            (1, "c", "iban", "FR", 4, "s", 1, "aucune empreinte ; empreinte relevée", True, 0)]
    occ = spark.createDataFrame(rows, "person_id bigint, case_id string, kind string, value string, chunk_ord bigint, source string, page int, snippet string, linked boolean, start int")
    got = {r.chunk_ord: r for r in evidence.classify_occurrences(occ).collect()}
    assert [got[i]["class"] for i in (1, 2, 3, 4)] == ["charge", "charge", "charge", "decharge"]
    assert got[4].bucket == "empreintes_papillaires"
    assert [r.event_date for r in evidence.fact_timeline(evidence.classify_occurrences(occ)).collect()] == ["2020-03-04T09:05"]


def test_fact_time_of_a_whole_hour(spark):
    texts = ["vu à 14h, puis à 15h30", "vers 9h.", "à 25h, 14h5 et 99:99 puis 8:05", "à 24h", "rien"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(fact_time(F.col("t"))).collect()] == ["14:00", "09:00", "08:05", None, None]


def test_snapshot_layouts(spark, tmp_path):
    for case, data in (("a", {"chunks": ["x", "y"], "sources": [{"source": "f", "page": 2, "is_fact": True}]}), ("b", [{"text": "z", "meta": {"source": "g"}}])):
        os.makedirs(tmp_path / case)
        (tmp_path / case / "bm25.json").write_text(json.dumps(data), encoding="utf-8")
    got = {(r.case_id, r.chunk_ord): r for r in corpus.read_snapshot(spark, f"{tmp_path}/*/bm25.json").collect()}
    assert got["a", 0].page == 2 and got["a", 0].is_fact and got["a", 1].source is None and got["b", 0].text == "z"


def test_text_files(spark, tmp_path):
    os.makedirs(tmp_path / "case 1")
    (tmp_path / "case 1" / "né.txt").write_text("ligne 1\nligne 2", encoding="utf-8")
    r = S.read_pages(spark, f"{tmp_path}/*/*.txt", "text").first()
    assert (r.case_id, r.source, r.page, r.text) == ("case 1", "né.txt", 1, "ligne 1\nligne 2")


def _pages(spark, rows):
    return spark.createDataFrame(rows, "case_id string, source string, page int, text string")


def test_ingest_twice_adds_nothing(spark, tmp_path):
    root = str(tmp_path / "corpus")
    one = _pages(spark, [("c", "a.txt", 1, "RAPPORT un. Fin."), ("c", "copie.txt", 1, "RAPPORT un. Fin."), ("bad/case", "x", 1, "t")])
    ingest_batch(spark, one, root, "b1")
    two = one.unionByName(_pages(spark, [("c", "b.txt", 1, "RAPPORT deux. Fin.")]))
    ingest_batch(spark, two, root, "b2")
    ingest_batch(spark, two, root, "b2")
    chunks = corpus.read_chunks(spark, root, ["c"])
    ords = sorted(r.chunk_ord for r in chunks.collect())
    assert ords == list(range(len(ords)))
    assert {r.source for r in chunks.select("source").distinct().collect()} == {"a.txt", "b.txt"}
    docs = corpus.read_table(spark, root, "documents")
    assert [r.case_id for r in corpus.list_cases(docs).collect()] == ["c"] and corpus.list_units(docs).count() == 2


def test_ingest_by_name_keeps_equal_and_empty_files(spark, tmp_path):
    root = str(tmp_path / "corpus")
    one = _pages(spark, [("c", "a.txt", 1, "RAPPORT un. Fin."), ("c", "vide1.txt", 1, "")])
    ingest_batch(spark, one, root, "b1", by_name=True)
    more = _pages(spark, [("c", "copie.txt", 1, "RAPPORT un. Fin."), ("c", "vide2.txt", 1, ""), ("c", "vide2.txt", 2, "")])
    ingest_batch(spark, one.unionByName(more), root, "b2", by_name=True)
    docs = {r.source: r for r in corpus.read_table(spark, root, "documents").collect()}
    assert {s: (r.batch, r.n_pages, r.n_chunks > 0, len(r.units)) for s, r in docs.items()} == {
        "a.txt": ("b1", 1, True, 1), "vide1.txt": ("b1", 1, False, 1), "copie.txt": ("b2", 1, True, 1), "vide2.txt": ("b2", 2, False, 1)}
    assert docs["vide1.txt"].content_hash and docs["vide1.txt"].doc_type == "document"
    ords = sorted(r.chunk_ord for r in corpus.read_chunks(spark, root, ["c"]).collect())
    assert ords == list(range(len(ords)))


def test_stream_ingests_each_content_once(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "corpus")
    _pages(spark, [("c", "a.txt", 1, "Un texte.")]).coalesce(1).write.parquet(src)
    run = lambda: ingest_stream(page_stream(spark, src), root, str(tmp_path / "cp")).awaitTermination()
    run()
    _pages(spark, [("c", "b.txt", 1, "Un texte."), ("c", "d.txt", 1, "Autre.")]).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.source for r in corpus.read_table(spark, root, "documents").collect()) == ["a.txt", "d.txt"]


def test_vector_versions(spark, tmp_path):
    v = spark.createDataFrame([("c", 1, [3.0, 4.0])], "case_id string, chunk_ord bigint, embedding array<float>")
    corpus.replace_vectors(spark, v, str(tmp_path), "20240101")
    corpus.replace_vectors(spark, v.withColumn("embedding", F.array(F.lit(0.0), F.lit(2.0)).cast("array<float>")), str(tmp_path), "20240102")
    assert corpus.latest_vectors(spark, str(tmp_path)).first().embedding == [0.0, 1.0]


def test_plans(spark, sf):
    """No Python in the plain jobs, no window without partition, no cross join."""
    from liasse.workload import queries
    for name in ("entity_emails", "chunk_pack", "bm25_topk", "history_newest", "linked_pairs", "mentions", "evidence_counts"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|CartesianProduct", plan), name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "Exchange SinglePartition" not in plan, name


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pass_over_the_texts_for_each_person_query(spark):
    """Texts are folded once where names are looked for, and names are looked for once per query."""
    texts = ["Première audition de Jean Dupont, demeurant au 4 rue B.", "Jean Dupont, domicilié au 4 rue B. et demeurant au 5 rue C.", "", None]
    df = spark.createDataFrame([("c", "s", i, i, t) for i, t in enumerate(texts)], CHUNK)
    who = people(spark, [(1, "c", "Jean Dupont", [])])
    found = P.mentions(df, who)
    assert _plan(found).count("translate(") == 1
    assert _plan(P.mentions(df, who, False)).count("translate(lower(text") <= 1
    assert _plan(P.civil_snippets(df, who)).count("MapInArrow") == 1
    assert _plan(P.address_vote(P.address_snippets(df, who))).count("MapInArrow") == 1
    snips = spark.createDataFrame([(1, "c", 1, "s", 1, 1, 0, "u", None, None, t, 1.0) for t in ("garde à vue", "", " ")],
                                  "person_id long, case_id string, rank int, source string, page int, chunk_ord long, unit_index int, unit_title string, doc_date string, doc_type string, text string, score double")
    shown = evidence.classify_evidence(snips)
    assert _plan(shown).count("translate(") == 1
    assert {r.category for r in shown.collect()} == {"gav"}


def test_sentences_are_dealt_by_person_once(spark):
    texts = ["Jean Dupont nie. Jean Dupont nie ! Dupont, dit Petit, avoue le 3 mai 2020.", "jean dupont NIE. Dupont avoue le 3 mai 2020.", "Rien. Le petit pont."]
    df = spark.createDataFrame([("c", "s", i, i, t) for i, t in enumerate(texts)], CHUNK)
    who = people(spark, [(1, "c", "Jean Dupont", ["Dupont", "Petit"]), (2, "c", "Luc Dupont", ["Dupont"])])
    rows, events = evidence.sentence_analysis(df, who)
    cut = [(0, 0, "Jean Dupont nie."), (0, 1, "Jean Dupont nie !"), (0, 2, "Dupont, dit Petit, avoue le 3 mai 2020."), (1, 1, "Dupont avoue le 3 mai 2020.")]
    want = {(p, i + 1, *c) for p in (1, 2) for i, c in enumerate(cut)} | {(1, 5, 2, 1, "Le petit pont.")}
    assert {(r.person_id, r.row, r.chunk_ord, r.sent_no, r.label) for r in rows.collect()} == want
    assert {(r.person_id, r.row, r.date) for r in events.collect()} == {(p, i, "3 mai 2020") for p in (1, 2) for i in (1, 2)}
    for got in (rows, events):
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning(person_id") == 1
    assert evidence.person_sentences(df, who).count() == 11


def test_ingest_finds_titles_and_digests_once(spark, tmp_path, monkeypatch):
    from liasse.operators import segment

    calls = []
    for module, name in ((segment, "number_pages"), (segment, "tag_documents"), (corpus, "content_hashes")):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, whole=whole, name=name: calls.append(name) or whole(df))
    root = str(tmp_path / "corpus")
    ingest_batch(spark, _pages(spark, [("c", "a.txt", 1, "RAPPORT un. Fin."), ("c", "b.txt", 1, "")]), root, "b1")
    assert sorted(calls) == ["content_hashes", "number_pages", "tag_documents"]
    docs = {r.source: r for r in corpus.read_table(spark, root, "documents").collect()}
    assert docs["a.txt"].n_pages == 1 and docs["a.txt"].content_hash != docs["b.txt"].content_hash and docs["b.txt"].n_chunks == 0


def test_cues_of_scores_lose_nothing(spark):
    from liasse import rules
    from liasse.functions.text import norm_text

    texts = ["Née  le\t5 juin", "né le 3", "ne le ٣", "divorce", "fille de", "domicilié chez z", "Domiciliée a x, demeurant au y, résidant a z", "de nationalité f, de profession g, célıbataire", "Mariée divorcé VEUF fils de fille de",
             "réquısıtıon extraction téléphonique", "exploitation du téléphone perquısıtıon", "commission rogatoıre écoutes téléphoniques", "exploitation de scellé facturation détaillée", "adresse actuelle chez", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(norm_text(F.col("t")).alias("f"))
    for patterns, cues in ((rules.CIVIL, rules.CIVIL_CUES), (rules.PROCEDURAL, rules.PROCEDURAL_CUES), (rules.ADDRESS, rules.ADDRESS_CUES)):
        whole = sum((F.col("f").rlike(p).cast("int") for p in patterns), F.lit(0))
        assert df.agg(F.sum(whole)).first()[0] >= len(patterns) - 1
        assert df.filter(P._hits(patterns, cues, F.col("f")) != whole).count() == 0


def test_snippet_is_cleaned_once(spark):
    from liasse.functions.text import snippet

    df = spark.createDataFrame([("a  b\x85" * 200,)], "t string").select(snippet(F.col("t"), F.lit(10), F.lit(700)).alias("s"))
    assert _plan(df).count("translate(") == 1
    assert df.first()[0] == ("a b " * 200)[:280] + "…"
