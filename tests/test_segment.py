from pyspark.sql import functions as F

from liasse.operators import chunking, identity, segment

SAMPLES = [
    ("Procès-verbal d'audition du témoin X\nFait à Paris, le 12 mars 2021 à 14h30.", "PV_AUDITION_20210312_Dupont.pdf", "2021-03-12", "pv"),
    ("PROCÈS-VERBAL DE VÉRIFICATION D’IDENTITÉ\nNom: DUPONT\nDate et lieu de naissance: 12/03/1990 à Paris", "PV_IDENTITE_20210312_Dupont.pdf", "1990-03-12", "pv_identite"),
    ("NOM : DUPONT\nPRÉNOM : Jean\nDATE ET LIEU DE NAISSANCE : 12/03/1990 à Paris\nFILIATION : ...\nADRESSE : ...", "INTERROGATOIRE_1.pdf", "1990-03-12", "pv_identite"),
    ("RAPPORT d'enquête — Section financière\nDate: 2021-03-14", "Rapport_SF_2021-03-14.pdf", "2021-03-14", "rapport"),
    ("Expertise balistique\nLe 03/04/2020", "expertise_2020_04_03.pdf", "2020-04-03", "expertise"),
    ("Transcription des écoutes — Ligne 06…", "ECOUTES_2019-12-01.txt", "2019-12-01", "ecoutes"),
    ("Procès-verbal de constatations", "PV_Constat_12-11-2018.pdf", None, "pv"),
    ("Sans date claire dans le contenu", "PV_GAV_20170505.pdf", None, "document"),
    ("Note interne", "note_interne.pdf", None, "document"),
]


def test_date_and_type_samples(spark):
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _, _) in enumerate(SAMPLES)], "i int, head_text string, source string")
    got = segment.tag_types(segment.tag_dates(df)).orderBy("i").collect()
    assert [(r.doc_date, r.doc_type) for r in got] == [(d, k) for _, _, d, k in SAMPLES]
    loose = segment.tag_dates(df, loose_filename=True).orderBy("i").collect()
    assert loose[7].doc_date == "2017-05-05"


def test_dates_out_of_range(spark):
    df = spark.createDataFrame([(0, "le 30/02/2021", ""), (1, "le 45/13/2021 puis 1/1/2020", ""), (2, "", "x-2020-13-45.pdf")], "i int, head_text string, source string")
    got = segment.tag_dates(df).orderBy("i").collect()
    assert [r.doc_date for r in got] == ["2021-02-29", "2020-01-01", "2020-01-31"]
    assert got[0].doc_date_d is None and got[1].doc_date_d is not None


PAGES = [
    "PROCÈS-VERBAL D'AUDITION DE M. DUPONT\nFait à Paris, le 12 mars 2021...",
    "Suite de l'audition de M. DUPONT...",
    "NOM : DUPONT\nPRÉNOM : Jean\nDATE ET LIEU DE NAISSANCE : 12/03/1990 à Paris\nFILIATION : ...\nADRESSE : ...",
    "Suite interrogation...",
    "RAPPORT D'ENQUÊTE — Section financière\nDate: 2021-03-14",
    "Suite du rapport d'enquête...",
]


def pages_df(spark, source="demo.pdf", texts=PAGES):
    return spark.createDataFrame([("c", source, i + 1, t) for i, t in enumerate(texts)], "case_id string, source string, page int, text string")


def test_segmentation_sample(spark):
    got = segment.number_units(pages_df(spark)).orderBy("page").collect()
    assert [r.unit_index for r in got] == [0, 1, 2, 2, 3, 4]
    assert got[2].title == "FILIATION : ..." and got[3].title is None


def test_untitled_documents(spark):
    one = segment.segment_units(pages_df(spark, "a.txt", ["rien ici", "ni là"])).collect()
    assert [(u.unit_title, u.page_start, u.page_end) for u in one] == [("a.txt", 1, 2)]
    two = segment.segment_units(pages_df(spark, "a.txt", ["rien ici", "RAPPORT final"])).orderBy("unit_index").collect()
    assert [u.unit_title for u in two] == ["a.txt (partie 1)", "RAPPORT final"]


def test_long_document_counts_over_blocks(spark):
    n = 3000
    df = spark.range(1, n + 1).select(
        F.lit("c").alias("case_id"), F.lit("big").alias("source"), F.col("id").cast("int").alias("page"),
        F.when(F.col("id") % 10 == 0, "RAPPORT").otherwise("suite").alias("text"))
    got = segment.number_units(df).select("page", "unit_index").collect()
    assert all(r.unit_index == r.page // 10 for r in got) and len(got) == n


FORM = ["FICHE\nN0M : DUPONT\nPRÉNOM : Jean\nProfession : plombier\nà son compte\nNé le : 1/2/1980", "demeurant au 3 rue X à Lille, de nationalité française"]


def test_identity_fields(spark):
    df = pages_df(spark, "f.pdf", ["\n".join(FORM)])
    r = df.select(identity.form_fields(F.col("text")).alias("f"), identity.narrative_fields(F.col("text")).alias("n"),
                  identity.page_fields(F.col("text")).alias("p")).first()
    assert r.f["nom"] == "DUPONT" and r.f["prenom"] == "Jean" and r.f["profession"] == "plombier à son compte"
    assert r.f["naissance"].startswith("1/2/1980")
    assert r.n["adresse"].startswith("au 3 rue X à Lille")
    assert r.p["nom"] == "DUPONT" and r.p["adresse"] == r.n["adresse"]


def test_fact_scan_stops_when_good_enough(spark):
    pages = pages_df(spark, "f.pdf", FORM + ["Adresse : ailleurs"])
    numbered = segment.number_units(pages)
    units = segment.tag_unit_type(segment.units_of(numbered).join(segment.tag_documents(pages), segment.DOC))
    got = identity.identity_facts(numbered, units).collect()
    assert len(got) == 1 and got[0].n_scanned == 1
    assert got[0].fact.startswith("IDENTITÉ (extrait structuré) — NOM: DUPONT ; PRÉNOM: Jean ; NAISSANCE: 1/2/1980")


def test_ingest_order_and_kinds(spark):
    base = spark.createDataFrame([("c", 100)], "case_id string, n_chunks bigint")
    two = pages_df(spark, "b.pdf").unionByName(pages_df(spark, "f.pdf", FORM))
    got = chunking.build_chunks(two, base).orderBy("chunk_ord").collect()
    assert [r.chunk_ord for r in got] == list(range(100, 100 + len(got)))
    for source in ("b.pdf", "f.pdf"):
        mine = [(r.page, {"anchor": 0, "fact": 1, "text": 2}[r.chunk_kind], r.local_chunk_id) for r in got if r.source == source]
        assert mine == sorted(mine)
    fact = [r for r in got if r.is_fact]
    # the demo file holds an identity form of its own
    assert {r.source for r in fact} == {"b.pdf", "f.pdf"}
    assert all(r.local_chunk_id == -1 and r.doc_type == "pv_identite" and r.unit_title.endswith(" — IDENTITÉ (facts)") for r in fact)


def prefix_scan(pages, read, enough):
    """Fields of the growing text of a unit, page by page, until they are enough."""
    got = {}
    for k in range(1, len(pages) + 1):
        for key, value in read("\n".join(pages[:k])).items():
            got.setdefault(key, value)
        if enough(got):
            return got, k
    return got, len(pages)


def test_fields_of_all_pages_as_by_growing_prefixes(spark):
    filler = [f"Ligne {i} sans rien" for i in range(320)]
    units = [
        ["VÉRIFICATION D'IDENTITÉ", "rien", "", "rien", "encore", "NOM : DUPONT\nPRÉNOM : Jean", "Adresse : Lille", "né le 3 mai 1980 à Lyon"],
        ["\n".join([*filler, "NOM : TARD", "PRÉNOM : Paul", "PROFESSION : juge", "FILIATION : connue"])],
        ["NOM :", "MARTIN\nPRÉNOM :", "", " \n ", "Luc", "demeurant", "au 4 rue B, de nationalité", "française"],
        ["NOM : A", "NOM : B\nPRÉNOM : C", "il est né", "le 1er mai, profession : boulanger", "PROFESSION : autre\nADRESSE :"],
        ["PRÉNOM : X\nNOM : Y\nADRESSE : Z\nDATE ET LIEU DE NAISSANCE : 1/1/1970", "PROFESSION : jamais lue"],
        ["rien du tout", None, "ni ici"],
    ]
    rows = [("c", f"u{i}", 0, k, t) for i, pages in enumerate(units) for k, t in enumerate(pages, 1)]
    df = spark.createDataFrame(rows, "case_id string, source string, unit_index int, page int, text string")
    blobs = sorted({"\n".join((t or "") for t in pages[:k]) for pages in units for k in range(1, len(pages) + 1)})
    read = {r.t: r.f for r in spark.createDataFrame([(t,) for t in blobs], "t string").select("t", identity.page_fields(F.col("t")).alias("f")).collect()}
    enough = lambda f: "nom" in f and "prenom" in f and ("naissance" in f and "adresse" in f or len(f) >= 4)
    want = {f"u{i}": prefix_scan([t or "" for t in pages], read.get, enough) for i, pages in enumerate(units)}
    got = {r.source: (r.fields, r.n_scanned) for r in identity.scan_fields(df).collect()}
    assert got == want
    assert got["u0"][0]["nom"] == "DUPONT" and got["u1"][0]["nom"] == "TARD" and got["u2"][0]["adresse"].startswith("au 4 rue B")
    few = {r.source: r.fields for r in identity.scan_fields(df, 5).collect()}
    assert "nom" not in few["u0"]


def test_anchor_is_written_once(spark):
    pages = spark.createDataFrame([("c", "a.txt", 1, "RAPPORT un. Fin.")], "case_id string, source string, page int, text string")
    units = segment.segment_units(pages).withColumn("doc_type", F.lit("pv")).withColumn("doc_date", F.lit("2020-01-01")).withColumn("unit_type", F.lit("pv"))
    anchors = segment.unit_anchors(segment.number_units(pages), units)
    assert anchors._jdf.queryExecution().optimizedPlan().toString().count("ACTE / UNITÉ") == 1
    assert anchors.count() == 1


def test_cues_lose_nothing(spark):
    texts = ["Fait le 3.\x85NOM : Dupont\x0bPRÉN0M : Jean ADRESSE : 3 rue A\nné\tle 5 mai 1980", "Elle est née\n le 5 juin. Il demeure à Lyon. Nationalité française",
             "RÉSIDENCE : ici\r\nMÈRE : Anne\r\nNATION : F", "PV d’audition", "vérification d'Identité", "conſtat", "", None]
    df = spark.createDataFrame([("c", "s", i, t) for i, t in enumerate(texts)], "case_id string, source string, page int, text string")
    rows = df.orderBy("page").select(F.size(identity.page_fields(F.col("text"))).alias("n"), identity.possible_fields(F.col("text")).alias("most")).collect()
    assert [r.n for r in rows] == [4, 3, 3, 0, 0, 0, 0, 0] and all(r.n <= r.most for r in rows)
    titles = [r.title for r in segment.detect_titles(df).orderBy("page").collect()]
    assert titles[3:6] == texts[3:6] and titles[6:] == [None, None]
