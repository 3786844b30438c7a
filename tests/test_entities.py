from pyspark.sql import functions as F

from liasse import rules
from liasse.operators import entities as E
from liasse.operators import evidence as V
from liasse.operators import persons as P
from liasse.plans.profile import person_profile

CHUNK = "case_id string, source string, page int, chunk_ord bigint, text string"


def chunks(spark, texts):
    return spark.createDataFrame([("c", f"s{i}", i, i, t) for i, t in enumerate(texts)], CHUNK)


def values(spark, text, kind):
    rows = E.extract_entities(chunks(spark, [text]), [kind]).orderBy("start").collect()
    assert all(text[r.start:r.end] == r.raw for r in rows)
    return [r.value for r in rows]


def test_samples(spark):
    phones = "tel 06 12 34 56 78 ou +33 6 12 34 56 78 ou +33 (0)6 12 34 56 78 ou 0033 1 23 45 67 89 ou 01.98.76.54.32"
    assert values(spark, phones, "phone") == ["+33612345678"] * 3 + ["+33123456789", "+33198765432"]
    assert values(spark, "x 01.98.76.54.32", "ip") == ["01.98.76.54"]
    assert values(spark, "FR76 3000 6000 0112", "iban") == []
    assert values(spark, "FR7630006000011234567890189", "iban") == ["FR7630006000011234567890189"]
    assert values(spark, "Jean.Dupont@Example.com, 192.168.0.1", "email") == ["jean.dupont@example.com"]
    assert values(spark, "a AB-123-CD b 123 ABC 75 c ab-123-cd", "plate") == ["AB-123-CD", "123 ABC 75"]
    assert values(spark, "jean@example.com t.me/moi_x", "telegram") == ["@example", "@moi_x"]
    assert values(spark, "éjean@x.fr", "email") == []


def persons(spark, names):
    return spark.createDataFrame([(i, "c", n, []) for i, n in enumerate(names)], "person_id bigint, case_id string, name string, aliases array<string>")


def test_link_window_edges(spark):
    near = "Jean Dupont" + " " * 69 + "a@b.fr"      # starts 80 before the match
    far = "Jean Dupont" + " " * 70 + "a@b.fr"       # starts 81 before
    occ = E.extract_entities(chunks(spark, [near, far]), ["email"])
    for small in (True, False):
        got = E.link_person(occ, persons(spark, ["JEAN dupont", "Luc", "Al"]), small).collect()
        assert [(r.chunk_ord, r.person_id) for r in got] == [(0, 0)]


def test_many_persons_take_the_gram_join(spark):
    names = [f"Jean Martin{i}" for i in range(200)] + ["Li"]
    texts = [f"Jean Martin{i} : a{i}@b.fr" for i in range(0, 200, 3)] + ["Li : li@b.fr"]
    occ, who = E.extract_entities(chunks(spark, texts), ["email"]), persons(spark, names)
    brute = {(i, p) for i, t in enumerate(texts) for p, n in enumerate(names) if n.lower() in t.lower()}
    for small in (None, False):
        got = {(r.chunk_ord, r.person_id) for r in E.link_person(occ, who, small).collect()}
        assert got == brute
        marked = E.mark_linked(occ, who, small).collect()
        assert {(r.chunk_ord, p) for r in marked for p in r.linked_persons} == brute and len(marked) == len(texts)


def test_items_one_occurrence_per_chunk(spark):
    occ = E.extract_entities(chunks(spark, ["A@b.fr a@b.fr", "a@b.fr"]), ["email"])
    r = E.aggregate_entities(occ).first()
    assert r.n_occurrences == 2 and r.variants == ["A@b.fr", "a@b.fr"] and r.first_source == "s0"


def test_later_link_is_kept(spark):
    text = "a@b.fr" + " " * 200 + "a@b.fr Luc"
    occ = E.mark_linked(E.extract_entities(chunks(spark, [text]), ["email"]), persons(spark, ["Luc"]))
    r = E.unique_occurrences(occ).first()
    assert r.linked is False and r.linked_any is True


def test_phone_roles(spark):
    texts = ["Numéro de Jean Dupont : 06 11 11 11 11", "Conversation avec Jean Dupont au 06 22 22 22 22", "Appel au 06 33 33 33 33", "rien 06 44 44 44 44"]
    got = {(r.value[-2:], r.person_id): r for r in E.phone_roles(E.extract_entities(chunks(spark, texts), ["phone"]), persons(spark, ["Jean Dupont"])).collect()}
    assert got["11", 0].role == "used_by_person" and abs(got["11", 0].confidence - round(0.8 / 1.3, 3)) < 1e-9
    assert got["22", 0].role == "contact_of_person"
    assert got["33", None].role == "used_by_person" and got["33", None].confidence == 0.3
    assert got["44", None].role == "unknown" and ("44", 0) not in got
    assert got["11", 0].evidence[0].n_rules == 1


def test_lookup_and_report(spark):
    df = chunks(spark, ["au 06 11 11 11 11 et +33 6 11 11 11 11", "au 0611111111"])
    nums = spark.createDataFrame([("06.11.11.11.11",), ("zz",)], "number string")
    hits = E.lookup_phone(df, nums)
    assert hits.count() == 3
    rep = {r.source: r for r in E.phone_report(hits).collect()}
    assert rep["s0"].n_hits == 2 and rep["s0"].n_pages == 1
    assert sorted(r.occurrence for r in E.phone_report_hits(hits).collect()) == [1, 1, 2]


def test_unknown_theme(spark):
    assert E.scan_theme(chunks(spark, ["a@b.fr"]), None, "nothing").count() == 0
    assert E.scan_theme(chunks(spark, ["AB-123-CD"]), None, "plaques").count() == 1
    assert F is not None


def test_counts_and_lists_have_no_hidden_limit(spark):
    texts = [f"Jean Dupont a{i:02d}@b.fr" for i in range(45)]
    ch, who = chunks(spark, texts), persons(spark, ["Jean Dupont"])
    assert person_profile(ch, who).first()["n_technical"] == 45 + E.technical_panel(ch, who).filter("kind <> 'email' and person_id is not null").count()
    assert E.technical_panel(ch, who).filter("kind = 'email'").count() == 45
    assert E.summarize_theme(E.extract_entities(ch, ["email"])).count() == 45
    assert E.summarize_theme(E.extract_entities(ch, ["email"]), limit=40).count() == 40
    said = spark.createDataFrame([("c", 0, f"s{i}", i, i, 0, f"phrase {i}", f"phrase {i}", "neutre", "2020-01-01") for i in range(130)],
                                 "case_id string, person_id bigint, source string, page int, chunk_ord bigint, sent_no int, sentence string, folded string, kind string, date string")
    assert V.sentence_rows(said).count() == V.sentence_events(said).count() == 130


def test_the_panel_is_that_of_its_parts(spark):
    texts = ["Jean Dupont : 06 12 34 56 78, jean@x.fr et 10.1.2.3", "contact jean@x.fr de Paul Martin. " + "z" * 200 + " 06 12 34 56 78", "IP 10.1.2.3 de Jean Dupont, plaque AB-123-CD"]
    df = spark.createDataFrame([("c", "s", i, i, t) for i, t in enumerate(texts)], "case_id string, source string, page int, chunk_ord bigint, text string")
    who = spark.createDataFrame([(1, "c", "Jean Dupont"), (2, "c", "Paul Martin"), (3, "d", "Jean Dupont")], "person_id bigint, case_id string, name string")
    occ = E.extract_entities(df, list(dict.fromkeys(rules.THEMES.values())))
    phones = E.summarize_theme(E.mark_linked(occ.filter("kind = 'phone'"), who, False))
    rest = E.summarize_theme(E.link_person(occ.filter("kind <> 'phone'"), who, False), ["person_id"])
    want = [(None, r.kind, r.item_rank, r.line) for r in phones.collect()] + [(r.person_id, r.kind, r.item_rank, r.line) for r in rest.collect()]
    got = [(r.person_id, r.kind, r.item_rank, r.line) for r in E.technical_panel(df, who).collect()]
    assert len(got) == 5 and sorted(got, key=str) == sorted(want, key=str)


def test_names_by_the_automaton_as_by_the_join(spark):
    texts = ["Jean Dupont", "dupont, " + "x" * 38 + " jean", "dupont, " + "x" * 39 + " jean", "jean-dupont", "Jeanne Dupont et Jean", "DUPONT jean", "dupont_jean", "de la Tour Anne", "anne tour", "jean jean", "O'Neil",
             "o'neil", "", "élie élie", "elie Martin martin", "dupont dupont jean", "martin " * 50 + "paul"]
    df = spark.createDataFrame([("cd"[i % 2], "s", i, i, t) for t0 in (0, 1) for i, t in enumerate(texts)][: len(texts)]
                               + [("dc"[i % 2], "s", i, i, t) for i, t in enumerate(texts)], "case_id string, source string, page int, chunk_ord bigint, text string")
    who = spark.createDataFrame([(1, "c", "Jean Dupont", ["Dupont"]), (2, "c", "Anne de la Tour", []), (3, "d", "Jean Jean", ["O'Neil"]), (4, "d", "Élie Martin", None), (5, "d", "Jean Dupont", []),
                                 (1, "d", "Paul Martin", [".."]), (6, "c", "  ", []), (7, "c", "jean", [])], "person_id bigint, case_id string, name string, aliases array<string>")
    got = [{(r.case_id, r.person_id, r.chunk_ord) for r in P.mentions(df, who, small).collect()} for small in (None, True, False)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 20
