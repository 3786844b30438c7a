import hashlib
import random
import zlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from liasse.llm import html, jobs, quality, toxicity
from tests.llm.odd import odd_documents
from tests.llm.test_minhash import brute_groups
from tests.llm.test_scans_and_rules import all_spans
from tests.llm.test_tokens_and_passages import ENCODING, brute_passages, ids


def accuracy(rows, labels, threshold):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert held and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    return sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    tox = jobs.op10_toxicity(spark, d).collect()
    assert len(tox) == 1000 and accuracy(tox, {k: r["toxic"] for k, r in labels.items()}, 0.5) >= 0.9
    good = jobs.op4_quality(spark, d).collect()
    assert len(good) == 1000 and accuracy(good, {k: r["quality"] for k, r in labels.items()}, 0.3) >= 0.9


def test_held_out_labels_don_t_matter(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn(
        "quality", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    for module in (toxicity, quality):
        a, b = (sorted((r["doc_id"], r["score"]) for r in module.classified(docs, x).collect()) for x in (labels, flipped))
        assert a == b


def test_classifiers_on_odd_input(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i % 9, i % 2, (i + 1) % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for module in (toxicity, quality):
            rows = module.classified(docs, labels).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
            assert module.classified(docs.filter(F.lit(False)), labels).count() == 0
    assert toxicity.clean(docs, none).schema == docs.schema and toxicity.clean(docs, none).count() == docs.count()


def test_scores_don_t_depend_on_pieces(monkeypatch):
    model = toxicity.fit(["good words here"] * 6 + ["bad awful words"] * 6, __import__("numpy").array([0.0] * 6 + [1.0] * 6))
    text = " some bad words and more awful things " * 9
    whole = toxicity.raw_score(text, model.table(), model.bias)
    monkeypatch.setattr(toxicity, "PIECE", 10)
    assert abs(toxicity.raw_score(text, model.table(), model.bias) - whole) < 1e-9


PAGE = ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=/1>Home</a> <a href=/2>All news</a></nav>"
        "<!-- <p>not this</p> --><div class='cookie-banner'>We use cookies &amp; more</div><article><h1>Big &lt;news&gt;</h1><p>The first   paragraph of the article\n has "
        "<b>some</b> words &eacute;&#233; in <a href='/x'>it</a>, more than a few.<p>Short one.</p><div class=ad>Buy now and save a lot of money today</div><p>The last paragraph "
        "tells how it all ended<br>and who was there.</p></article><form><input><button>Send</button>Your mail</form><section id=comments><p>First! I have to say that I like this article a lot.</p>"
        "</section><footer>&copy; someone</footer></body></html>")


def test_main_text():
    want = ("Big <news> The first paragraph of the article has some words éé in it, more than a few. Short one. "
            "The last paragraph tells how it all ended and who was there.")
    assert html.main_text(PAGE, html.trained()) == want
    assert html.main_text(PAGE.replace("<body>", "<body class='with-sidebar header-fixed'>"), html.trained()) == want
    for i in range(0, len(PAGE), 7):  # cut anywhere
        html.main_text(PAGE[:i], html.trained())


def test_wrappers_and_states_hide_no_article():
    title, first, last = "A bridge for the ferry road", "The old ferry stops in autumn, and a bridge of larch wood takes its place until spring.", "Nobody has to pay for it."
    body = f"<h1>{title}</h1><p>{first}</p><p>{last}</p>"
    want, tree = f"{title} {first} {last}", html.trained()
    remark = "<div id=comments><article class=comment><p>I have crossed with this ferry every day for the past forty years.</p></article></div>"
    for page in (f"<div class='page has-sidebar'><article>{body}</article>{remark}</div>", f"<article class='post comments-open'>{body}</article>{remark}",
                 f"<form id='aspnetForm'><article>{body}</article></form>", f"<form id='aspnetForm'><div>{body}</div></form>", f"<div class='overlay'><main>{body}</main></div>",
                 f"<article><header class='entry-header'><h1>{title}</h1></header><p>{first}</p><p>{last}</p></article>",
                 f"<div class='post'><header class='entry-header'><h1>{title}</h1></header><p>{first}</p><p>{last}</p></div>"):
        assert html.main_text(f"<html><body>{page}</body></html>", tree) == want, page
    for page in ("<div class='sidebar widget-2'>{}</div>", "<div id=cookie-notice>{}</div>", "<ol class=comment-list><li>{}</ol>", "<aside><article>{}</article></aside>", "<form action=/send>{}</form>",
                 "<div class='related-posts'><article>{}</article></div>", "<div hidden><article>{}</article></div>"):
        assert html.main_text(page.format(f"<p>{first}</p>"), tree) == "", page


def test_pages_of_odd_input(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "<p>" + "many words in one long page " * 50_000), (1, "u", PAGE), (5, "u", "plain text without a tag at all, but long enough")]
    got = html.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and by[2]["text"] == "" and by[2]["n_chars"] == 0 and by[4]["n_chars"] == len("many words in one long page " * 50_000) - 1
    assert by[5]["text"].startswith("plain text") and by[1]["n_chars"] == len(by[1]["text"])


def test_pipeline_as_by_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(160):
        words = rnd.choices(vocab, k=90)
        toxic = int(i % 4 == 0)
        if toxic:
            words[3:3] = ["vileword", "nastyword"] * 4
        if i % 10 == 1:
            words[5] = 'token = "0123456789abcdef0123456789abcdef"'
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic))
    docs += [(200 + i, docs[i][1] + " extra", "en", "s", 1) for i in range(1, 30, 2)] + [(300, docs[5][1], "en", "s", 1), (301, None, None, None, None), (302, "", None, None, 0)]
    bench = [(1, " ".join(docs[7][1].split()[20:50])), (2, "an item that no document holds at all whatever")]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    rest = [(i, t) for i, t, *_ in docs if "vileword" not in (t or "")]
    firsts = {min(int(x) for x in g) for g in brute_groups(rest)}
    rest = [(i, t) for i, t in rest if i in firsts and not brute_passages(t or "", bench)]
    assert sorted(got) == sorted(i for i, _ in rest)
    for i, t in rest:
        t, out, at = t or "", "", 0
        spans = [(a, b) for a, _, b in all_spans(t)]
        for a, b in spans[:1]:
            out, at = out + t[at:a] + "[secret]", b
        want = ENCODING.encode_ordinary(out + t[at:])
        assert ids(got[i]["ids"]) == want and got[i]["n_tokens"] == len(want)
        assert got[i]["decoded_sha256"] == hashlib.sha256((out + t[at:]).encode()).hexdigest()
    assert public_tokenizers.path(corpus_pipeline.VOCABULARY)
