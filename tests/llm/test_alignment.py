import hashlib
import json
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from liasse.llm import alignment as al
from tests.llm.odd import odd_documents

MODELS = tuple(al.read_model(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coders():
    return al.ByteLevel(MODELS[0]), al.Pieces(MODELS[1])


def tokens(coders, text):
    whole, out = (" " + (text or "")).encode(), []
    for c in coders:
        at, side = 0, []
        for i in c.encode([text or ""])[0]:
            side.append((i, at, at := at + len(c.tokens[i])))
        if not text or b"".join(c.tokens[i] for i, _, _ in side) != whole:
            return [], []
        out.append(side)
    return out


def brute(coders, rows):
    every = [tokens(coders, t) for _, t in rows]
    links = [[(x[0], y[0]) for x in a for y in b if x[2] == y[2]] for a, b in every]
    count = Counter(p for found in links for p in found)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (i, _), (a, b), found in zip(rows, every, links, strict=True):
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        cut = [0, *ends]
        written = ";".join("|".join(",".join(str(x[0]) for x in side if p < x[2] <= q) for side in (a, b)) for p, q in zip(cut, cut[1:], strict=False))
        out.append((i, len(a), len(b), len(ends), len(found), sum(count[p] == best[p[1]] for p in found), sum(count[p] for p in found),
                    hashlib.sha256(written.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


TEXTS = ["The quick brown fox", "the  spaced   text\t\n here", "élan vital, naïve Straße", "中文 and русский", "\U0001f600\U0001f600 x", " lead and trail ",
         "<|endoftext|> <s> </s> <unk> ▁▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't can't we'll", "1234567890 3.14159", "\x00\x01 \x7f", "", "x", " ", "The quick brown fox"]


def test_report_as_by_brute_force(spark, coders):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the fox"), (3, "the fox"), (3, "the fox"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(coders, rows)
    for hot in (al.HOT, 3, 1):  # all pairs broadcast, some, none
        assert found(al.report(df, *MODELS, hot=hot)) == want


def test_given_documents_as_by_brute_force(spark, coders, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 1500")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(rows) > 50 and found(al.report(docs, *MODELS)) == brute(coders, rows)


def test_overlaps_are_all_pairs_of_meeting_tokens(coders):
    one = al.Aligner(*coders)
    ids = one.tokens(TEXTS)
    a, b = (al.spans(i, n) for i, n in zip(ids, one.lengths, strict=True))
    assert isinstance(a, pd.DataFrame) and len(a) == sum(map(len, ids[0]))
    got = sorted(map(tuple, al.overlaps(a, b).to_numpy().tolist()))
    want = [(i, j) for i, x in a.iterrows() for j, y in b.iterrows() if x["doc"] == y["doc"] and x["start"] < y["end"] and y["start"] < x["end"]]
    assert got == sorted(want)


def test_texts_that_a_side_changes_have_no_tokens(coders):
    class Lossy(al.Pieces):
        def encode(self, texts):
            return super().encode([t.replace("é", "e") for t in texts])

    one = al.Aligner(coders[0], Lossy(MODELS[1]))
    (kept, gone) = one.align(["plain", "été"])
    assert kept[:2] != (0, 0) and gone[:4] == (0, 0, 0, 0) and gone[6] == b""


def test_batches_don_t_change_results(coders, monkeypatch):
    one = al.Aligner(*coders)
    show = lambda rows: [(*r[:4], r[4].tolist(), r[5].tolist(), r[6]) for r in rows]
    whole = show(one.align(TEXTS))
    monkeypatch.setattr(al, "BATCH_BYTES", 20)
    assert [r for g in al._groups(TEXTS) for r in show(one.align(g))] == whole


def test_groups_in_writing_can_be_kept(spark):
    df = spark.createDataFrame([(1, "the fox")], "doc_id long, text string")
    (r,) = al.aligned(df, *MODELS, keep_groups=True).collect()
    assert hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] and r["groups"].count(";") == r["n_groups"] - 1


def test_odd_input(spark, coders):
    docs = odd_documents(spark)
    got = al.report(docs, *MODELS).collect()
    assert len(got) == docs.count()
    zero = [r for r in got if r["doc_id"] in (3, 4)]
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in zero) and len(zero) == 2
    assert next(r for r in got if r["doc_id"] == 9)["n_a"] > 80_000
    assert al.report(docs.filter(F.lit(False)), *MODELS).count() == 0


def test_both_libraries_give_the_same_ids(coders, sf):
    side = coders[0]
    assert side.fast is not None
    slow = lambda t: side.coder.encode(" " + t, add_special_tokens=False).ids
    letters = [f"a{c}b {c} 1{c}1 {c}{c}.{c}\n" for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    blocks = ["".join(letters[i : i + 64]) for i in range(0, len(letters), 64)]
    docs = duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall()
    for t in TEXTS + blocks + [d[0] for d in docs if d[0]]:
        assert side.encode([t])[0] == slow(t)


def test_files_of_another_form_go_by_the_other_library():
    file = json.loads(MODELS[0])
    file["model"]["ignore_merges"] = True
    assert al.ByteLevel(json.dumps(file).encode()).fast is None
    file = json.loads(MODELS[0])
    file["model"]["merges"].reverse()
    assert al.ByteLevel(json.dumps(file).encode()).fast is None
