import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from liasse.llm import bpe, decontam
from liasse.llm import shingles as sh
from tests.llm.odd import odd_documents
from tests.llm.test_minhash import plain

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_pieces_as_the_library_merges_them():
    coder, rnd = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(5)
    letters = list("abcdeéüñ ß  \t\n'sllred019!?中  \x1c")
    for _ in range(2000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 80)))
        assert ids(coder.pack(t)) == ENCODING.encode_ordinary(t), t
    for t in ("ab" * 5000, "é" * 3001, " " * 999 + "x", "<|endoftext|>"):
        assert ids(coder.pack(t)) == ENCODING.encode_ordinary(t)


def test_long_texts_go_in_groups(monkeypatch):
    t = "Ein langer Text, 123 mal.\n" * 300
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    assert ids(bpe.Encoder(RANKS, public_tokenizers.PATTERN).pack(t)) == ENCODING.encode_ordinary(t)


def test_round_trip_of_odd_input(spark):
    docs = odd_documents(spark)
    raw = bpe.read_vocabulary(PATH)
    both = bpe.round_trip(docs, raw, public_tokenizers.PATTERN)
    apart = bpe.decode(bpe.encode(docs, raw, public_tokenizers.PATTERN), raw)
    texts = sorted((r["text"] or "") for r in docs.collect())
    for df in (both, apart):
        rows = df.collect()
        assert sorted(bytes(r["decoded"]).decode() for r in rows) == texts
        assert all(ids(r["ids"]) == ENCODING.encode_ordinary(bytes(r["decoded"]).decode()) for r in rows)
    assert bpe.digests(both.filter(F.lit(False))).count() == 0


def brute_passages(text, items):
    words, _ = sh.hashed_words(pa.array([plain(text)]))
    found = {}
    for i, t in items:
        own, _ = sh.hashed_words(pa.array([plain(t)]))
        n, w = own.size, min(5, own.size)
        want = sh.weighted(sh.rolled(own, w)) if n else None
        for at in range(words.size - n + 1 if n else 0):
            s = decontam.weighted_jaccard(sh.weighted(sh.rolled(words[at : at + n], w)), want)
            if s >= decontam.SIMILARITY:
                found[i] = max(s, found.get(i, 0))
    return found


def test_passages_as_by_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(3, 60)))) for i in range(40)]
    items += [(90, items[0][1]), (91, "one"), (92, ""), (93, None), (94, "x y x y x y x y x y x y")]
    rows = []
    for d in range(60):
        words = rng.choices(vocab, k=rng.randrange(0, 200))
        if d % 3:
            copy = items[rng.randrange(40)][1].split()
            for _ in range(d % 4):  # up to three changed words, at either end or inside
                copy[rng.choice([0, -1, rng.randrange(len(copy))])] = rng.choice(vocab)
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        rows.append((d, " ".join(words)))
    rows += [(100, "One, ONE one"), (101, "x y " * 30), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"], r["similarity"]) for r in decontam.report(docs, bench).collect()}
    for d, t in rows:
        want = brute_passages(t or "", [(i, x or "") for i, x in items])
        assert got[d][0] == bool(want) and got[d][1] == sorted(want), (d, want, got[d])
        assert got[d][2] is None if not want else abs(got[d][2] - max(want.values())) < 1e-9


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, bench = odd_documents(spark), spark.createDataFrame(
        [(1, "jumps over the lazy dog and runs through the quiet forest"), (2, "word"), (3, "nothing else")], "item_id long, text string")
    whole = sorted(map(str, decontam.report(docs, bench).collect()))
    kept = sorted(map(str, decontam.clean(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 1)
    assert sorted(map(str, decontam.report(docs, bench).collect())) == whole
    assert sorted(map(str, decontam.clean(docs, bench).collect())) == kept
    clean = decontam.clean(docs, bench)
    assert clean.schema == docs.schema and {r["doc_id"] for r in clean.collect()} == {3, 4, 5, None, 8, 9, 10, 12}
    assert decontam.report(docs, bench.filter(F.lit(False))).filter("contaminated").count() == 0
    assert decontam.report(docs.filter(F.lit(False)), bench).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    items = decontam.Items(8, list(range(50)), [rng.integers(0, 2**62, 8).astype(np.uint64) for _ in range(50)], decontam.RADIUS)
    prints = np.concatenate([items.prints ^ np.uint64(0b1011 << 7), rng.integers(0, 2**62, 200).astype(np.uint64)])
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(items.prints) if int(p ^ q).bit_count() <= decontam.RADIUS}
    assert set(items.near(prints)) == want


def test_plain_words_are_the_same_here_and_there(spark):
    texts = ["Ab_c d-é 12 x", "", "ẞ ß", "áb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(sh.plain_words(F.col("t")).alias("p"))
    assert [r["p"].split() for r in df.collect()][0] == ["ab_c", "d", "é", "12", "x"]
    assert re.fullmatch(r" ", df.collect()[1]["p"])


def test_items_without_an_id_contaminate(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b c {passage} d e"), (2, "nothing of the kind is in here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, "another item that no text holds at all"), (4, passage)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.report(docs, bench).collect()}
    assert got[1]["contaminated"] and got[1]["item_ids"] == [4, None] and not got[2]["contaminated"]
    assert [r["doc_id"] for r in decontam.clean(docs, bench.filter("item_id is null")).collect()] == [2]
