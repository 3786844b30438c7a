"""A small table with nulls, empty and long texts, repeated rows, and extra columns whose names are also used inside."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _items int, key string, score double, row int, words string"
LONG = " ".join(f"wort{i % 977} und{i % 31}" for i in range(40_000))


def odd_documents(spark):
    base = "the quick brown fox jumps over the lazy dog and runs through the quiet forest until the evening comes and the stars appear"
    near = base.replace("quiet", "silent") + " " + " ".join(f"tail{i}" for i in range(2))
    rows = [
        (1, base + " " + " ".join(f"more{i}" for i in range(60))), (2, base + " " + " ".join(f"more{i}" for i in range(59))), (3, None), (4, ""), (5, "   \n "),
        (6, "word"), (7, "word"), (None, "without an id there is still a text here"), (None, None), (8, near), (8, near), (9, LONG),
        (10, "!!! ... ***"), (11, "token = \"0123456789abcdef0123456789abcdef\" and\nnothing else"), (12, "ßẞ İ é \U0001f600 中文 文字"),
    ]
    return spark.createDataFrame([(i, t, None, "s", None, 1, "k", 0.5, 2, None) for i, t in rows], SCHEMA)
