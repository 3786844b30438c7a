"""Secret scans: patterned secrets and strings of high entropy, as column code.

Patterned secrets (assignments, access keys, hex runs) are leftmost,
non-overlapping matches per kind. High-entropy spans come from candidate
strings: runs of one character class, at least a window long. Over each
candidate a window of ``WINDOW`` characters slides; one count per symbol is
kept, and each step takes one from the count of the symbol that leaves and
adds one to that of the symbol that enters. The Shannon entropy follows from
the sum of c log2 c over the counts; the sum is kept in units of 2**-20 bits,
as a whole number, so that every engine gets the same one. Windows with at
least the class's bits form spans, overlapping ones are joined. An allow-list
suppresses candidates, and spans inside a patterned secret are not repeated.

Positions are in code points, the end is exclusive. Results for odd input:
null text counts as empty and has no spans; texts of any length are read
whole; rows are neither dropped nor merged; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liasse.functions.text import let

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
UNIT = 1 << 20
STEP = 256
BLOCK = 2048
HEX_DIGITS = "0123456789ABCDEF"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class: the pattern of its candidates, its symbols, the bits from which a window counts.
CLASSES = {
    "hex": (rf"[0-9A-Fa-f]{{{WINDOW},}}", HEX_DIGITS, 3.0),
    "base64": (rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}", BASE64, 3.9),
}
#: Candidates that are suppressed: letters alone, digits alone, ids of the UUID form, stated examples.
ALLOWED = [
    r"^[A-Za-z]+$", r"^[0-9]+$", r"^[+/_=-]+$", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|changeme|xxxx",
]
SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _running(df: DataFrame, out: str, values: Column, merge: Callable) -> DataFrame:
    """``df`` with the running fold of an array of whole numbers.

    A fold that grows an array copies it at every step, so blocks of ``STEP``
    values are folded by themselves and then moved on by what stands before
    them.
    """
    def fold(block: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("out"))
        new = lambda s, v: F.coalesce(merge(s["last"], v), v).cast("int")
        return F.aggregate(block, start, lambda s, v: F.struct(new(s, v).alias("last"), F.concat(s["out"], F.array(new(s, v))).alias("out")))["out"]

    cuts = lambda vs: F.sequence(F.lit(1), F.greatest(F.size(vs), F.lit(1)), F.lit(STEP))
    df = df.withColumn("_blocks", let(values, lambda vs: F.transform(cuts(vs), lambda c: fold(F.slice(vs, c, F.lit(STEP))))))
    df = df.withColumn("_tops", fold(F.transform("_blocks", lambda x: F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0)))))
    moved = let(F.col("_tops"), lambda t: F.flatten(F.transform("_blocks", lambda x, k: F.when(k == 0, x).otherwise(
        F.transform(x, lambda v: merge(F.get(t, k - 1), v).cast("int"))))))
    return df.withColumn(out, moved).drop("_blocks", "_tops")


def _placed(df: DataFrame, out: str, text: Column, pattern: str, least: int = 0, group: int = 0) -> DataFrame:
    """``df`` with (start, stop, piece) of all matches whose ``group`` has at least ``least`` characters."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_found", F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    gaps = F.when(F.size("_found") > 0, F.slice(F.split(text, pattern, -1), 1, F.size("_found"))).otherwise(none)
    df = _running(df, "_ends", F.zip_with(gaps, "_found", lambda gap, hit: F.length(gap) + F.length(hit)), lambda a, b: a + b)
    every = let(F.col("_ends"), lambda ends: F.transform("_found", lambda hit, i: F.struct(
        (F.get(ends, i) - F.length(hit)).alias("start"), F.get(ends, i).alias("stop"), hit.alias("piece"))))
    df = df.withColumn(out, every)
    if group:
        sizes = F.when(F.size("_found") > 0, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)).otherwise(F.array().cast("array<int>"))
        df = df.withColumn(out, let(sizes, lambda n: F.filter(out, lambda x, i: F.get(n, i) >= least)))
    return df.drop("_found", "_ends")


def _outside(df: DataFrame, out: str, base: str, spans: Column) -> DataFrame:
    """``df`` with the spans (start, stop, piece), in order, that no span of ``base`` holds.

    Of the base spans that begin no later than a span, one holds it if the
    largest end among them is not before its end.
    """
    one = lambda s, own, piece: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["stop"].alias("stop"), piece.alias("piece"))
    df = df.withColumn("_both", F.array_sort(F.concat(F.transform(base, lambda s: one(s, 0, F.lit(""))), F.transform(spans, lambda s: one(s, 1, s["piece"])))))
    df = _running(df, "_far", F.transform("_both", lambda x: F.when(x["own"] == 0, x["stop"]).otherwise(-1)), F.greatest)
    free = let(F.col("_far"), lambda far: F.filter("_both", lambda x, i: (x["own"] == 1) & (F.get(far, i) < x["stop"])))
    return df.withColumn(out, free).drop("_both", "_far")


def _joined(df: DataFrame, out: str, spans: Column) -> DataFrame:
    """``df`` with sorted spans, those that meet made one: one begins where a start is beyond all ends before it."""
    df = _running(df.withColumn("_sorted", F.array_sort(spans)), "_far", F.transform(F.array_sort(spans), lambda x: x["stop"]), F.greatest)
    begins = let(F.col("_far"), lambda far: F.filter(
        F.transform("_sorted", lambda x, i: F.when((i == 0) | (x["start"] > F.get(far, i - 1)), i)), lambda i: i.isNotNull()))
    df = df.withColumn("_begins", begins)
    runs = let(F.struct(F.col("_sorted").alias("s"), F.col("_far").alias("f"), F.col("_begins").alias("b")), lambda c: F.transform(c["b"], lambda i, k: F.struct(
        F.get(c["s"], i)["start"].alias("start"), F.get(c["s"], i)["kind"].alias("kind"),
        F.get(c["f"], F.coalesce(F.get(c["b"], k + 1), F.size(c["s"])) - 1).alias("stop"))))
    return df.withColumn(out, runs.cast(SPANS)).drop("_sorted", "_far", "_begins")


def weights() -> list[int]:
    """c log2 c in units, for c from 0 to one more than a window: a symbol enters before another one leaves."""
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 2)]


def limit(bits: float) -> int:
    """The largest sum of c log2 c with which a window still has ``bits``."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def _hot_block(places: Column, symbols: str, bits: float) -> Column:
    """(start, stop) of the windows of a block of symbols that have the bits, those that meet made one, by incremental counts."""
    table = F.array(*[F.lit(w) for w in weights()])
    value = lambda c: F.element_at(table, c + 1)
    zero = F.array_repeat(F.lit(0), len(symbols))

    def moved(s: Column, place: Column, by: int) -> Column:
        """One count changed, and the sum with it."""
        old = F.element_at(s["counts"], place)
        return F.struct(
            F.concat(F.slice(s["counts"], F.lit(1), place - 1), F.array(old + by),
                     F.slice(s["counts"], place + 1, F.lit(len(symbols)))).alias("counts"),
            (s["sum"] - value(old) + value(old + by)).alias("sum"))

    def closed(s: Column) -> Column:
        return F.when(s["begin"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["begin"].alias("start"), s["end"].alias("stop")))))

    def step(s: Column, i: Column) -> Column:
        def noted(x: Column) -> Column:
            hot = (i >= WINDOW) & (x["sum"] <= limit(bits))
            new = hot & (i - WINDOW > s["end"])
            return F.struct(
                x["counts"].alias("counts"), x["sum"].alias("sum"), F.when(new, i - WINDOW).otherwise(s["begin"]).alias("begin"),
                F.when(hot, i).otherwise(s["end"]).alias("end"), F.when(new, closed(s)).otherwise(s["done"]).alias("done"))

        added = F.transform(F.array(s), lambda x: moved(x, F.element_at(places, i), 1))
        slid = F.transform(added, lambda x: F.when(i > WINDOW, moved(x, F.element_at(places, F.greatest(i - WINDOW, F.lit(1))), -1)).otherwise(x))
        return F.element_at(F.transform(slid, noted), 1)

    begin = F.struct(zero.alias("counts"), F.lit(0).alias("sum"), F.lit(-1).alias("begin"), F.lit(-1).alias("end"),
                     F.array().cast("array<struct<start:int,stop:int>>").alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.size(places)), begin, step, closed)


def _entropy_spans(df: DataFrame, out: str, text: Column, name: str, base: str, allowed: list[str]) -> DataFrame:
    """``df`` with the spans of high entropy in the candidates of a class.

    A candidate's windows are gone through in blocks of ``BLOCK`` starts, so
    that what a fold has found so far stays short however long the candidate is.
    """
    pattern, symbols, bits = CLASSES[name]
    suppressed = "|".join(f"(?:{a})" for a in allowed)
    ok = lambda p: ~p["piece"].rlike(suppressed) if allowed else F.lit(True)
    df = _placed(df, "_candidates", text, pattern)
    df = _outside(df, "_open", base, F.filter("_candidates", ok))
    places = lambda p: F.slice(F.transform(F.split(F.upper(p["piece"]) if name == "hex" else p["piece"], ""),
                                           lambda ch: F.instr(F.lit(symbols), ch)), F.lit(1), F.length(p["piece"]))
    starts = lambda ps: F.sequence(F.lit(0), F.greatest(F.size(ps) - WINDOW, F.lit(0)), F.lit(BLOCK))
    parts = F.flatten(F.transform("_open", lambda p: let(places(p), lambda ps: F.transform(starts(ps), lambda at: F.struct(
        (p["start"] + at).alias("at"), F.slice(ps, at + 1, F.lit(BLOCK + WINDOW - 1)).alias("places"))))))
    df = df.withColumn("_parts", parts)
    hot = F.flatten(F.transform("_parts", lambda b: F.transform(_hot_block(b["places"], symbols, bits), lambda r: F.struct(
        (b["at"] + r["start"]).alias("start"), F.lit(3).alias("kind"), (b["at"] + r["stop"]).alias("stop")))))
    return df.withColumn(out, hot.cast(SPANS)).drop("_candidates", "_open", "_parts")


def found(df: DataFrame, text: str = "text", allowed: list[str] | None = None) -> DataFrame:
    """``df`` with ``_base`` and ``_spans``: arrays of (start, kind, stop), the second one with the high-entropy spans too."""
    allowed = ALLOWED if allowed is None else allowed
    t = F.coalesce(F.col(text), F.lit(""))
    as_span = lambda c, kind: F.transform(c, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["stop"].alias("stop"))).cast(SPANS)
    for kind, (pattern, least, group) in enumerate(((ASSIGN, 6, 2), (ACCESS, 0, 0), (HEX, 0, 0))):
        df = _placed(df, f"_of{kind}", t, pattern, least, group)
    df = df.withColumn("_base", F.array_sort(F.concat(*[as_span(f"_of{k}", k) for k in range(3)]))).drop("_of0", "_of1", "_of2")
    for name in CLASSES:
        df = _entropy_spans(df, f"_hot_{name}", t, name, "_base", allowed)
    df = _joined(df, "_hot", F.concat(*[f"_hot_{name}" for name in CLASSES])).drop(*[f"_hot_{name}" for name in CLASSES])
    df = _outside(df, "_extra", "_base", F.transform("_hot", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit("").alias("piece"))))
    return df.withColumn("_spans", F.array_sort(F.concat("_base", as_span("_extra", 3)))).drop("_hot", "_extra")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts per kind, digest of the patterned spans, all spans."""
    got = found(docs.select("doc_id", "text"), **options)
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                      F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"),
                      (F.size("_spans") - F.size("_base")).cast("long").alias("n_entropy"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span replaced by the mark; null texts stay null."""
    got = found(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")), "text", **options)
    got, t = _joined(got, "_runs", F.col("_spans")), F.col("text")

    def cut(runs: Column) -> Column:
        """What stands between the spans, with the mark for each; the text is cut per ``STEP`` spans first, so that no cut counts from its start."""
        before = lambda i: F.coalesce(F.get(runs, i - 1)["stop"], F.lit(0))
        last = F.element_at(runs, -1)["stop"]

        def block(c: Column) -> Column:
            stop = F.element_at(runs, F.least(c + STEP, F.size(runs)))["stop"]
            return let(before(c), lambda at: let(F.substring(t, at + 1, stop - at), lambda part: F.array_join(F.transform(
                F.slice(runs, c + 1, F.lit(STEP)), lambda x, i: F.concat(F.substring(part, before(c + i) - at + 1, x["start"] - before(c + i)), F.lit(mark))), "")))

        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(runs) - 1, F.lit(STEP)), block), ""), F.substring(t, last + 1, F.length(t)))

    kept = let(F.col("_runs"), cut)
    return got.select(*[F.when(F.size("_spans") > 0, kept).otherwise(t).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
