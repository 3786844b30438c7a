"""Text columns: cleaning, folding, sentences, chunk packing, budgets, audits.

Everything here is a Column built from JVM-side functions; the only Python
function is the optional full NFKC pass for corpora outside the Latin range.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NON_ASCII = r"[^\x00-\x7F]"
#: white space that is collapsed, and all kinds of it
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
ANY_SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# ranges in which one-letter compatibility and accent mappings are generated
_RANGES = [(0x80, 0x2E80), (0x3000, 0x3001), (0xFF01, 0xFF5F)]
# compatibility characters that expand to several letters
_EXPANDING_RANGES = [(0xBC, 0xBF), (0x132, 0x134), (0x149, 0x14A), (0x2026, 0x2027),
                     (0x2116, 0x2117), (0x2121, 0x2123), (0xFB00, 0xFB07)]
_EXPANDING = [c for lo, hi in _EXPANDING_RANGES for c in map(chr, range(lo, hi))]


def _strip_marks(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def _table(rule) -> tuple[str, str]:
    """One-to-one character mapping made from a rule, as the two ``translate`` strings."""
    src, dst = [], []
    for lo, hi in _RANGES:
        for c in map(chr, range(lo, hi)):
            out = " " if c.isspace() else rule(c)
            if len(out) == 1 and out != c:
                src.append(c)
                dst.append(out)
    return "".join(src), "".join(dst)


_COMPAT = _table(lambda c: unicodedata.normalize("NFKC", c))
_FOLD_LOWER = _table(lambda c: _strip_marks(unicodedata.normalize("NFKC", c).lower()))
_FOLD_CASED = _table(lambda c: _strip_marks(unicodedata.normalize("NFKC", c)))


def _spaced(table: tuple[str, str]) -> tuple[str, str]:
    """The table, which also makes a space of all white space that is collapsed."""
    return table[0] + SPACES, table[1] + " " * len(SPACES)


_COMPAT_SPACED, _FOLD_LOWER_SPACED, _FOLD_CASED_SPACED = _spaced(_COMPAT), _spaced(_FOLD_LOWER), _spaced(_FOLD_CASED)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def let(col: Column, body) -> Column:
    """``body`` of a value that is computed once (lambda bodies would compute it again each time)."""
    return F.element_at(F.transform(F.array(col), body), 1)


def has_any(col: Column, terms: list[str]) -> Column:
    """Does the text contain one of a fixed list of strings?"""
    out = F.lit(False)
    for t in terms:
        out = out | col.contains(t)
    return out


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.length(col)


def _expand(col: Column) -> Column:
    """Letter by letter, only for texts that hold a character with a longer form."""
    table = F.create_map(*[F.lit(x) for c in _EXPANDING for x in (c, unicodedata.normalize("NFKC", c))])
    letters = F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    return F.when(has_any(col, _EXPANDING), F.array_join(letters, "")).otherwise(col)


def squeeze(col: Column) -> Column:
    """Runs of spaces to one, ends trimmed; patterns are only run where there are two spaces."""
    return F.trim(F.when(col.contains("  "), F.regexp_replace(col, r"\x20{2,}+", " ")).otherwise(col))


def collapse(col: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return let(F.translate(col, SPACES, " " * len(SPACES)), squeeze)


def clean_ws(col: Column, full_nfkc: bool = False) -> Column:
    """Compatibility-normalise, drop non-breaking spaces, collapse white space."""
    if full_nfkc:
        col = _nfkc(col)
    return let(F.translate(_expand(col), *_COMPAT_SPACED), squeeze)


def norm_text(col: Column, lower: bool = True) -> Column:
    """Case and accent folding; ``lower=False`` keeps the case."""
    base = F.lower(col) if lower else col
    table = _FOLD_LOWER_SPACED if lower else _FOLD_CASED_SPACED
    # letters that expand, what they expand to, and marks aren't in the table, so a text that is ASCII behind it has none
    folded = let(F.translate(base, *table), lambda t: F.when(is_ascii(t), t).otherwise(F.regexp_replace(_expand(t), r"\p{Mn}+", "")))
    return let(F.coalesce(folded, F.lit("")), squeeze)


def fold_chars(col: Column) -> Column:
    """Lower case and accents folded letter for letter, so positions stay valid."""
    low = F.lower(col)
    return F.when(is_ascii(col), low).otherwise(F.translate(low, *_FOLD_LOWER))


def tokens(col: Column) -> Column:
    """White-space tokens of the folded text."""
    return F.filter(F.split(norm_text(col), " "), lambda t: t != "")


def sentences(col: Column) -> Column:
    """Sentences of the cleaned text, each keeping its end mark."""
    # a cleaned text has no line end, so these mark the ends of sentences
    marked = clean_ws(col)
    for end in ".!?":
        marked = F.replace(marked, F.lit(end), F.lit(end + "\n"))
    parts = F.split(marked, "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def sentences_wrapped(col: Column) -> Column:
    """Sentences for display: those over 300 characters wrap at the last space past 120."""
    wrap = r"(?s)\G\s*+(?=.{301})(.{120,299})(?= )|\G\s*+.+$"
    parts = F.transform(F.split(col, r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s))
    pieces = F.transform(
        F.filter(parts, lambda s: s != ""),
        lambda s: F.when(F.length(s) > 300, F.regexp_extract_all(s, F.lit(wrap), F.lit(0)))
        .otherwise(F.array(s)),
    )
    return F.filter(F.transform(F.flatten(pieces), lambda s: F.trim(s)), lambda s: s != "")


def pack_chunks(sents: Column, size: int = 800, overlap: int = 120) -> Column:
    """Pack sentences greedily; each chunk opens with the tail of the one before."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),
        F.lit(0).alias("used"),
    )

    def step(acc: Column, s: Column) -> Column:
        full = (acc["used"] + F.length(s) > size) & (acc["cur"] != "")
        tail = F.trim(F.right(acc["cur"], F.lit(overlap))) if overlap > 0 else F.lit("")
        kept = F.when(full, tail).otherwise(acc["cur"])
        used = F.when(full, F.length(tail)).otherwise(acc["used"])
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(kept == "", s).otherwise(F.concat(kept, F.lit(" "), s)).alias("cur"),
            (used + F.length(s) + 1).alias("used"),
        )

    return F.aggregate(
        sents,
        start,
        step,
        lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])),
    )


def embed_prefix(col: Column, kind: str) -> Column:
    """``query:`` / ``passage:`` prefix for the embedding model, unless already there."""
    prefix = f"{kind}:"
    return F.when(norm_text(col).startswith(prefix), col).otherwise(
        F.trim(F.concat(F.lit(prefix + " "), col))
    )


def fix_ocr(col: Column) -> Column:
    """Zero read for the letter O in form labels."""
    # fixed values
    repairs = [("N0M", "NOM"), ("PRÉN0M", "PRÉNOM"), ("PREN0M", "PRENOM"), ("D0MICILE", "DOMICILE")]
    for wrong, right in repairs:
        col = F.replace(col, F.lit(wrong), F.lit(right))
    return col


def approx_tokens(col: Column) -> Column:
    """About four characters per token, at least one for a non-empty text."""
    n = F.length(F.coalesce(col, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def truncate_tokens(col: Column, max_tokens: Column) -> Column:
    return F.when(max_tokens <= 0, "").otherwise(F.left(col, max_tokens * 4))


def snippet(text: Column, start: Column, end: Column, ctx: int = 120, cap: int | None = 280) -> Column:
    """The span with ``ctx`` characters on both sides; cleaned and cut when ``cap`` is given."""
    lo = F.greatest(start - ctx, F.lit(0))
    hi = F.least(end + ctx, F.length(text))
    piece = F.substring(text, lo + 1, hi - lo)
    if cap is None:
        return F.regexp_replace(piece, r"(?U)^\s+|\s+$", "")
    return let(clean_ws(piece), lambda clean: F.when(F.length(clean) > cap, F.concat(F.left(clean, F.lit(cap)), F.lit("…"))).otherwise(clean))


def safe_context(col: Column, cap: int = 40_000) -> Column:
    """HTML-escape a context and cap it."""
    # fixed values
    escapes = [("```", "```​"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
               ('"', "&quot;"), ("'", "&#x27;")]
    out = F.coalesce(col, F.lit(""))
    for raw, safe in escapes:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.when(
        F.length(out) > cap, F.concat(F.left(out, F.lit(cap)), F.lit("\n...[contexte tronqué]"))
    ).otherwise(out)


def extract_json(col: Column, schema: str) -> Column:
    """JSON object inside a noisy text, null where there is none that parses."""
    body = F.regexp_extract(col, r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(body, "$").isNotNull(), F.from_json(body, schema))


def strip_ends(col: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def strip_line(col: Column) -> Column:
    """:func:`strip_ends` of a short text: one that begins and ends with a visible ASCII character stays as it is."""
    seen = lambda c: c.between("!", "~")
    return F.when(seen(F.left(col, F.lit(1))) & seen(F.right(col, F.lit(1))), col).otherwise(strip_ends(col))


def strip_fences(col: Column) -> Column:
    """Drop a byte-order mark and one enclosing code fence."""
    bare = strip_ends(F.replace(col, F.lit("﻿"), F.lit("")))
    inner = F.regexp_extract(bare, r"(?s)^```[^\n]*(?:\n(.*))?\n```[^\n]*$", 1)
    fenced = bare.rlike(r"(?s)^```[^\n]*\n(.*\n)?```[^\n]*$")
    return F.when(fenced, strip_ends(inner)).otherwise(bare)


def looks_truncated(col: Column, short_is_truncated: bool) -> Column:
    """Does an answer seem cut off? Short texts count as the flag says."""
    text = F.coalesce(col, F.lit(""))
    tail = F.regexp_replace(text, r"(?U)\s+$", "")
    return (
        F.when(text == "", True)
        .when(F.length(text) < 200, short_is_truncated)
        .otherwise(~tail.rlike(r"[.!?»]$"))
    )


def citation(source: Column, page: Column) -> Column:
    """``source p.N``."""
    src = F.when(F.coalesce(source, F.lit("")) == "", "?").otherwise(source)
    return F.when(page.isNull(), src).otherwise(F.concat(src, F.lit(" p."), page.cast("string")))


def clean_value(col: Column, cap: int = 450) -> Column:
    flat = let(F.translate(col, ANY_SPACES, " " * len(ANY_SPACES)), squeeze)
    return F.rtrim(F.left(flat, F.lit(cap)))


def alias_array(col: Column, person: Column) -> Column:
    """Split an alias string, drop the main name and repeats, keep the order."""
    parts = F.filter(
        F.transform(F.split(F.coalesce(col, F.lit("")), r"[;,/|]"), lambda a: F.trim(a)),
        lambda a: (a != "") & (F.lower(a) != F.lower(person)),
    )
    low = F.transform(parts, F.lower)
    return F.filter(parts, lambda a, i: F.array_position(low, F.lower(a)) == i + 1)


def sha1_unit_id(source: Column, index: Column, page_start: Column, page_end: Column, title: Column) -> Column:
    """Stable id of a logical unit."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return F.sha1(
        F.concat(source, F.lit("|u"), zero(index), F.lit("|p"), zero(page_start), F.lit("-"),
                 zero(page_end), F.lit("|"), F.coalesce(title, F.lit("")))
    )
