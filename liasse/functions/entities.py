"""Entity columns: match spans, normal forms, windows around a match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions.text import has_any

MARK = "\x01"
SPAN = "array<struct<start:int,end:int,raw:string>>"


def spans(text: Column, pattern: str) -> Column:
    """All matches with their positions, from one regex pass.

    The matches are fenced with a mark; splitting on it gives gap, match, gap,
    match, ... and their lengths give the positions.
    """
    safe = F.when(text.contains(MARK), F.translate(text, MARK, " ")).otherwise(text)
    parts = F.split(F.regexp_replace(safe, pattern, f"{MARK}$0{MARK}"), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"),
                     F.array().cast(SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        span = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("raw"))
        return F.struct(
            end.alias("at"),
            (~acc["hit"]).alias("hit"),
            F.when(acc["hit"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def normalize_phone(raw: Column, country: str = "+33") -> Column:
    """E.164 form; empty when under seven digits remain."""
    bare = F.replace(F.trim(raw), F.lit("(0)"), F.lit(""))
    s = F.regexp_replace(bare, r"[ .\-]", "")
    full = (
        F.when(s.startswith("00"), F.concat(F.lit("+"), F.substring(s, 3, 1_000)))
        .when(s.startswith("+"), s)
        .when(s.startswith("0"), F.concat(F.lit(country), F.substring(s, 2, 1_000)))
        .when(s.startswith("33"), F.concat(F.lit("+"), s))
        .when(F.length(s) <= 10, F.concat(F.lit(country), s))
        .otherwise(F.concat(F.lit("+"), s))
    )
    return F.when((s == "") | (F.length(full) < 8), "").otherwise(full)


def normalize_plate(raw: Column) -> Column:
    up = F.upper(F.trim(raw))
    tight = F.replace(up, F.lit(" "), F.lit(""))
    siv = r"^([A-Z]{2})(\d{3})([A-Z]{2})$"
    return F.when(tight.rlike(siv), F.regexp_replace(tight, siv, "$1-$2-$3")).otherwise(up)


def normalize_entity(kind: str, raw: Column) -> Column:
    """Normal form by kind; empty when the raw text does not hold up."""
    if kind == "phone":
        return normalize_phone(raw)
    if kind == "iban":
        tight = F.upper(F.regexp_replace(raw, r"(?U)\s+", ""))
        return F.when(tight.rlike(rules.IBAN), tight).otherwise("")
    if kind == "email":
        return F.when(raw.rlike(rules.EMAIL), F.lower(F.trim(raw))).otherwise("")
    if kind == "plate":
        return normalize_plate(raw)
    return raw


def _group(pattern: str, prefix: str = ""):
    def value(raw: Column) -> Column:
        got = F.regexp_extract(raw, pattern, 1)
        return F.concat(F.lit(prefix), got) if prefix else got

    return value


# kind -> list of (cheap test that must hold, pattern, value of a match)
MATCHERS = {
    "phone": [(lambda t: t.rlike(r"0[1-9]|33"), rules.PHONE, lambda r: normalize_entity("phone", r))],
    "iban": [(lambda t: t.rlike(r"[A-Z]{2}\d"), rules.IBAN, lambda r: normalize_entity("iban", r))],
    "email": [(lambda t: t.contains("@"), rules.EMAIL, lambda r: normalize_entity("email", r))],
    "ip": [(lambda t: t.rlike(r"\d\.\d"), rules.IPV4, lambda r: r)],
    "plate": [(lambda t: t.rlike(r"(?U)\d[\s-]?[A-Z]"), rules.PLATE, lambda r: normalize_entity("plate", r))],
    "telegram": [
        (lambda t: t.contains("@"), rules.TELEGRAM_HANDLE, _group(rules.TELEGRAM_HANDLE, "@")),
        (lambda t: F.lower(t).contains(".me/"), rules.TELEGRAM_LINK, _group(rules.TELEGRAM_LINK, "@")),
    ],
    "whatsapp": [(lambda t: has_any(F.lower(t), ["wa.me", "whatsapp"]), rules.WHATSAPP_LINK, lambda r: r)],
    "snapchat": [
        (lambda t: F.lower(t).contains("snapchat.com"), rules.SNAPCHAT_LINK, _group(rules.SNAPCHAT_LINK)),
        (lambda t: F.lower(t).contains("snap"), rules.SNAPCHAT_USER, lambda r: r),
    ],
}


def matches(text: Column, kind: str) -> Column:
    """All matches of one kind as ``array<struct<kind, rule, start, end, raw, value>>``."""
    out = []
    for i, (test, pattern, value) in enumerate(MATCHERS[kind]):
        found = F.transform(
            spans(text, pattern),
            lambda s: F.struct(
                F.lit(kind).alias("kind"), F.lit(i).alias("rule"), s["start"].alias("start"),
                s["end"].alias("end"), s["raw"].alias("raw"), value(s["raw"]).alias("value"),
            ),
        )
        out.append(F.when(test(text), F.filter(found, lambda m: m["value"] != "")))
    none = F.array().cast("array<struct<kind:string,rule:int,start:int,end:int,raw:string,value:string>>")
    return F.concat(*[F.coalesce(m, none) for m in out])
