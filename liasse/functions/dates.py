"""Date columns: document dates from text or file name, fact dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions.text import let, norm_text


def month_number(name: Column) -> Column:
    """Number of a French month name, accents or not; null when it is none."""
    table = F.create_map(*[F.lit(x) for kv in rules.MONTHS.items() for x in kv])
    return F.try_element_at(table, norm_text(name))


def iso_clamped(y: Column, m: Column, d: Column) -> Column:
    """ISO string with the day held within the longest form of the month."""
    month = F.when((m < 1) | (m > 12), 1).otherwise(m)
    longest = F.element_at(F.array(*[F.lit(n) for n in rules.MONTH_DAYS]), month.cast("int"))
    day = F.greatest(F.lit(1), F.least(d, longest))
    return F.format_string("%04d-%02d-%02d", y.cast("int"), month.cast("int"), day.cast("int"))


def _first_in_range(matches: Column, ymd) -> Column:
    """First match whose month and day are in range, as ISO; null when there is none."""
    dated = F.transform(matches, lambda m: F.struct(*[c.cast("int").alias(n) for c, n in zip(ymd(m), "ymd")]))
    fit = F.filter(dated, lambda t: t["m"].between(1, 12) & t["d"].between(1, 31))
    return let(F.try_element_at(fit, F.lit(1)), lambda hit: F.when(
        hit.isNotNull(), iso_clamped(hit["y"], hit["m"], hit["d"])))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def text_dates(text: Column) -> list[tuple[str, Column]]:
    """The four text rules in order, each giving an ISO date or null.

    ``text`` should be a plain column or lambda variable; it is read four times.
    """

    def dmy(m):
        p = F.split(m, r"[./\-]")
        return p[2], p[1], p[0]

    def ymd(m):
        p = F.split(m, r"[\-/]")
        return p[0], p[1], p[2]

    def words(m):
        part = lambda i: F.regexp_extract(m, rules.DATE_WORDS, i)
        return part(3), F.coalesce(month_number(part(2)), F.lit(0)), part(1)

    def compact(m):
        return F.substring(m, 1, 4), F.substring(m, 5, 2), F.substring(m, 7, 2)

    return [
        ("text_dmy", _first_in_range(_all(text, rules.DATE_DMY), dmy)),
        ("text_ymd", _first_in_range(_all(text, rules.DATE_YMD), ymd)),
        ("text_words", _first_in_range(_all(text, rules.DATE_WORDS), words)),
        ("text_compact", _first_in_range(_all(text, rules.DATE_COMPACT), compact)),
    ]


def without_times(text: Column) -> Column:
    """``à 14h30`` behind a date would only get in the way."""
    return F.regexp_replace(text, rules.TIME_TRAIL, "")


def file_dates(name: Column) -> list[tuple[str, Column]]:
    """The four file-name rules in order. Out-of-range parts are clamped, not refused."""

    def rule(pattern, y, m, d, month=lambda c: c.cast("int")):
        part = lambda i: F.regexp_extract(name, pattern, i)
        mm = month(part(m))
        return F.when(name.rlike(pattern) & mm.isNotNull(),
                      iso_clamped(part(y).cast("int"), mm, part(d).cast("int")))

    return [
        ("file_iso", rule(rules.FILE_ISO, 1, 2, 3)),
        ("file_compact", rule(rules.FILE_COMPACT, 1, 2, 3)),
        ("file_dmy", rule(rules.FILE_DMY, 3, 2, 1)),
        ("file_words", rule(rules.DATE_WORDS.replace(r"(?:le\s+)?", ""), 3, 2, 1, month_number)),
    ]


def real_date(y: Column, m: Column, d: Column) -> Column:
    """ISO string of a date that exists, else null."""
    return F.date_format(
        F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")), "yyyy-MM-dd"
    )


def fact_date(text: Column) -> Column:
    """First date that exists, looking for 1/2/2020, then 2020-02-01, then 1 mars 2020."""
    num = lambda c: c.cast("int")

    def slash(m):
        p = F.split(m, "/")
        yy = num(p[2])
        return real_date(F.when(yy < 100, yy + 2000).otherwise(yy), num(p[1]), num(p[0]))

    def iso(m):
        p = F.split(m, "-")
        return real_date(num(p[0]), num(p[1]), num(p[2]))

    def words(m):
        p = F.split(m, r"(?U)\s+")
        mm = month_number(p[1])
        return F.when(mm.isNotNull(), real_date(num(p[2]), mm, num(p[0])))

    found = F.concat(
        F.transform(_all(text, rules.FACT_DATE_SLASH), slash),
        F.transform(_all(text, rules.FACT_DATE_ISO), iso),
        F.transform(_all(text, rules.FACT_DATE_WORDS), words),
    )
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def fact_time(text: Column) -> Column:
    """First valid time: 14h30, 14h, then 14:30, as ``HH:mm``."""

    def norm(m):
        p = F.split(F.replace(m, F.lit("h"), F.lit(":")), ":")
        hh = p[0].cast("int")
        mi = F.when(p[1] == "", 0).when(F.length(p[1]) == 2, p[1].cast("int"))
        return F.when(hh.between(0, 23) & mi.between(0, 59), F.format_string("%02d:%02d", hh, mi))

    found = F.transform(
        F.concat(_all(text, rules.FACT_TIME_H), _all(text, rules.FACT_TIME_COLON)), norm
    )
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))
