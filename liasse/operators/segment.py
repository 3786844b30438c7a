"""Document tagging and segmentation into logical units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions import dates
from liasse.functions.text import clean_ws, fold_chars, has_any, let, sha1_unit_id, strip_ends, strip_line
from liasse.session import staged
from liasse.plans.ordering import first_rows, page_block, running_total

DOC = ["case_id", "source"]


def first_pages(pages: DataFrame, n: int = 2) -> DataFrame:
    """One row per document with the text of its first ``n`` pages."""
    head = first_rows(pages, DOC, ["page"], n)
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return head.groupBy(*DOC).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " \n").alias("head_text")
    )


def tag_dates(docs: DataFrame, text: str = "head_text", source: str = "source",
              loose_filename: bool = False) -> DataFrame:
    """Document date: text rules first, then the file name.

    Adds ``doc_date`` (ISO text), ``date_rule`` and ``doc_date_d`` (null where
    the day does not exist). ``loose_filename`` reads ``_`` as a separator.
    """
    name = F.translate(F.col(source), "_", " ") if loose_filename else F.col(source)

    def first_hit(rules_) -> Column:
        """The first rule that gives a date; the later ones are then not tried."""
        def named(rule):
            return lambda x: F.when(x.isNotNull(), F.struct(F.lit(rule).alias("rule"), x.alias("iso")))

        return F.coalesce(*[let(iso, named(rule)) for rule, iso in rules_])

    from_text = let(dates.without_times(strip_ends(F.coalesce(text, F.lit("")))), lambda t: first_hit(dates.text_dates(t)))
    return (
        docs.withColumn("_hit", F.coalesce(from_text, first_hit(dates.file_dates(name))))
        .withColumn("doc_date", F.col("_hit.iso"))
        .withColumn("date_rule", F.col("_hit.rule"))
        .withColumn("doc_date_d", F.try_to_date("doc_date", "yyyy-MM-dd"))
        .drop("_hit")
    )


def tag_types(docs: DataFrame, text: str = "head_text", source: str = "source") -> DataFrame:
    """Document type: the first rule group found in header or file name."""
    blob = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(source, F.lit(""))))
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(rules.DOC_TYPES):
        out = F.when(has_any(F.col("_blob"), rules.DOC_TYPE_CUES[kind]) & F.col("_blob").rlike("(?U)" + pattern), kind).otherwise(out)
    return docs.withColumn("_blob", blob).withColumn(
        "doc_type", F.coalesce(out, F.lit("document"))).drop("_blob")


#: ends of lines beside the usual one
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def page_lines(text: Column) -> Column:
    """Trimmed non-empty lines of a page."""
    whole = F.coalesce(text, F.lit(""))
    parts = F.split(F.when(has_any(whole, list(LINE_ENDS)), F.translate(whole, LINE_ENDS, "\n" * len(LINE_ENDS))).otherwise(whole), "\n")
    return F.filter(F.transform(parts, strip_line), lambda x: x != "")


def _form_score(lines: Column) -> tuple[Column, Column]:
    head = fold_chars(F.array_join(F.slice(lines, 1, 30), "\n"))
    found = let(head, lambda h: F.struct(
        F.when(has_any(h, [":", "-"]), sum(((h.contains(cue) & h.rlike(p)).cast("int") for p, cue in zip(rules.FORM_FIELDS, rules.FORM_CUES, strict=True)), F.lit(0)))
        .otherwise(0).alias("n"),
        (h.contains("filiation") & h.rlike(rules.FORM_FILIATION)).alias("filiation")))
    return found["n"], let(found, lambda f: (f["n"] >= 3) | ((f["n"] >= 2) & f["filiation"]))


def score_forms(pages: DataFrame) -> DataFrame:
    """Count identity-form labels in the first 30 lines of a page."""
    score, is_form = _form_score(F.col("_lines"))
    return (
        pages.withColumn("_lines", page_lines(F.col("text")))
        .withColumn("form_score", score)
        .withColumn("is_form", is_form)
        .drop("_lines")
    )


def detect_titles(pages: DataFrame) -> DataFrame:
    """Unit title in the first 12 lines: known motif, then form, then a mostly upper-case line."""
    head = F.slice("_lines", 1, 12)
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    capitals = lambda x: F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    first = lambda arr: F.try_element_at(arr, F.lit(1))
    # a cheap look for any word of the motifs spares most lines the full patterns
    cue = lambda x: let(fold_chars(x), lambda low: has_any(low, rules.TITLE_CUES.split("|")))
    motif = first(F.filter(head, lambda x: cue(x) & x.rlike(rules.TITLE_MOTIFS)))
    shout = first(F.filter(head, lambda x: F.length(x).between(8, 180) & (letters(x) > 0)
                           & (capitals(x) >= 0.6 * letters(x))))
    _, is_form = _form_score(F.col("_lines"))
    return (
        pages.withColumn("_lines", page_lines(F.col("text")))
        .withColumn("title", F.coalesce(motif, F.when(is_form, rules.FORM_TITLE), shout))
        .drop("_lines")
    )


def number_pages(pages: DataFrame) -> DataFrame:
    """case_id, source, page, title, unit_index: a titled page that follows another opens a unit.

    Titles are staged without the texts, and only this narrow table goes
    through the running count. The count goes over page blocks, so one very
    long document does not land in one task.
    """
    # rows of one page number count as one page: the numbering has one row for each
    titled = staged(detect_titles(pages).groupBy(*DOC, "page").agg(F.min("title").alias("title")))
    opening = titled.groupBy(*DOC).agg(F.min("page").alias("_first"))
    flagged = titled.join(opening, DOC).withColumn(
        "_opens", (F.col("title").isNotNull() & (F.col("page") > F.col("_first"))).cast("int"))
    counted = running_total(flagged, DOC, ["page"], F.col("_opens"), page_block("page"), "_seen")
    return counted.withColumn("unit_index", (F.col("_seen") + F.col("_opens")).cast("int")).drop(
        "_first", "_opens", "_seen")


def number_units(pages: DataFrame) -> DataFrame:
    """Pages with ``title`` and ``unit_index``."""
    return pages.join(number_pages(pages), [*DOC, "page"])


def units_of(numbered: DataFrame) -> DataFrame:
    """One row per unit. A first unit without title is called after the file."""
    units = numbered.groupBy(*DOC, "unit_index").agg(
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.min_by("title", "page").alias("_title"),
    )
    later = units.filter("unit_index = 1").select(*DOC, F.lit(True).alias("_later"))
    named = units.join(later, DOC, "left")
    title = F.coalesce("_title", F.when(F.col("_later"), F.concat("source", F.lit(" (partie 1)")))
                       .otherwise(F.col("source")))
    return named.withColumn("unit_title", title).drop("_title", "_later").withColumn(
        "unit_id", sha1_unit_id(F.col("source"), F.col("unit_index"), F.col("page_start"),
                                F.col("page_end"), F.col("unit_title")))


def segment_units(pages: DataFrame) -> DataFrame:
    """Pages to logical units."""
    return units_of(number_pages(pages))


def tag_unit_type(units: DataFrame, doc_type: str = "doc_type") -> DataFrame:
    """Unit type from title words, else the document type."""
    low = F.lower("unit_title")
    out = F.coalesce(F.when(F.trim(doc_type) != "", F.trim(doc_type)), F.lit("document"))
    for kind, keys in reversed(rules.UNIT_TYPES):
        test = F.lit(False)
        for k in keys:
            test = test | low.contains(k)
        out = F.when(test, kind).otherwise(out)
    return units.withColumn("unit_type", out)


def tag_documents(pages: DataFrame) -> DataFrame:
    """One row per document with its date and type."""
    return tag_types(tag_dates(first_pages(pages))).drop("head_text")


def unit_heads(numbered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` page texts of each unit, in order, as an array."""
    head = first_rows(numbered, [*DOC, "unit_index"], ["page"], n)
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return head.groupBy(*DOC, "unit_index").agg(F.transform(parts, lambda p: p["text"]).alias("head"))


def anchor_text(head: Column) -> Column:
    """Text of a unit's anchor chunk; null where its first pages are empty."""
    pages = F.filter(F.slice(head, 1, rules.ANCHOR_PAGES), lambda t: t != "")
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def write(body: Column) -> Column:
        return F.when(body != "", F.concat_ws(
            "\n",
            F.lit("ACTE / UNITÉ (ancre de retrieval — extrait source, non résumé)"),
            F.concat(F.lit("SOURCE: "), word("source")),
            F.concat(F.lit("DOC_TYPE: "), word("doc_type")),
            F.concat(F.lit("DOC_DATE: "), word("doc_date")),
            F.concat(F.lit("UNIT_TITLE: "), word("unit_title")),
            F.concat(F.lit("UNIT_TYPE: "), word("unit_type")),
            F.concat(F.lit("PAGES_UNIT: "), word("page_start"), F.lit("-"), word("page_end")),
            F.lit(""),
            F.rtrim(F.left(body, F.lit(rules.ANCHOR_CHARS)))))

    return let(clean_ws(F.array_join(pages, "\n")), write)


def unit_anchors(numbered: DataFrame, units: DataFrame) -> DataFrame:
    """Anchor chunk per unit: a header and the start of its first pages."""
    heads = unit_heads(numbered, rules.ANCHOR_PAGES)
    # exploded as it is written: a filter on a column of texts would write them twice
    return units.join(heads, [*DOC, "unit_index"]).select(*units.columns, F.explode(F.array_compact(F.array(anchor_text(F.col("head"))))).alias("text"))


def unit_text(pages: DataFrame, keys: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Readable text of each unit: header with type and date, then marked pages.

    ``keys`` (case_id, source, unit_index) limits the units. Bodies are whole;
    a reader may ask for their first ``cap`` characters.
    """
    from liasse.plans.ordering import capped_concat

    flags = staged(number_pages(pages))
    units = units_of(flags)
    if keys is not None:
        flags = flags.join(keys, [*DOC, "unit_index"], "left_semi")
        units = units.join(keys, [*DOC, "unit_index"], "left_semi")
    numbered = staged(pages.join(flags, [*DOC, "page"]))
    heads = unit_heads(numbered, 2).withColumn("head_text", F.array_join("head", " \n")).drop("head")
    tags = tag_types(tag_dates(heads)).drop("head_text", "date_rule", "doc_date_d")
    body = capped_concat(
        numbered.withColumn("_p", F.when(
            strip_ends(F.coalesce("text", F.lit(""))) != "",
            F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit("]\n"), strip_ends(F.col("text"))))),
        [*DOC, "unit_index"], ["page"], page_block("page"), "_p", cap, out="body")
    meta = F.concat_ws(", ", "doc_type", "doc_date", "source")
    empty = F.lit("(Unité logique vide ou texte illisible)")
    return (
        units.join(tags, [*DOC, "unit_index"]).join(body, [*DOC, "unit_index"], "left")
        .withColumn("text", F.concat(F.col("unit_title"), F.lit("\n("), meta, F.lit(")\n\n"),
                                     F.coalesce("body", empty), F.lit("\n")))
        .drop("body")
    )


def unit_fallback(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Chunk for a unit index that matches no unit: by local id, else by place in the source.

    ``keys`` has case_id, source, unit_index. Places are counted over blocks
    of ``chunk_ord``.
    """
    wanted = keys.select(*DOC, F.col("unit_index").alias("_k"))
    mine = chunks.join(wanted.select(*DOC).distinct(), DOC, "left_semi")
    local = (
        mine.join(wanted, (mine.case_id == wanted.case_id) & (mine.source == wanted.source)
                  & (mine.local_chunk_id == wanted["_k"]))
        .groupBy(mine.case_id, mine.source, "_k")
        .agg(F.max_by(F.struct("chunk_ord", "page", "text"), "chunk_ord").alias("_local"))
    )
    placed = running_total(mine.select(*DOC, "chunk_ord", "page", "text"), DOC, ["chunk_ord"], F.lit(1),
                           page_block("chunk_ord", 4096), "_k")
    placed = placed.select(*DOC, F.col("_k").cast("int").alias("_k"),
                           F.struct("chunk_ord", "page", "text").alias("_place"))
    hit = F.coalesce("_local", "_place")
    body = F.when(strip_ends(hit["text"]) == "", "(extrait vide)").otherwise(strip_ends(hit["text"]))
    page = F.when(hit["page"].isNotNull(), F.concat(F.lit("(page "), hit["page"].cast("string"), F.lit(")\n")))
    return (
        wanted.join(local, [*DOC, "_k"], "left").join(placed, [*DOC, "_k"], "left")
        .select(
            *DOC, F.col("_k").alias("unit_index"), hit["chunk_ord"].alias("chunk_ord"),
            F.when(hit.isNotNull(), F.concat(
                F.col("source"), F.lit(" — extrait "), F.col("_k").cast("string"), F.lit("\n"),
                F.coalesce(page, F.lit("")), F.lit("\n"), body, F.lit("\n"))).alias("text"))
    )
