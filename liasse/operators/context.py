"""Bounded contexts from hits and conversations, source lists, citations, answer audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions.text import (
    approx_tokens, extract_json, looks_truncated, safe_context, strip_ends, strip_fences, truncate_tokens,
)
from liasse.plans.ordering import page_block, running_total
from liasse.schemas import QUERY


def _pack(rows: DataFrame, budget: int, text: str) -> DataFrame:
    """Texts of a query in rank order under a token budget; the crossing one is cut, the rest goes."""
    before = Window.partitionBy(*QUERY).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    need = approx_tokens(F.col(text))
    used = F.coalesce(F.sum("_need").over(before), F.lit(0))
    fit = rows.withColumn("_need", need).withColumn("_used", used).filter(F.col("_used") < budget)
    room = (F.lit(budget) - F.col("_used")).cast("int")
    cut = F.when(F.col("_need") <= room, F.col(text)).otherwise(truncate_tokens(F.col(text), room))
    parts = F.array_sort(F.collect_list(F.struct("rank", F.col("_cut").alias("t"))))
    return fit.withColumn("_cut", cut).groupBy(*QUERY).agg(
        strip_ends(F.array_join(F.transform(parts, lambda p: p["t"]), "\n")).alias("context"),
        F.count(F.lit(1)).alias("n_blocks"))


def build_context(groups: DataFrame, budget: int) -> DataFrame:
    """One context per query from unit groups: header, then chunk texts, under a token budget."""
    body = F.array_join(F.filter(F.transform("chunks", lambda c: strip_ends(F.coalesce(c["text"], F.lit("")))), lambda t: t != ""), "\n")
    meta = F.concat_ws(", ", F.nullif("doc_type", F.lit("")), F.nullif("doc_date", F.lit("")),
                       F.coalesce(F.nullif("source", F.lit("")), F.lit("?")))
    title = F.coalesce(F.nullif("unit_title", F.lit("")), F.lit("Document"))
    block = F.concat(F.lit("### "), title, F.lit("\n("), meta, F.lit(")\n\n"), F.col("_body"), F.lit("\n"))
    filled = groups.withColumn("_body", body).filter("_body <> ''").withColumn("_block", block)
    return _pack(filled, budget, "_block")


def build_context_flat(hits: DataFrame, budget: int) -> DataFrame:
    """The same from single hits, each under its own source line."""
    src = F.when(F.col("source") != "", F.concat(F.lit("source: "), F.col("source")))
    page = F.when(F.col("page") != 0, F.concat(F.lit("page: "), F.col("page").cast("string")))
    head = F.concat_ws(", ", src, page)
    text = strip_ends(F.col("text"))
    block = F.concat(F.when(head != "", F.concat(F.lit("["), head, F.lit("]\n"))).otherwise(""), text, F.lit("\n"))
    return _pack(hits.filter(text != "").withColumn("_block", block), budget, "_block")


def citable_context(groups: DataFrame, cap: int) -> DataFrame:
    """Per unit: one anchor and up to six other chunks, each under its citation tag, within a character cap."""
    cs = F.col("chunks")
    anchor = F.slice(F.filter(cs, lambda c: F.coalesce(c["is_unit_anchor"], F.lit(False))), 1, 1)
    others = F.slice(F.filter(cs, lambda c: ~F.coalesce(c["is_unit_anchor"], F.lit(False))), 1, rules.CONTEXT_CHUNKS_PER_UNIT)
    text = lambda c: strip_ends(F.coalesce(c["text"], F.lit("")))
    chosen = F.filter(F.concat(anchor, others), lambda c: text(c) != "")
    pieces = F.transform("_chosen", lambda c: F.struct(
        c["chunk_ord"].alias("chunk_ord"),
        F.concat(F.lit("[source: "), F.col("source"), F.lit(", chunk "), c["chunk_ord"].cast("string"), F.lit("] page="),
                 F.coalesce(c["page"].cast("string"), F.lit("None")), F.lit("\n"), text(c), F.lit("\n\n")).alias("t")))
    start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<struct<chunk_ord:bigint,t:string>>").alias("out"))

    def step(acc, p):
        fits = acc["open"] & (acc["used"] + F.length(p["t"]) <= cap)
        return F.struct(
            (acc["used"] + F.when(fits, F.length(p["t"])).otherwise(0)).alias("used"), fits.alias("open"),
            F.when(fits, F.array_append(acc["out"], p)).otherwise(acc["out"]).alias("out"))

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(
        F.lit("=== ACTE / UNITÉ ===\nSOURCE: "), blank("source"), F.lit("\nUNIT_TITLE: "), blank("unit_title"),
        F.lit("\nUNIT_TYPE: "), blank("unit_type"), F.lit("\nUNIT_ID: "), blank("unit_id"), F.lit("\nPAGES_UNIT: "),
        blank("page_start"), F.lit("-"), blank("page_end"), F.lit("\n====================\n"))
    return (
        groups.withColumn("_chosen", chosen).withColumn("_pieces", pieces)
        .withColumn("_kept", F.aggregate("_pieces", start, step, lambda a: a["out"]))
        .select("query_id", "case_id", "rank", "source", "unit_key",
                F.transform("_kept", lambda p: p["chunk_ord"]).alias("cited"),
                strip_ends(F.concat(head, F.array_join(F.transform("_kept", lambda p: p["t"]), ""))).alias("block"))
    )


def source_summary(hits: DataFrame, by_unit: bool = True) -> DataFrame:
    """Sources of a hit list with their distinct sorted pages, per unit or per page."""
    keys = ["query_id", "source", "unit_index"] if by_unit else ["query_id", "source", "page"]
    firsts = [F.min_by(c, "rank").alias(c) for c in ("unit_title", "doc_type", "doc_date")]
    if not by_unit:
        firsts.append(F.min_by("unit_index", "rank").alias("unit_index"))
    return hits.groupBy(*keys).agg(
        F.min("rank").alias("first_rank"), *firsts, F.array_sort(F.collect_set("page")).alias("pages"))


def _turn_block(role, content):
    prefix = F.when(role == "user", rules.ROLE_PREFIX["user"]).when(
        role == "assistant", rules.ROLE_PREFIX["assistant"]).otherwise(rules.ROLE_PREFIX[""])
    return prefix, F.concat(prefix, content, F.lit("\n"))


def history_window(conversations: DataFrame, budget: int = rules.HISTORY_TOKENS, newest_first: bool = True) -> DataFrame:
    """Turns of each conversation kept under a token budget.

    Newest first keeps the latest turns (a first oversized one is cut to its
    tail); oldest first keeps the earliest. Totals run over blocks of turns,
    so one endless conversation is not sorted in one task.
    """
    content = strip_ends(F.coalesce("text", F.lit("")))
    prefix, block = _turn_block(F.col("role"), F.col("_content"))
    turns = (
        conversations.withColumn("_content", content).filter("_content <> ''")
        .withColumn("block", block).withColumn("_need", approx_tokens(F.col("block")))
        .withColumn("_at", -F.col("turn") if newest_first else F.col("turn"))
    )
    run = running_total(turns, ["conv_id"], ["_at"], F.col("_need"), page_block("_at"), "_used", below=budget)
    fits = F.col("_used") + F.col("_need") <= budget
    if not newest_first:
        kept = run.filter(fits)
    else:
        room = F.greatest(F.lit(budget) - approx_tokens(prefix), F.lit(16)) * 4
        tail = F.concat(prefix, F.right(F.col("_content"), room), F.lit("\n"))
        kept = run.filter(fits | (F.col("_used") == 0)).withColumn("block", F.when(fits, F.col("block")).otherwise(tail))
    return kept.withColumn("n_tokens", approx_tokens(F.col("block"))).select("conv_id", "turn", "role", "block", "n_tokens")


def history_block(window: DataFrame) -> DataFrame:
    """One text per conversation from its kept turns (bounded by the budget)."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "block")))
    return window.groupBy("conv_id").agg(
        strip_ends(F.array_join(F.transform(parts, lambda p: p["block"]), "")).alias("history"),
        F.count(F.lit(1)).alias("n_turns"))


def resolve_citations(answers: DataFrame, chunks: DataFrame, ident: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Citations ``[source: X, chunk N]`` of each answer, distinct, joined to the chunk they name.

    Ordinals start anew in every case: where the chunks have a case, the
    answers must have one too, and a citation is looked up in its own case.
    """
    case = ["case_id"] if "case_id" in chunks.columns else []
    if case and "case_id" not in answers.columns:
        raise ValueError("answers need a case_id, as the chunks have one")
    ident = (*ident, *[c for c in case if c not in ident])
    src = F.regexp_extract_all("text", F.lit(rules.CITE_PATTERN), F.lit(1))
    num = F.regexp_extract_all("text", F.lit(rules.CITE_PATTERN), F.lit(2))
    pairs = F.array_distinct(F.zip_with(src, num, lambda s, n: F.struct(
        F.trim(s).alias("source"), n.cast("bigint").alias("chunk_ord"))))
    cited = answers.select(*ident, F.posexplode(pairs).alias("cite_no", "_c")).select(
        *ident, "cite_no", F.col("_c.source").alias("source"), F.col("_c.chunk_ord").alias("chunk_ord"))
    known = chunks.select("source", "chunk_ord", *[c for c in (*case, "page", "unit_title") if c in chunks.columns],
                          F.lit(True).alias("_known"))
    return cited.join(known, [*case, "source", "chunk_ord"], "left").withColumn(
        "resolved", F.coalesce("_known", F.lit(False))).drop("_known")


def audit_answers(conversations: DataFrame, json_schema: str = "adresse_principale string") -> DataFrame:
    """Answer texts with fences stripped, truncation flags, embedded JSON and a safe context."""
    plain = conversations.withColumn("plain", strip_fences(F.coalesce("text", F.lit(""))))
    return (
        plain.withColumn("cut_if_short", looks_truncated(F.col("plain"), True))
        .withColumn("cut_unless_short", looks_truncated(F.col("plain"), False))
        .withColumn("json", extract_json(F.col("plain"), json_schema))
        .withColumn("safe", safe_context(F.col("plain")))
        .withColumn("n_tokens", approx_tokens(F.col("plain")))
    )
