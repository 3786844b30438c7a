"""Query intents, dynamic parameters and the extra ranking signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions.text import has_any, let, norm_text
from liasse.plans.matching import contains_join
from liasse.plans.ordering import first_rows
from liasse.schemas import QUERY
from liasse.schemas import with_chunk_meta
from liasse.session import staged


def classify_queries(queries: DataFrame) -> DataFrame:
    """Add ``is_identity`` and ``is_inventory`` (an explicit inventory_mode wins)."""
    q = F.col("_q")
    identity = (
        has_any(q, rules.IDENTITY_TERMS)
        | q.rlike(r"(?U)\b(ne|nee)\s+le\b")
        | (q.rlike(r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
           & has_any(q, ["naissance", "ne le", "nee le", "etat civil", "identite"]))
        | has_any(q, rules.IDENTITY_LABELS)
    )
    inventory = has_any(q, rules.INVENTORY_TERMS)
    if "inventory_mode" in queries.columns:
        inventory = F.coalesce(F.col("inventory_mode"), inventory)
    return (
        queries.withColumn("_q", norm_text(F.col("text")))
        .withColumn("is_identity", (q != "") & identity)
        .withColumn("is_inventory", inventory & ((q != "") | (F.col("inventory_mode") if "inventory_mode" in
                                                             queries.columns else F.lit(False))))
        .drop("_q")
    )


def retrieval_params(queries: DataFrame, top_k: int = rules.TOP_K) -> DataFrame:
    """Add top_k, n_candidates, max_per_source (0: no cap), mmr_lambda per query."""
    k = F.greatest(F.coalesce(F.col("top_k"), F.lit(top_k)) if "top_k" in queries.columns else F.lit(top_k), F.lit(1))
    inv = F.col("is_inventory")
    return (
        classify_queries(queries)
        .withColumn("_k", k)
        .withColumn("n_candidates", F.col("_k") * rules.SEARCH_MULT * F.when(inv, rules.INVENTORY_L).otherwise(1))
        .withColumn("top_k", F.col("_k") * F.when(inv, rules.INVENTORY_TOPK).otherwise(1))
        .withColumn("max_per_source", F.when(inv, 0).otherwise(rules.MAX_PER_SOURCE))
        .withColumn("mmr_lambda", F.when(inv, rules.MMR_LAMBDA_INVENTORY)
                    .when(F.col("is_identity"), rules.MMR_LAMBDA_IDENTITY).otherwise(rules.MMR_LAMBDA))
        .drop("_k")
    )


def _ranked(hits: DataFrame, limit: int) -> DataFrame:
    return first_rows(hits, QUERY, [F.desc("score"), "chunk_ord"], limit, rank="rank").select(
        "query_id", "case_id", "chunk_ord", "score", "rank")


def name_hits(chunks: DataFrame, queries: DataFrame, limit: int, small: bool | None = None) -> DataFrame:
    """Chunks whose source name contains words of the query; score is the number of words."""
    names = chunks.select("case_id", "source").distinct().withColumn("_name", norm_text(F.col("source")))
    parts = F.filter(F.split(norm_text(F.col("text")), r"[^a-z0-9_.-]+"), lambda t: t != "")
    words = staged(queries.select("query_id", "case_id", F.explode(parts).alias("_word")).groupBy(*QUERY, "_word").agg(F.count(F.lit(1)).alias("_n")))
    found = staged(contains_join(names, words.select("case_id", "_word").distinct(), ["case_id"], "_name", "_word", ["case_id", "source"], small))
    # queries whose words meet the same names in the same way have one ranking
    met = words.join(found.select("case_id", "_word").distinct(), ["case_id", "_word"])
    kinds = met.groupBy(*QUERY).agg(F.array_sort(F.collect_list(F.struct("_word", "_n"))).alias("_words"))
    kinds = staged(kinds.withColumn("_kind", F.sha2(F.to_json("_words"), 256)))
    asked = kinds.groupBy("case_id", "_kind").agg(F.first("_words").alias("_words")).select("case_id", "_kind", F.inline("_words"))
    score = asked.join(found, ["case_id", "_word"]).groupBy("case_id", "_kind", "source").agg(F.sum("_n").cast("double").alias("score"))
    # a name's chunks score alike, so its first ones are all that any query needs
    heads = first_rows(chunks.select("case_id", "source", "chunk_ord"), ["case_id", "source"], ["chunk_ord"], limit)
    ranked = first_rows(heads.join(score, ["case_id", "source"]), ["case_id", "_kind"], [F.desc("score"), "chunk_ord"], limit, rank="rank")
    return kinds.select(*QUERY, "_kind").join(ranked, ["case_id", "_kind"]).select("query_id", "case_id", "chunk_ord", "score", "rank")


def quoted_phrase(col: Column) -> Column:
    """First quoted passage of four or more characters."""
    pattern = "\"([^\"]{4,})\"|'([^']{4,})'"
    one, two = F.regexp_extract(col, pattern, 1), F.regexp_extract(col, pattern, 2)
    return F.trim(F.when(one != "", one).otherwise(two))


def phrase_hits(chunks: DataFrame, queries: DataFrame, limit: int, small: bool | None = None) -> DataFrame:
    """Chunks that contain the query's quoted phrase, in chunk order."""
    phrases = queries.select("query_id", "case_id", norm_text(quoted_phrase(F.col("text"))).alias("_phrase"))
    texts = chunks.select("case_id", "chunk_ord", norm_text(F.col("text")).alias("_text"))
    found = contains_join(texts, phrases, ["case_id"], "_text", "_phrase", ["case_id", "chunk_ord"], small)
    return _ranked(found.withColumn("score", F.lit(1.0)), limit)


def _identity_queries(queries: DataFrame) -> DataFrame:
    known = queries if "is_identity" in queries.columns else classify_queries(queries)
    return known.filter("is_identity").select("query_id", "case_id")


def identity_scores(chunks: DataFrame) -> DataFrame:
    """Chunks with an identity look in type (3), title (2) or source name (1)."""
    c = with_chunk_meta(chunks)
    score = (
        F.when(norm_text(F.col("doc_type")).isin(rules.IDENTITY_DOC_TYPES), 3).otherwise(0)
        + F.when(let(norm_text(F.col("unit_title")), lambda t: has_any(t, rules.IDENTITY_TITLES)), 2).otherwise(0)
        + F.when(let(norm_text(F.col("source")), lambda t: has_any(t, rules.IDENTITY_SOURCES)), 1).otherwise(0)
    )
    return c.select("case_id", "chunk_ord", score.cast("double").alias("score")).filter("score > 0")


def identity_hits(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """For identity queries: the best identity-looking chunks of the case.

    The ranking is the same for all queries of a case, so it is made once per
    case and the queries join its few rows.
    """
    best = first_rows(identity_scores(chunks), ["case_id"], [F.desc("score"), "chunk_ord"], limit, rank="rank")
    return _identity_queries(queries).join(best, "case_id").select(
        "query_id", "case_id", "chunk_ord", "score", "rank")


def fact_hits(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """For identity queries: the identity-fact chunks of the case, in chunk order."""
    facts = with_chunk_meta(chunks).filter("is_fact").select("case_id", "chunk_ord", F.lit(1.0).alias("score"))
    best = first_rows(facts, ["case_id"], ["chunk_ord"], limit, rank="rank")
    return _identity_queries(queries).join(best, "case_id").select(
        "query_id", "case_id", "chunk_ord", "score", "rank")
