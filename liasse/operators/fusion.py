"""From ranked signals to a final hit list: fusion, dedup, spread, neighbours, budgets, groups.

Every step works on at most L rows per query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions.text import norm_text
from liasse.plans.matching import is_small
from liasse.plans.ordering import first_rows
from liasse.schemas import QUERY
from liasse.session import staged

RANK_COLUMNS = ["query_id", "case_id", "chunk_ord", "rank"]


def rrf(signals: dict[str, DataFrame], boosts: dict[str, int] | None = None, k: int = rules.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion. A boost of b counts a list b times, one copy after the other.

    ``signals`` maps a name to (query_id, case_id, chunk_ord, rank).
    """
    boosts = {**rules.BOOSTS, **(boosts or {})}
    parts = []
    for name, ranks in signals.items():
        b = boosts.get(name, 1)
        one = ranks.select(*RANK_COLUMNS)
        if b > 1:
            size = F.count(F.lit(1)).over(Window.partitionBy(*QUERY))
            share = sum((1 / (F.lit(float(k)) + F.col("rank") + j * size) for j in range(b)), F.lit(0.0))
        else:
            share = 1 / (F.lit(float(k)) + F.col("rank"))
        parts.append(one.withColumn("_share", share).drop("rank"))
    fused = reduce(DataFrame.unionByName, parts)
    return fused.groupBy("query_id", "case_id", "chunk_ord").agg(
        F.round(F.sum("_share"), 9).alias("score"))


def top_fused(fused: DataFrame, params: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Candidates of each query by fused score, up to its own ``n_candidates`` or one limit."""
    order = [F.desc("score"), "chunk_ord"]
    if params is None:
        return first_rows(fused, QUERY, order, limit or rules.TOP_K * rules.SEARCH_MULT, rank="rank")
    ranked = fused.join(params.select(*QUERY, "n_candidates"), QUERY).withColumn(
        "rank", F.row_number().over(Window.partitionBy(*QUERY).orderBy(*order)))
    return ranked.filter(F.col("rank") <= F.col("n_candidates")).drop("n_candidates")


def _rerank(df: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy(*QUERY).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w))


def dedup_candidates(hits: DataFrame, text: str = "text") -> DataFrame:
    """Keep the first of candidates with the same folded text; empty ones go."""
    keyed = hits.withColumn("_norm", norm_text(F.col(text))).filter("_norm <> ''").withColumn(
        "_sha", F.sha2("_norm", 256))
    return _rerank(first_rows(keyed, [*QUERY, "_sha"], ["rank"]).drop("_norm", "_sha"), "rank")


def round_robin(hits: DataFrame) -> DataFrame:
    """Take one hit of each source in turn, sources in order of their first hit."""
    by_source = Window.partitionBy(*QUERY, "source")
    turn = F.row_number().over(by_source.orderBy("rank"))
    lead = F.min("rank").over(by_source)
    return _rerank(hits.withColumn("_turn", turn).withColumn("_lead", lead), "_turn", "_lead").drop("_turn", "_lead")


def cap_per_source(hits: DataFrame, cap: int | str = rules.MAX_PER_SOURCE) -> DataFrame:
    """At most ``cap`` hits per query and source (0: no cap); ``cap`` may name a column."""
    limit = F.col(cap) if isinstance(cap, str) else F.lit(cap)
    nth = F.row_number().over(Window.partitionBy(*QUERY, "source").orderBy("rank"))
    kept = hits.withColumn("_nth", nth).filter((limit <= 0) | (F.col("_nth") <= limit)).drop("_nth")
    return _rerank(kept, "rank")


def expand_neighbors(hits: DataFrame, chunks: DataFrame, params: DataFrame, extra: int | None = None) -> DataFrame:
    """Base hits first, then the chunks before and after each, under the same cap per source.

    ``params``: query_id, case_id, top_k, max_per_source. Up to top_k + extra rows
    (extra defaults to top_k).
    """
    base = hits.select("query_id", "case_id", "chunk_ord", F.lit(0).alias("_phase"),
                       (F.col("rank") * 2).alias("_at"))
    near = hits.select(
        "query_id", "case_id", F.lit(1).alias("_phase"), F.col("rank").alias("_r"), F.col("chunk_ord").alias("_o"),
        F.explode(F.array(F.lit(-1), F.lit(1))).alias("_step"),
    ).select("query_id", "case_id", (F.col("_o") + F.col("_step")).alias("chunk_ord"), "_phase",
             (F.col("_r") * 2 + F.when(F.col("_step") > 0, 1).otherwise(0)).alias("_at"))
    lined = staged(first_rows(base.unionByName(near), ["query_id", "case_id", "chunk_ord"], ["_phase", "_at"]))
    if is_small(lined):  # so the texts are read where they are, not shuffled
        lined = F.broadcast(lined)
    full = lined.join(chunks, ["case_id", "chunk_ord"]).join(
        params.select(*QUERY, "top_k", "max_per_source"), QUERY)
    nth = F.row_number().over(Window.partitionBy(*QUERY, "source").orderBy("_phase", "_at"))
    kept = full.withColumn("_nth", nth).filter(
        (F.col("max_per_source") <= 0) | (F.col("_nth") <= F.col("max_per_source")))
    room = F.col("top_k") + (F.lit(extra) if extra is not None else F.col("top_k"))
    return _rerank(kept, "_phase", "_at").filter(F.col("rank") <= room).drop(
        "_phase", "_at", "_nth", "top_k", "max_per_source")


def budget_chars(hits: DataFrame, per_hit: int | None, total: int | None, text: str = "text") -> DataFrame:
    """Cut each text to ``per_hit`` characters and the list to ``total``; the crossing row is cut."""
    cut = F.coalesce(F.col(text), F.lit(""))
    if per_hit:
        cut = F.left(cut, F.lit(per_hit))
    out = hits.withColumn(text, cut)
    if total is None:
        return out
    before = Window.partitionBy(*QUERY).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    return (
        out.withColumn("_used", used).filter(F.col("_used") < total)
        .withColumn(text, F.left(F.col(text), (F.lit(total) - F.col("_used")).cast("int"))).drop("_used")
    )


UNIT_FIELDS = ["unit_id", "unit_index", "unit_title", "unit_type", "page_start", "page_end", "doc_date", "doc_type"]


def unit_key():
    return F.coalesce(F.col("unit_id"), F.concat_ws("|", "source", F.coalesce("unit_index", F.lit(-1)).cast("string")))


def group_by_unit(hits: DataFrame) -> DataFrame:
    """Hits grouped by logical unit, best rank first, chunks nested in rank order."""
    chunk = F.struct("rank", "chunk_ord", "page", "local_chunk_id", "is_unit_anchor", "is_fact", "text")
    firsts = [F.min_by(c, "rank").alias(c) for c in ["source", *UNIT_FIELDS]]
    grouped = hits.withColumn("unit_key", unit_key()).groupBy("query_id", "case_id", "unit_key").agg(
        F.min("rank").alias("best"), *firsts, F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return _rerank(grouped, "best").drop("best")
