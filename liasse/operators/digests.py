"""Section selection, document bundles, chronology, block packing, monthly roll-up."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions.text import has_any, strip_ends
from liasse.operators.segment import DOC
from liasse.plans.ordering import capped_concat, page_block, parted_concat, running_total
from liasse.schemas import with_chunk_meta
from liasse.session import staged

ORD_BLOCK = 4096
FAN = 64


def section_hits(chunks: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """case_id, chunk_ord, text, section: each chunk once for every section it has a keyword of."""
    low = F.lower("text")
    hits = F.array_compact(F.array(*[
        F.when(has_any(low, [k.lower() for k in words]), F.lit(name)) for name, words in sections.items() if words]
        or [F.lit(None).cast("string")]))
    return chunks.select("case_id", "chunk_ord", "text", F.explode(hits).alias("section"))


def section_parts(chunks: DataFrame, sections: dict[str, list[str]], size: int = rules.SECTION_CHARS) -> DataFrame:
    """The whole text of each case and section with any hit, in parts of about ``size`` characters.

    A section without hits has no part: the whole case stands for it.
    """
    return parted_concat(section_hits(chunks, sections), ["case_id", "section"], ["chunk_ord"], page_block("chunk_ord", ORD_BLOCK), "text", size)


def select_sections(chunks: DataFrame, sections: dict[str, list[str]], cap: int = rules.SECTION_CHARS) -> DataFrame:
    """Text per case and section: chunks with any keyword, else the start of the whole case.

    The keyword lists are compiled into one projection, so a chunk is read
    once for all sections.
    """
    block = page_block("chunk_ord", ORD_BLOCK)
    hit_rows = section_hits(chunks, sections)
    chosen = capped_concat(hit_rows, ["case_id", "section"], ["chunk_ord"], block, "text", cap).withColumn("fallback", F.lit(False))
    whole = capped_concat(chunks, ["case_id"], ["chunk_ord"], block, "text", cap)
    wanted = whole.select("case_id", F.explode(F.array(*[F.lit(s) for s in sections])).alias("section"))
    open_ = wanted.join(chosen.select("case_id", "section"), ["case_id", "section"], "left_anti")
    rest = open_.join(whole, "case_id").withColumn("fallback", F.lit(True))
    return chosen.unionByName(rest.select(*chosen.columns))


def bundle_docs(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per document with chunks: catalogue data where there is any, else its first chunk's."""
    c = with_chunk_meta(chunks).withColumn("source", F.coalesce("source", F.lit("__unknown__")))
    own = c.groupBy(*DOC).agg(
        F.count(F.lit(1)).alias("n_bundled"),
        F.min_by(F.struct("doc_date", "doc_type"), "chunk_ord").alias("_own"))
    if documents is None:
        documents = own.select(*DOC).limit(0).selectExpr(
            *DOC, "cast(null as string) doc_date", "cast(null as string) doc_type", "0 n_pages", "0 n_chunks",
            "cast(null as timestamp) added")
    meta = documents.select(*DOC, F.struct("doc_date", "doc_type").alias("_cat"), "n_pages", "n_chunks", "added")
    joined = own.join(meta, DOC, "left")
    got = F.when(F.col("_cat").isNotNull(), F.col("_cat")).otherwise(F.col("_own"))
    return joined.select(
        *DOC, got["doc_date"].alias("doc_date"), got["doc_type"].alias("doc_type"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        "added", "n_bundled")


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with their place in the document, by page and local id."""
    c = with_chunk_meta(chunks).withColumn("page", F.coalesce("page", F.lit(1))).withColumn(
        "local_chunk_id", F.coalesce(F.col("local_chunk_id").cast("bigint"), "chunk_ord"))
    return running_total(c, DOC, ["page", "local_chunk_id", "chunk_ord"], F.lit(1), page_block("page"), "doc_pos")


def in_range(docs: DataFrame, date_from: str | None = None, date_to: str | None = None, col: str = "doc_date") -> DataFrame:
    """Documents dated within the bounds; undated ones stay, unreadable bounds do not count."""
    day = F.try_to_date(F.col(col), "yyyy-MM-dd")
    out = docs
    for bound, test in ((date_from, lambda d, b: d >= b), (date_to, lambda d, b: d <= b)):
        if bound:
            b = F.try_to_date(F.lit(bound), "yyyy-MM-dd")
            out = out.filter(day.isNull() | b.isNull() | test(day, b))
    return out


def chronology(chunks: DataFrame, documents: DataFrame | None = None, date_from: str | None = None,
               date_to: str | None = None, top_n: int | None = None, excerpt: int = rules.EXCERPT_CHARS) -> DataFrame:
    """Documents in date order (undated last) with a readable label and the start of their text."""
    docs = in_range(bundle_docs(chunks, documents), date_from, date_to)
    day = F.try_to_date("doc_date", "yyyy-MM-dd")
    docs = docs.withColumn("_day", day)
    order = [F.asc_nulls_last("_day"), F.coalesce("added", F.to_timestamp(F.lit("1970-01-01"))), F.col("source"), F.col("case_id")]
    if top_n:
        docs = docs.orderBy(*order).limit(top_n)
    c = with_chunk_meta(chunks).withColumn("_page", F.coalesce("page", F.lit(1))).withColumn(
        "_local", F.coalesce(F.col("local_chunk_id").cast("bigint"), "chunk_ord"))
    if top_n:
        c = c.join(docs.select(*DOC), DOC, "left_semi")
    body = capped_concat(c, DOC, ["_page", "_local", "chunk_ord"], page_block("_page"), "text", excerpt, out="excerpt")
    label = F.create_map(*[F.lit(x) for kv in rules.DOC_TYPE_LABELS.items() for x in kv])
    return (
        docs.join(body, DOC, "left")
        .withColumn("label", F.coalesce(F.try_element_at(label, F.coalesce("doc_type", F.lit(""))), F.lit("Document")))
        .withColumn("year", F.left(F.coalesce("doc_date", F.lit("9999")), F.lit(4)))
        .orderBy(*order).drop("_day")
    )


# --- greedy packing of a case into blocks ----------------------------------------------------
#
# The rule is sequential: a block closes when the next text would pass the cap. To run it in
# parallel a case is cut into segments of consecutive chunks. Inside a segment every possible
# first closing place is followed to the segment's end (each place follows a single next
# place, so this is one backward pass). Such a summary maps what is open before a segment to
# what is open behind it; summaries are composed in a tree, and every segment numbers its own
# chunks. Lengths alone are moved, never texts.


def _next_closing(lens: np.ndarray, cap: int) -> np.ndarray:
    """For a block opened at i: the place where the next block opens (n: beyond the end)."""
    ends = np.concatenate([[0], np.cumsum(lens)])
    i = np.arange(len(lens))
    fit = np.searchsorted(ends, ends[i] + cap, side="right") - 1
    return np.maximum(fit, i + 1)


def _entry_place(lens: np.ndarray, carried: int, cap: int) -> int:
    """Where the first new block opens when a block of ``carried`` characters is still open."""
    if carried == 0:
        return 0
    return int(np.searchsorted(np.cumsum(lens), cap - carried, side="right"))


def _through(part: pd.DataFrame, carried: int, cap: int) -> tuple[int, int]:
    """Blocks that a segment opens, and what its last one holds, when a block of ``carried`` characters is open before it."""
    upto = part["upto"].to_numpy()
    p = 0 if carried == 0 else max(0, int(np.searchsorted(upto, cap - carried, side="right")) - 1)
    if p >= part["n"].iloc[0]:
        return 0, carried + int(part["total"].iloc[0])
    return int(part["opened"].iloc[p]), int(part["left"].iloc[p])


def _composed(first: pd.DataFrame, second: pd.DataFrame, cap: int) -> pd.DataFrame:
    """The summary of two neighbouring segments as one.

    An entry that ends its block within the first segment enters the second
    one with what is left there. An entry that takes in the whole first
    segment meets the second one's places that much later. No summary has
    more places than short chunks fit into a block.
    """
    n, total = int(first["n"].iloc[0]), int(first["total"].iloc[0])
    fixed = first[first["place"] < n]
    after = [_through(second, int(left), cap) for left in fixed["left"]]
    upto, opened, left = fixed["upto"].tolist(), [o + a for o, (a, _) in zip(fixed["opened"], after, strict=True)], [b for _, b in after]
    fits, closed = False, 1 << 30
    if len(first) > len(fixed):
        later = second[second["upto"] + total <= cap]
        upto += (later["upto"] + total).tolist()
        opened += later["opened"].tolist()
        left += later["left"].tolist()
        fits = bool((later["place"] >= second["n"].iloc[0]).any())
    return pd.DataFrame({"place": np.arange(len(upto)), "upto": upto, "total": total + int(second["total"].iloc[0]),
                         "n": len(upto) - 1 if fits else closed, "opened": opened, "left": left})


def _entries(summary: DataFrame, cap: int, fan: int) -> DataFrame:
    """case_id, seg, carried, blocks: the state in which each segment is entered.

    Segments are put together ``fan`` at a time, level by level, until a case
    is one piece; then each level hands its entry down to its parts. No task
    sees more than ``fan`` summaries, however many segments a case has.
    """
    kind = "case_id string, seg bigint, place int, upto bigint, total bigint, n int, opened bigint, left bigint"

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [part for _, part in pdf.sort_values(["seg", "place"]).groupby("seg")]
        whole = functools.reduce(lambda a, b: _composed(a, b, cap), parts)
        return whole.assign(case_id=pdf["case_id"].iloc[0], seg=pdf["seg"].iloc[0] // fan)[[c.split()[0] for c in kind.split(", ")]]

    levels = [staged(summary)]
    while (levels[-1].agg(F.max("seg")).first()[0] or 0) > 0:
        levels.append(staged(levels[-1].withColumn("_up", F.floor(F.col("seg") / fan)).groupBy("case_id", "_up").applyInPandas(
            lambda pdf: together(pdf.drop(columns="_up")), kind)))

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        carried, blocks, out = int(pdf["carried"].iloc[0]), int(pdf["blocks"].iloc[0]), []
        for seg, part in pdf.sort_values(["seg", "place"]).groupby("seg"):
            out.append((pdf["case_id"].iloc[0], seg, carried, blocks))
            more, carried = _through(part, carried, cap)
            blocks += more
        return pd.DataFrame(out, columns=["case_id", "seg", "carried", "blocks"])

    states = levels[-1].select("case_id", "seg").distinct().withColumns({"carried": F.lit(0).cast("bigint"), "blocks": F.lit(0).cast("bigint")})
    for level in reversed(levels[:-1]):
        above = states.withColumnRenamed("seg", "_up")
        states = level.withColumn("_up", F.floor(F.col("seg") / fan)).join(above, ["case_id", "_up"]).groupBy("case_id", "_up").applyInPandas(
            handed, "case_id string, seg bigint, carried bigint, blocks bigint")
    return states


def pack_blocks(chunks: DataFrame, cap: int = rules.BLOCK_CHARS, segment: int = 50_000, fan: int = FAN) -> DataFrame:
    """Chunks with ``block_id``: consecutive non-empty chunks up to ``cap`` characters, never split."""
    size = F.length(strip_ends(F.coalesce("text", F.lit("")))) + 2
    lens = chunks.select("case_id", "chunk_ord", size.alias("len")).filter("len > 2").withColumn(
        "seg", F.floor(F.col("chunk_ord") / segment).cast("bigint"))

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_ord")
        n, x = len(pdf), pdf["len"].to_numpy()
        nxt, ends = _next_closing(x, cap), np.concatenate([[0], np.cumsum(x)])
        opened, left = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for i in range(n - 1, -1, -1):
            j = nxt[i]
            opened[i] = 1 + (opened[j] if j < n else 0)
            left[i] = left[j] if j < n else ends[n] - ends[i]
        reach = min(n, int(np.searchsorted(ends, cap, side="right")))
        places = np.arange(reach + 1)
        return pd.DataFrame({
            "case_id": pdf["case_id"].iloc[0], "seg": pdf["seg"].iloc[0], "place": places,
            "upto": ends[places], "total": ends[n], "n": n, "opened": opened[places], "left": left[places],
        })

    summary = lens.groupBy("case_id", "seg").applyInPandas(
        summarize, "case_id string, seg bigint, place int, upto bigint, total bigint, n int, opened bigint, left bigint")

    states = _entries(summary, cap, fan)

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_ord")
        x, n = pdf["len"].to_numpy(), len(pdf)
        nxt = _next_closing(x, cap)
        marks = np.zeros(n, np.int64)
        i = _entry_place(x, int(pdf["carried"].iloc[0]), cap)
        while i < n:
            marks[i] = 1
            i = int(nxt[i])
        return pd.DataFrame({"case_id": pdf["case_id"], "chunk_ord": pdf["chunk_ord"],
                             "block_id": int(pdf["blocks"].iloc[0]) + np.cumsum(marks) - 1})

    return lens.join(states, ["case_id", "seg"]).groupBy("case_id", "seg").applyInPandas(
        number, "case_id string, chunk_ord bigint, block_id bigint")


def block_texts(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text of each block; a block holds at most the cap, or one long chunk."""
    rows = chunks.select("case_id", "chunk_ord", strip_ends(F.col("text")).alias("_t")).join(blocks, ["case_id", "chunk_ord"])
    parts = F.array_sort(F.collect_list(F.struct("chunk_ord", "_t")))
    return rows.groupBy("case_id", "block_id").agg(
        F.array_join(F.transform(parts, lambda p: p["_t"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("n_chunks"))


def group_blocks(blocks: DataFrame, n: int = rules.BLOCKS_PER_GROUP) -> DataFrame:
    """Consecutive blocks in groups of ``n``."""
    return blocks.withColumn("group_id", F.floor(F.col("block_id") / n).cast("bigint"))


def split_segments(docs: DataFrame, cap: int = rules.SEGMENT_CHARS, text: str = "text") -> DataFrame:
    """Markdown texts cut at blank lines into segments of up to ``cap`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(False).alias("any"))

    def step(acc, block):
        piece = F.concat(block, F.lit("\n\n"))
        full = acc["any"] & (F.length(acc["cur"]) + F.length(piece) > cap)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full, piece).otherwise(F.concat(acc["cur"], piece)).alias("cur"), F.lit(True).alias("any"))

    whole = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n\n"), start, step,
                        lambda a: F.array_append(a["done"], a["cur"]))
    segs = F.filter(F.transform(whole, lambda s: strip_ends(s)), lambda s: s != "")
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(segs).alias("segment", "text"))


def monthly_rollup(docs: DataFrame, date: str = "doc_date") -> DataFrame:
    """Documents per case, year and month; undated ones apart."""
    day = F.try_to_date(F.col(date).cast("string"), "yyyy-MM-dd") if dict(docs.dtypes)[date] == "string" else F.to_date(date)
    return docs.withColumn("_d", day).withColumn("month", F.coalesce(F.date_format("_d", "yyyy-MM"), F.lit("9999"))).groupBy(
        "case_id", "month").agg(F.count(F.lit(1)).alias("n_docs"), F.min("_d").alias("first_day"), F.max("_d").alias("last_day"))
