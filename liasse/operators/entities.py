"""Entity occurrences, links to persons, items per value, phone roles and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liasse import rules
from liasse.functions.entities import matches, normalize_phone
from liasse.functions.text import citation, norm_text, snippet
from liasse.plans.matching import contained_ids, contains_join
from liasse.plans.ordering import first_rows, page_block, running_total
from liasse.schemas import with_chunk_meta
from liasse.session import staged

OCC_KEY = ["case_id", "chunk_ord", "kind", "rule", "start", "end"]
SOCIAL = ["telegram", "whatsapp", "snapchat"]
_META = ["case_id", "source", "page", "chunk_ord", "doc_date", "doc_type", "unit_index", "unit_title"]


def extract_entities(chunks: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per match: place, kind, raw, value, span, snippet, ``near`` (lower-case window).

    A map-only job: one scan, one regex pass per kind on texts that pass a
    cheap test.
    """
    text = F.col("text")
    found = F.concat(*[matches(text, k) for k in dict.fromkeys(kinds)])
    at = lambda c: F.col(f"_m.{c}")
    lo = F.greatest(at("start") - rules.PERSON_WINDOW, F.lit(0))
    return with_chunk_meta(chunks).select(*_META, "text", F.explode(found).alias("_m")).select(
        *_META,
        *[at(c).alias(c) for c in ("kind", "rule", "start", "end", "raw", "value")],
        F.when(at("kind").isin(SOCIAL), at("value")).otherwise(at("raw")).alias("variant"),
        snippet(text, at("start"), at("end")).alias("snippet"),
        F.lower(F.substring(text, lo + 1, at("end") + rules.PERSON_WINDOW - lo)).alias("near"),
    )


def _names(persons: DataFrame) -> DataFrame:
    return persons.select("case_id", "person_id", F.lower("name").alias("_name"))


def mark_linked(occ: DataFrame, persons: DataFrame, small: bool | None = None) -> DataFrame:
    """Every occurrence with ``linked_persons``: who is named within 80 characters."""
    return contained_ids(occ, _names(persons), ["case_id"], "near", "_name", "person_id", OCC_KEY,
                         "linked_persons", small)


def link_person(occ: DataFrame, persons: DataFrame, small: bool | None = None) -> DataFrame:
    """Linked pairs only: an occurrence repeated for each person named near it."""
    return contains_join(occ, _names(persons), ["case_id"], "near", "_name", OCC_KEY, small).drop("_name")


def unique_occurrences(occ: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One occurrence per value and chunk, the first by position; ``linked_any`` keeps later links."""
    linked = (F.size("linked_persons") > 0) if "linked_persons" in occ.columns else F.lit("person_id" in occ.columns)
    keys = ["case_id", *by, "kind", "value", "source", "chunk_ord"]
    rest = [c for c in occ.columns if c not in keys and c not in ("linked", "variant")]
    first = F.min_by(F.struct(*rest, F.col("_linked").alias("linked")), F.struct("start", "rule", "end"))
    grouped = occ.withColumn("_linked", linked).groupBy(*keys).agg(
        first.alias("_first"), F.max("_linked").alias("linked_any"), F.collect_set("variant").alias("variants"))
    return grouped.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in [*rest, "linked"]], "linked_any", "variants")


def aggregate_entities(occ: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items per value: variants, number of chunks it occurs in, linked ones, first place."""
    uniq = unique_occurrences(occ, by)
    keys = ["case_id", *by, "kind", "value"]
    counted = uniq.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.sum(F.col("linked_any").cast("int")).alias("n_linked"),
        F.min_by(F.struct("source", "page", "chunk_ord"), F.struct("chunk_ord", "source")).alias("_at"),
    )
    spelled = uniq.select(*keys, F.explode("variants").alias("_v")).groupBy(*keys).agg(
        F.array_sort(F.collect_set("_v")).alias("variants"))
    return counted.join(spelled, keys).select(
        *keys, "n_occurrences", "n_linked", "variants", F.col("_at.source").alias("first_source"),
        F.col("_at.page").alias("first_page"), F.col("_at.chunk_ord").alias("first_chunk"))


def scan_theme(chunks: DataFrame, persons: DataFrame | None, theme: str, strict: bool = False) -> DataFrame:
    """Items of one theme. Strict: only occurrences near a person, one item list per person.

    An unknown theme gives no rows.
    """
    kind = rules.THEMES.get(theme.lower().strip())
    occ = extract_entities(chunks, [kind or "email"])
    if kind is None:
        occ = occ.filter("false")
    if strict:
        return aggregate_entities(link_person(occ, persons), ["person_id"])
    return aggregate_entities(occ if persons is None else mark_linked(occ, persons))


# --- phone roles -----------------------------------------------------------------------------

NAME_TOKEN = "zzpersonzz"


def person_terms(persons: DataFrame) -> DataFrame:
    """case_id, person_id, terms: folded names and aliases, longest first."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in persons.columns else F.array().cast("array<string>")
    folded = F.filter(F.transform(F.concat(F.array("name"), aliases), lambda t: norm_text(t)), lambda t: t != "")
    by_length = F.array_sort(F.array_distinct(folded), lambda a, b: F.length(b) - F.length(a))
    return persons.select("case_id", "person_id", F.lower("name").alias("_name"), by_length.alias("terms"))


def _count(text: Column, patterns: Sequence[str]) -> Column:
    return sum((text.rlike(p.replace("{P}", NAME_TOKEN)).cast("int") for p in patterns), F.lit(0))


def _role_columns(df: DataFrame, text: Column, linked: Column) -> DataFrame:
    """used, contact, n_rules of one occurrence for one person."""
    strong, medium = _count(text, rules.USED_STRONG_PATTERNS), _count(text, rules.USED_MEDIUM_PATTERNS)
    factor = F.when(linked, 1.0).otherwise(rules.UNLINKED_FACTOR)
    out = df.withColumn("_strong", strong).withColumn("_medium", medium).withColumn(
        "_contact", _count(text, rules.CONTACT_PATTERNS))
    none = (F.col("_strong") + F.col("_medium") + F.col("_contact")) == 0
    weak = none & text.rlike(rules.WEAK_CONTEXT)
    half = F.when(weak, rules.WEAK * 0.5).otherwise(0.0)
    return (
        out.withColumn("used", factor * (F.col("_strong") * rules.USED_STRONG + F.col("_medium") * rules.USED_MEDIUM + half))
        .withColumn("contact", factor * (F.col("_contact") * rules.CONTACT + half))
        .withColumn("n_rules", F.col("_strong") + F.col("_medium") + F.col("_contact") + weak.cast("int"))
        .drop("_strong", "_medium", "_contact")
    )


def mask_names(text: str, terms: str) -> Column:
    """The folded text with the name token in place of each term.

    While terms are replaced, a private-use character stands for a name: folded
    terms can't hold it, so no term is found inside an earlier mask.
    """
    marked = F.aggregate(terms, F.col(text), lambda s, t: F.replace(s, t, F.lit("\ue000")))
    return F.replace(marked, F.lit("\ue000"), F.lit(NAME_TOKEN))


def score_phone_roles(occ: DataFrame, persons: DataFrame) -> DataFrame:
    """Role scores of each phone occurrence for each person its snippet names."""
    folded = occ.withColumn("_folded", norm_text(F.col("snippet")))
    terms = person_terms(persons)
    spread = terms.select("case_id", "person_id", "_name", "terms", F.explode("terms").alias("_term"))
    pairs = contains_join(folded, spread, ["case_id"], "_folded", "_term", OCC_KEY)
    pairs = pairs.dropDuplicates([*OCC_KEY, "person_id"])
    linked = F.col("near").contains(F.col("_name"))
    masked = pairs.withColumn("_masked", mask_names("_folded", "terms"))
    return _role_columns(masked.withColumn("linked", linked), F.col("_masked"),
                         F.col("linked")).drop("_folded", "_masked", "_term", "terms", "_name")


def _decide(df: DataFrame) -> DataFrame:
    total = F.col("used") + F.col("contact")
    share = F.greatest(F.col("used"), F.col("contact")) / (total + 0.5)
    clamped = F.least(F.lit(rules.CONFIDENCE_MAX), F.greatest(F.lit(rules.CONFIDENCE_MIN), share))
    return df.withColumn(
        "role", F.when(total <= 0, "unknown").when(F.col("used") >= F.col("contact"), "used_by_person")
        .otherwise("contact_of_person")
    ).withColumn("confidence", F.round(F.when(total <= 0, rules.CONFIDENCE_MIN).otherwise(clamped), 3))


def phone_roles(occ: DataFrame, persons: DataFrame) -> DataFrame:
    """Role of each number for each person, with confidence and the three best pieces of evidence.

    A number's occurrences that do not name a person score the same for all
    persons; they are summed once per number. Rows with a null person_id hold
    the outcome for everybody not named near the number, so person and number
    pairs are never multiplied out. Evidence lists occurrences naming the person.
    """
    uniq = unique_occurrences(occ).select(*[c for c in occ.columns if c != "variant"])
    weak = norm_text(F.col("snippet")).rlike(rules.WEAK_CONTEXT)
    base_w = F.when(weak, rules.WEAK * 0.5 * rules.UNLINKED_FACTOR).otherwise(0.0)
    keys = ["case_id", "value"]
    base = uniq.groupBy(*keys).agg(F.sum(base_w).alias("_base"), F.count(F.lit(1)).alias("n_occurrences"))
    scored = score_phone_roles(uniq, persons).withColumn("_w", base_w)
    totals = scored.groupBy(*keys, "person_id").agg(
        F.sum(F.col("used") - F.col("_w")).alias("_u"), F.sum(F.col("contact") - F.col("_w")).alias("_c"),
        F.sum(F.col("linked").cast("int")).alias("n_linked"))
    proof = first_rows(scored.filter("n_rules > 0"), [*keys, "person_id"],
                       [F.desc("n_rules"), "chunk_ord", "start"], 3, rank="_i")
    proof = proof.groupBy(*keys, "person_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", "source", "page", "chunk_ord", "n_rules", "snippet"))),
        lambda e: F.struct(e["source"].alias("source"), e["page"].alias("page"), e["chunk_ord"].alias("chunk_ord"),
                           e["n_rules"].alias("n_rules"), e["snippet"].alias("snippet"))).alias("evidence"))
    tidy = lambda c: F.round(c, 9)
    named = (
        totals.join(base, keys).join(proof, [*keys, "person_id"], "left")
        .withColumn("used", tidy(F.col("_base") + F.col("_u")))
        .withColumn("contact", tidy(F.col("_base") + F.col("_c")))
    )
    others = (
        base.withColumn("person_id", F.lit(None).cast("bigint"))
        .withColumn("used", tidy(F.col("_base"))).withColumn("contact", tidy(F.col("_base")))
        .withColumn("n_linked", F.lit(0).cast("bigint"))
    )
    cols = [*keys, "person_id", "n_occurrences", "n_linked", "used", "contact"]
    both = named.select(*cols, "evidence").unionByName(others.select(*cols), allowMissingColumns=True)
    return _decide(both)


# --- number lookup and reports ---------------------------------------------------------------


def lookup_phone(chunks: DataFrame, numbers: DataFrame) -> DataFrame:
    """All hits of the given numbers (column ``number``, any spelling) with a wide snippet."""
    wanted = numbers.select("number", normalize_phone(F.col("number")).alias("value")).filter("value <> ''").distinct()
    found = F.explode(matches(F.col("text"), "phone")).alias("_m")
    hits = with_chunk_meta(chunks).select("case_id", "source", "page", "chunk_ord", "text", found)
    at = lambda c: F.col(f"_m.{c}")
    return hits.select(
        "case_id", "source", "page", "chunk_ord", at("value").alias("value"), at("raw").alias("raw"),
        at("start").alias("start"), snippet(F.col("text"), at("start"), at("end"), cap=None).alias("snippet"),
    ).join(wanted, "value")


def phone_report(hits: DataFrame) -> DataFrame:
    """Per number and source: hits, number of pages, first and last page."""
    by_page = phone_report_pages(hits)
    return by_page.groupBy("case_id", "value", "source").agg(
        F.sum("n_hits").alias("n_hits"), F.count("page").alias("n_pages"),
        F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def phone_report_pages(hits: DataFrame) -> DataFrame:
    """The page list of each number and source, one row per page."""
    src = F.coalesce("source", F.lit("(source inconnue)"))
    return hits.withColumn("source", src).groupBy("case_id", "value", "source", "page").agg(
        F.count(F.lit(1)).alias("n_hits"))


def phone_report_hits(hits: DataFrame) -> DataFrame:
    """Hits numbered within number and source, in text order."""
    flat = hits.withColumn("source", F.coalesce("source", F.lit("(source inconnue)"))).withColumn(
        "snippet", F.trim(F.replace("snippet", F.lit("\n"), F.lit(" "))))
    numbered = running_total(flat, ["case_id", "value", "source"], ["chunk_ord", "start"], F.lit(1),
                             page_block("chunk_ord", 4096), "_at")
    return numbered.withColumn("occurrence", (F.col("_at") + 1).cast("bigint")).drop("_at")


# --- theme summaries -------------------------------------------------------------------------


def summarize_theme(occ: DataFrame, by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """The items of each theme, most frequent first (all, or ``limit`` of them), with a badge and their first four places."""
    items = aggregate_entities(occ, by)
    group = ["case_id", *by, "kind"]
    top = first_rows(items, group, [F.desc("n_occurrences"), "first_chunk", "value"], limit, rank="item_rank")
    uniq = unique_occurrences(occ, by).select(*group, "value", "source", "page", "chunk_ord")
    places = first_rows(uniq.join(top.select(*group, "value"), [*group, "value"], "left_semi"),
                        [*group, "value"], ["chunk_ord", "source"], 4, rank="_i")
    cites = places.groupBy(*group, "value").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_i", citation(F.col("source"), F.col("page")).alias("c")))),
        lambda p: p["c"]), ", ").alias("places"))
    badge = F.when(F.col("n_linked") > 0, "associé fortement à la personne").otherwise("mentionné")
    return top.withColumn("badge", badge).join(cites, [*group, "value"]).withColumn(
        "line", F.concat(F.lit("- "), F.col("value"), F.lit(" ("), F.col("badge"), F.lit(") — "), F.col("places")))


def linked_facts(chunks: DataFrame, persons: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Occurrences of all kinds with the persons named near each, found in one pass and written down without texts."""
    return staged(mark_linked(extract_entities(chunks, kinds), persons).drop("near"))


def by_person(facts: DataFrame) -> DataFrame:
    """Facts once for each person named near them."""
    return facts.withColumn("person_id", F.explode("linked_persons")).drop("linked_persons")


def technical_panel(chunks: DataFrame, persons: DataFrame, limit: int | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Eight themes side by side: phones for the whole case, the others per person and strict.

    All kinds come from one table of facts. Phone rows carry a null person_id:
    they hold for every person of the case.
    """
    facts = linked_facts(chunks, persons, list(dict.fromkeys(rules.THEMES.values()))) if facts is None else facts
    phones = summarize_theme(facts.filter("kind = 'phone'"), (), limit).withColumn("person_id", F.lit(None).cast("bigint"))
    rest = summarize_theme(by_person(facts.filter("kind <> 'phone'")), ["person_id"], limit)
    cols = ["case_id", "person_id", "kind", "item_rank", "value", "n_occurrences", "badge", "places", "line"]
    return phones.select(*cols).unionByName(rest.select(*cols))
