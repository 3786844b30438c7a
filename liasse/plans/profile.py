"""Person profile: identity, snippets, evidence counts, addresses and technical items side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liasse import rules
from liasse.operators import entities, evidence, persons as people
from liasse.session import staged

PERSON = ["person_id", "case_id"]


def person_profile(chunks: DataFrame, persons: DataFrame, search=None, fallback_limit: int = 400) -> DataFrame:
    """One row per person. ``search`` (queries -> hits) fills in for persons nobody mentions.

    Mentions are found once, written down and shared by all snippet lists. Counts,
    votes and first hits go over all mentions.
    """
    found = staged(people.mentions(chunks, persons))
    civil = people.civil_snippets(chunks, persons, None, found)
    wide = people.global_snippets(chunks, persons, None, found)
    home = people.address_snippets(chunks, persons, None, found)
    if search is not None:
        civil = people.with_fallback(civil, persons, search, rules.CIVIL_QUERY, 30, fallback_limit, min_score=8)
        wide = people.with_fallback(wide, persons, search, rules.GLOBAL_QUERY, 60, fallback_limit)
        home = people.with_fallback(home, persons, search, rules.ADDRESS_QUERY, 40, fallback_limit)
    facts = evidence.evidence_stats(evidence.dedup_evidence(evidence.classify_evidence(wide)))
    counts = lambda df, name: df.groupBy(*PERSON).agg(F.count(F.lit(1)).alias(name))
    kinds = [k for k in dict.fromkeys(rules.THEMES.values()) if k != "phone"]  # phones hold for the whole case
    linked = entities.by_person(entities.linked_facts(chunks, persons, kinds))
    panel = counts(entities.aggregate_entities(linked, ["person_id"]), "n_technical")
    out = persons.select(*PERSON, "name")
    parts = [counts(civil, "n_civil"), counts(wide, "n_global"), facts,
             people.birth_info(civil), people.address_vote(home), panel]
    for part in parts:
        out = out.join(part, PERSON, "left")
    return out
