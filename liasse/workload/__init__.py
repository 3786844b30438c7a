"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

AREAS = ["text_jobs", "retrieval_jobs", "segment_jobs", "entity_jobs", "person_jobs", "digest_jobs", "key_jobs", "store_jobs"]


def _merged(kind: str) -> dict:
    out: dict = {}
    for area in AREAS:
        out.update(getattr(import_module(f"liasse.workload.{area}"), kind))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
