"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["line_dedup", "url_filter", "packing", "lang_id", "quality_rank", "quality_crf", "near_dedup", "decontaminate", "token_count", "licence_scan"]


def _merged(kind: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"keyloom.llm.{m}"), kind, {}).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
