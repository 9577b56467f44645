"""Training-data operators: mixing, scoring, deduplication, packing, search, media, licences, extraction.

Nothing else in the library imports this subpackage. ``queries()`` and ``oracle_sql()`` collect what the
operator modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_mixing", "op2_quality", "op3_toxicity", "op4_simhash", "op5_packing", "op6_neighbours", "op7_substrings", "op8_media", "op9_licenses", "op10_html")


def _merged(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    """Query name to function of (spark, sf_dir)."""
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL, where SQL can express the query."""
    return _merged("ORACLE")
