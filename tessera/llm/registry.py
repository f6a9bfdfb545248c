"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

import importlib

MODULES = ("suffix_dedup", "piece_codec", "license_scan", "packing", "webp_media", "line_templates", "topk_search", "quality_bayes", "token_files", "simhash_pivots", "token_counts", "centroids", "ranked_search")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
