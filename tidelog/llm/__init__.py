"""Training-data operators: their queries and their SQL for comparison."""

from __future__ import annotations

import importlib

MODULES = ("token_counts", "simhash", "language_id", "image_copies", "mixing", "bpe", "merkle", "suffix_repeats", "language_model", "pii")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
