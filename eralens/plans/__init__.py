"""The registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ("panel_queries", "score_queries", "summary_queries", "inference_queries", "selection_queries", "vector_queries", "stream_queries")


def load():
    """(queries, oracles), importing every family once."""
    for family in FAMILIES:
        importlib.import_module(f"eralens.plans.{family}")
    from eralens.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
