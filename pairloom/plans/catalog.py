"""All registered queries, and their SQL."""

from __future__ import annotations

from . import (  # noqa: F401  (they register)
    clean_annotate,
    diag_metrics,
    features_text,
    folds_sets,
    graph_render,
    rendering_all,
    sources_scoring,
    walks_structures,
)
from .registry import _queries, _sql


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict:
    return dict(_sql)
