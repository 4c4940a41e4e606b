"""Named queries over the test tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "source_queries",
    "check_queries",
    "text_queries",
    "metric_queries",
    "corpus_queries",
    "loop_queries",
    "operation_queries",
    "signal_queries",
)


def load_catalogue():
    from soundquay.plans.registry import CATALOGUE

    for module in _MODULES:
        import_module(f"soundquay.plans.{module}")
    return CATALOGUE
