"""The registered queries: each runs an operator over the given tables."""

from __future__ import annotations

from importlib import import_module

from gaugeflow.plans.registry import QUERIES, SQL

MODULES = ("feature_queries", "rule_queries", "grammar_queries", "rulebase_queries", "document_queries", "catalog_queries", "stream_queries")


def _load() -> None:
    for module in MODULES:
        import_module(f"gaugeflow.plans.{module}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
