"""All queries of the core and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from lessonloom.plans import catalog, content, editorial, integrity, links, processing, quality, rules, study

MODULES: list = [integrity, study, content, quality, processing, rules, catalog, editorial, links]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
