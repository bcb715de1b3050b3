"""Queries by name, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from . import preference, records, relational, surrogate


def _all() -> dict[str, tuple[Callable, str | None]]:
    return preference.QUERIES | relational.QUERIES | records.QUERIES | surrogate.QUERIES


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
