"""Registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["fields", "lookups", "measures", "checks", "bets", "records", "cards", "models", "members", "audits", "gates", "intake", "learned", "histories"]


def _all() -> dict:
    return {name: pair for m in _MODULES for name, pair in import_module(f"cohortcast.queries.{m}").QUERIES.items()}


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
