"""Registered queries of the uplift engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import evaluation, extras, modelling, terms

MODULES = (evaluation, modelling, extras, terms)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
