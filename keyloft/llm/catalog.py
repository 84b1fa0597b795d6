"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import importlib
import pkgutil

import keyloft.llm.queries as found


def _modules():
    return [importlib.import_module(f"{found.__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(found.__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in getattr(m, "ORACLE_SQL", {}).items()}
