"""All queries of the engine with the SQL that gives the same rows.

Modules of :mod:`palimpsest.plans` register their queries here.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "T45_quality_report"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_loaded = False


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = sql


def _load() -> None:
    global _loaded
    if not _loaded:
        from palimpsest import plans

        for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
            importlib.import_module(f"palimpsest.plans.{module}")
        _loaded = True


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
