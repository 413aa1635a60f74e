"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import views

VIEWS = {"boxes": views.BOXES, "attempts": views.ATTEMPTS, "manifest": views.MANIFEST}
_FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None, *with_views: str):
    """Registers a function of Tables under the operator's name; views named are put before the SQL."""

    def add(function: Callable[[views.Tables], DataFrame]):
        full = sql
        if sql is not None and with_views:
            heads = ", ".join(VIEWS[v] for v in with_views)
            full = f"WITH {heads}, {sql.lstrip()[5:]}" if sql.lstrip().startswith("WITH ") else f"WITH {heads} {sql}"
        if name in _FOUND and _FOUND[name][0] is not function:
            raise ValueError(f"two queries {name}")
        _FOUND[name] = (function, full)
        return function

    return add


def _load() -> dict[str, tuple[Callable, str | None]]:
    for module in ("text_queries", "set_queries", "extraction_queries", "flow_queries", "relational_queries", "service_queries"):
        import_module(f"{__package__}.{module}")
    return _FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(views.Tables(spark, folder))) for name, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _load().items() if sql is not None}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["flow-signals"](spark, folder)
