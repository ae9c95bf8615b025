"""Registry of queries. Each one takes the packets relation of a data folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetscope.fixtures import PACKETS_CTE, packets

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_CHECKS: dict[str, str] = {}
_MODULES = ["shaping", "statistics", "annotations", "frames", "learning", "files", "streams"]


def query(name: str, check: str | None = None):
    """Register ``fn(packets)``. ``check`` is SQL over ``packets``; it may start with
    more common table expressions (then with a comma)."""

    def keep(fn):
        _QUERIES[name] = lambda spark, sf_dir: fn(packets(spark, sf_dir))
        _note(name, check)
        return fn

    return keep


def folder_query(name: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)`` for queries that read the folder themselves."""

    def keep(fn):
        _QUERIES[name] = fn
        _note(name, check)
        return fn

    return keep


def _note(name: str, check: str | None) -> None:
    if check is not None:
        _CHECKS[name] = f"WITH {PACKETS_CTE.strip().format(events='events')}{check}"


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"packetscope.catalog.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_CHECKS)
