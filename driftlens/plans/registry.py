"""All registered queries of the library's own operators, by module."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES and ORACLE.
MODULES: tuple[str, ...] = ("series_queries", "log_queries", "wire_queries", "finding_queries", "mining_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"driftlens.plans.{name}").QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"driftlens.plans.{name}").ORACLE
    return out
