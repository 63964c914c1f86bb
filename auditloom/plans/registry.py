"""The registered queries of the engine and their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, everyday, retrieval, textual

MODULES = (retrieval, textual, audit, everyday)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: row[0] for module in MODULES for name, row in module.TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: row[1] for module in MODULES for name, row in module.TABLE.items() if row[1]}
