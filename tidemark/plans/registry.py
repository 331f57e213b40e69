"""Names every query of the library; each module of plans/ adds its own."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    import tidemark.plans as here

    for m in sorted(x.name for x in pkgutil.iter_modules(here.__path__)):
        module = importlib.import_module(f"tidemark.plans.{m}")
        if hasattr(module, "QUERIES"):
            yield module


def queries() -> dict[str, Query]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
