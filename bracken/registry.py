"""The queries over the reference tables, by name, each with its SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bracken.plans import artifacts, boms, scans

FLAGSHIP = "severity_summary"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return boms.QUERIES | artifacts.QUERIES | scans.QUERIES


def oracle_sql() -> dict[str, str]:
    return boms.ORACLE_SQL | artifacts.ORACLE_SQL | scans.ORACLE_SQL


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to Python workers that would not find them: once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "bracken_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("bracken", os.path.relpath(full, here)))
    context.addPyFile(path)
