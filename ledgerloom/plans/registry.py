"""All queries of the library and their SQL twins, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: list[str] = [
    "ledgerloom.operators.scoring",
    "ledgerloom.operators.normalise",
    "ledgerloom.operators.coverage",
    "ledgerloom.operators.joins",
    "ledgerloom.operators.risk",
    "ledgerloom.operators.windows",
    "ledgerloom.operators.ranges",
    "ledgerloom.operators.planning",
    "ledgerloom.operators.detectors",
    "ledgerloom.operators.grading",
    "ledgerloom.operators.scalars",
    "ledgerloom.operators.workflows",
    "ledgerloom.operators.dependencies",
    "ledgerloom.operators.verdicts",
    "ledgerloom.operators.artifacts",
    "ledgerloom.operators.texts",
    "ledgerloom.operators.facts",
    "ledgerloom.operators.selections",
    "ledgerloom.sources.readers",
    "ledgerloom.sources.tolerant",
    "ledgerloom.streaming.progress",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found.update(import_module(module).QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found.update(import_module(module).ORACLES)
    return found
