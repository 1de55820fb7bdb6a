"""All queries of the reference's operators, by name, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = (
    "operators.retrieval",
    "operators.contracts",
    "operators.assessment",
    "operators.ledger",
    "operators.graphs",
    "operators.selection",
    "operators.datasets",
    "operators.prompts",
    "functions.text",
    "functions.arithmetic",
    "sources.scripts",
    "sources.bundles",
    "sources.files",
    "plans.narrative",
    "streaming.replay",
)


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"loresmith.{module}")
