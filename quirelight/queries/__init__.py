"""Registered queries of the core: name -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelight.queries import composite, hierarchy, python, relational, structure, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (hierarchy, relational, text, python, composite, structure)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
