"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("page_queries", "retrieval_queries", "structure_queries", "compare_queries", "grounding_queries", "profile_queries", "source_queries", "stream_queries")

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out.update(import_module(f"leafmill.plans.{name}").QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"leafmill.plans.{name}").ORACLES)
    return out
