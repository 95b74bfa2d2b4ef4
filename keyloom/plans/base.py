"""A registered query: its Spark form and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Plan:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
