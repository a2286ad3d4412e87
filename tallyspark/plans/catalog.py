"""All registered queries."""

from __future__ import annotations

from tallyspark.plans import corpus, functions, generation, metrics, pipelines, receipts, sampling  # noqa: F401
from tallyspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
