"""Every query of the library, and the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contracts, documents, findings, retrieval, reviews, workflows


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return documents.QUERIES | contracts.QUERIES | findings.QUERIES | retrieval.QUERIES | reviews.QUERIES | workflows.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and lexical retrieval, fused: the best five documents of each benchmark item."""
    return retrieval.rrf_fusion(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
