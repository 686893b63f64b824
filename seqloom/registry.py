"""Every registered query over the fixtures, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqloom.plans import format_queries, genome_queries, read_queries, variant_queries
from seqloom.plans.fixtures import Build, Tables

ENTRIES = variant_queries.ENTRIES | genome_queries.ENTRIES | read_queries.ENTRIES | format_queries.ENTRIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sites vary, and how: allele depths to genotype calls to site summaries."""
    return ENTRIES["V14"][0](Tables(spark, sf_dir))


def _bound(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(build) for name, (build, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
