"""All queries over the driver's tables, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaylight.plans import book, calls, desk, domains, evidence, files, filings, kernel, reactions, relations, replay, states, streams, texts  # noqa: F401
from quaylight.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rxn06_moves"](spark, sf_dir)
