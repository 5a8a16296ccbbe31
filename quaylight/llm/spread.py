"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks among which the narrow rows of a frequent key are dealt.
LOTS = 16


def unused(name: str, columns: Iterable[str]) -> str:
    """``name`` with underscores before it, until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_lots(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the narrow ``table``, whose keys are unique; the rows of a key are dealt to ``LOTS`` tasks by ``by``."""
    many = table.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))
    return rows.withColumn("lot", F.pmod(F.xxhash64(by), F.lit(LOTS)).cast("int")).join(many, [*on, "lot"], how).drop("lot")
