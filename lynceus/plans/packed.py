"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.packed_values import packed_values
from ..session import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of an entity's remarks or programs that packs two or more."""
    codes = table(spark, folder, "program_ref").select("program_code")
    return packed_values(table(spark, folder, "entities"), "record_id", ["remarks", "programs"], {"programs": codes})


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
