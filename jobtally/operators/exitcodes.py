"""Texts for exit codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtally import schemas as S
from jobtally.functions import classify as C
from jobtally.sources.exitcodes import exit_code_meanings


def with_meaning(df: DataFrame, code: str = S.EXIT_CODE) -> DataFrame:
    """Add ``Meaning``; "" for codes that are not in the table and for NULL.

    The table has a fixed number of rows, so broadcasting it is safe at any scale.
    """
    lookup = F.broadcast(exit_code_meanings(df.sparkSession))
    return (df.join(lookup, df[code] == lookup["code"], "left")
            .withColumn("Meaning", F.coalesce("meaning", F.lit(""))).drop("code"))


def with_description(df: DataFrame, code: str = S.EXIT_CODE) -> DataFrame:
    """Add ``Type`` and ``Meaning`` of the code."""
    return with_meaning(df.withColumn("Type", C.exit_type(code)), code)
