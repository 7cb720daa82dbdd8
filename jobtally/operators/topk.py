"""Largest rows, overall and per group. Ties are settled by name, NULLs come last.

Values are ranked as they are. Sums of fractions should be exact ones
(:mod:`jobtally.operators.exact`): added as doubles, what should be equal differs
in its last digits from run to run, and ranks with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from jobtally.operators.exact import TOTAL, exact


def _order(value: str, ties: Sequence[str]):
    return [F.col(value).desc_nulls_last(), *(F.col(t).asc_nulls_first() for t in ties)]


def largest_first(df: DataFrame, value: str, ties: Sequence[str]) -> DataFrame:
    """Sorted by value, largest first. The ties also split a value many rows share
    over several tasks of the sort, which the value alone could not."""
    return df.orderBy(*_order(value, ties))


def top_rows(df: DataFrame, value: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k largest rows; each task keeps k, one merge follows."""
    return largest_first(df, value, ties).limit(k)


def top_per_group(df: DataFrame, group: Sequence[str], value: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k largest rows of each group with their ``rank``, in one pass.

    Tasks drop all but their own k rows of a group before the shuffle, so a big
    group never meets in one task.
    """
    order = W.partitionBy(*group).orderBy(*_order(value, ties))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_by_each_metric(df: DataFrame, key: str, metrics: Sequence[str], k: int) -> DataFrame:
    """(metric, rank, key, value): the k largest rows by each metric, all in one pass; values are decimals."""
    decimal = lambda m: (exact(m) if isinstance(df.schema[m].dataType, DoubleType) else F.col(m)).cast(TOTAL).alias(m)
    long = df.select(key, *map(decimal, metrics)).unpivot(
        [key], list(metrics), "metric", "value")
    return top_per_group(long, ["metric"], "value", k, [key]).select("metric", "rank", key, "value")


def stack(*branches: DataFrame) -> DataFrame:
    """All rows of all branches, by position, duplicates kept."""
    first, *rest = branches
    for branch in rest:
        first = first.unionAll(branch)
    return first
