"""Percent of total, and folding of small shares into one row.

The total is a scalar subquery over the same grouped rows: Spark runs the
grouping once (the exchange is reused) and no window over everything is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobtally.functions import labels as L

OTHERS = "Others"


def with_percent(grouped: DataFrame, **columns: str) -> DataFrame:
    """Add ``new_name=value_column`` percents of the column totals.

    NULL values get a NULL percent and do not count; a zero total gives NULL.
    """
    sums = F.struct(*(F.sum(v).alias(v) for v in columns.values()))
    total = grouped.agg(sums.alias("total")).scalar()
    return grouped.withColumns({
        name: F.try_divide(F.col(value) * 100.0, total[value]) for name, value in columns.items()
    })


def fold_small(grouped: DataFrame, key: str, value: str, below: float) -> DataFrame:
    """(label, percent, is_others): shares under ``below`` percent summed into ``Others``.

    A share equal to the limit stays. The ``Others`` row is always there, with 0
    when nothing was folded; sort by ``is_others`` first to have it last.
    """
    shares = _shares(grouped, key, value)
    kept = shares.where(F.col("percent") >= below).select(
        L.name_or_null(key).alias("label"), "percent", F.lit(False).alias("is_others"))
    folded = F.sum(F.when(F.col("percent") < below, F.col("percent")))
    return kept.unionAll(shares.agg(
        F.lit(OTHERS).alias("label"), F.coalesce(folded, F.lit(0.0)).alias("percent"),
        F.lit(True).alias("is_others")))


def folded_members(grouped: DataFrame, key: str, value: str, below: float) -> DataFrame:
    """(label, percent) of what :func:`fold_small` put into ``Others``."""
    return _shares(grouped, key, value).where(F.col("percent") < below).select(
        L.name_or_null(key).alias("label"), "percent")


def with_label(shares: DataFrame, label: str = "label", percent: str = "percent",
               text: Column | None = None) -> DataFrame:
    """Add the chart text ``label: 12.345%``, or another text built from the row."""
    return shares.withColumn("text", L.percent_label(label, percent) if text is None else text)


def _shares(grouped: DataFrame, key: str, value: str) -> DataFrame:
    return with_percent(grouped.select(key, value), percent=value)
