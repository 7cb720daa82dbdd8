"""Period, day and top-dataset nodes of a usage chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtally import schemas as S
from jobtally.functions import labels as L
from jobtally.operators import aggregates as A, topk

NODE = ["level", S.RECORD_DATE, "rank", "label", "parent", "value", "hover"]


def usage_hierarchy(daily: DataFrame, root: str, k: int = 5, day_label: str = "dd/MM",
                    day_short: str = "dd") -> DataFrame:
    """(label, parent, value, hover) nodes: period, its days, and k datasets a day.

    ``daily`` holds CPU hours per day and dataset; its grouping is shared by the
    three levels. ``level`` is 0, 1, 2; sort by level, day and rank to draw.
    """
    value = F.col("Sum_CpuTimeHr")
    day = L.name_or_null(F.date_format(S.RECORD_DATE, day_label))
    total = A.period_total(daily).select(
        F.lit(0).alias("level"), F.lit(None).cast("date").alias(S.RECORD_DATE), F.lit(None).cast("int").alias("rank"),
        F.lit(root).alias("label"), F.lit("").alias("parent"), F.col("period_cpu_hr").alias("value"),
        F.lit(root).alias("name"))
    days = A.day_totals(daily).select(
        F.lit(1), S.RECORD_DATE, F.lit(None).cast("int"), day, F.lit(root), "day_cpu_hr", day)
    top = topk.top_per_group(daily, [S.RECORD_DATE], "Sum_CpuTimeHr", k, [S.DATASET]).select(
        F.lit(2), S.RECORD_DATE, "rank", L.rank_label(L.name_or_null(F.date_format(S.RECORD_DATE, day_short)), "rank"),
        day, value, S.DATASET)
    nodes = total.unionAll(days).unionAll(top)
    return nodes.withColumn("hover", L.hover_label("name", "value")).select(*NODE)


def hierarchy_balance(nodes: DataFrame) -> DataFrame:
    """One row: totals of the levels, days minus period (0 if sound), top percent of the period."""
    def level(n: int):
        return F.sum(F.when(F.col("level") == n, F.col("value")))

    return nodes.agg(level(0).alias("period"), level(1).alias("days"), level(2).alias("top")).withColumns({
        "nodes_minus_root": F.col("days") + F.col("top"),
        "top_part": F.col("days") + F.col("top") - F.col("period"),
        "days_minus_period": F.col("days") - F.col("period"),
        "top_pct": F.try_divide(F.col("top") * 100.0, F.col("period")),
    })
