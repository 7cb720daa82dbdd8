"""Which datasets are used most."""

from __future__ import annotations

from pyspark.sql import DataFrame

from jobtally import schemas as S
from jobtally.functions import labels as L
from jobtally.operators import aggregates as A, catalogue, clean, hierarchy, topk

METRICS = ("distinct_CRAB_UserHN", "distinct_Workflow", "sum_file_size", "sum_CpuTimeHr")


def daily_cpu(jobs: DataFrame, **conditions) -> DataFrame:
    """CPU hours per UTC day and dataset; no status is left out unless asked."""
    return A.dataset_cpu_by_day(clean.clean_jobs(jobs, [S.DATASET, S.CPU_HR], **conditions))


def daily_top(jobs: DataFrame, k: int = 5, **conditions) -> DataFrame:
    """The k datasets with most CPU hours of each day."""
    return topk.top_per_group(daily_cpu(jobs, **conditions), [S.RECORD_DATE], "Sum_CpuTimeHr", k, [S.DATASET])


def usage_hierarchy(jobs: DataFrame, root: str, k: int = 5, day_label: str = "dd/MM", day_short: str = "dd",
                    **conditions) -> DataFrame:
    """Period, days and each day's top datasets as chart nodes."""
    return hierarchy.usage_hierarchy(daily_cpu(jobs, **conditions), root, k, day_label, day_short)


def dataset_popularity(jobs: DataFrame, sizes: DataFrame, approximate: bool = False, **conditions) -> DataFrame:
    """Users, workflows, size and CPU hours per dataset. ``sizes`` is (dataset, sum_file_size)."""
    cleaned = clean.clean_jobs(jobs, [S.DATASET, S.CPU_HR, S.USER_NAME, S.WORKFLOW], **conditions)
    usage = A.dataset_usage(cleaned, approximate=approximate)
    return catalogue.popularity(usage, sizes).select(S.DATASET, *METRICS)


def most_used_first(popular: DataFrame) -> DataFrame:
    return topk.largest_first(popular, "distinct_Workflow", [S.DATASET])


def top_lists(popular: DataFrame, k: int = 20, with_probes: bool = True) -> DataFrame:
    """The k largest datasets by each of the four metrics, with short names."""
    if not with_probes:
        popular = clean.without_mark(popular, S.DATASET)
    return topk.top_by_each_metric(popular, S.DATASET, METRICS, k).withColumn(
        "short_name", L.short_dataset_name(S.DATASET, cut_last_branch=True))
