"""Grouped sums, counts and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobtally import schemas as S
from jobtally.functions import classify as C, time as T
from jobtally.operators.exact import exact_sum, sum_of_sums

SUM_WALL, SUM_CORE = "Sum_WallClockHr", "Sum_CoreHr"


def hours_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Wall and core hours per key, in one pass; NULL keys form a group. Added exactly, shown as doubles."""
    return df.groupBy(*keys).agg(exact_sum(S.WALL_HR).cast("double").alias(SUM_WALL), exact_sum(S.CORE_HR).cast("double").alias(SUM_CORE))


def efficiency_sums() -> list[Column]:
    """Sums from which efficiencies are made; they can be summed again."""
    return [F.sum(S.CPU_HR).alias("sum_cpu_hr"),
            F.sum(C.core_hours()).alias("sum_wall_by_cpus"),
            F.sum(S.CORE_HR).alias("sum_core_hr")]


def with_efficiency(sums: DataFrame) -> DataFrame:
    """CPU efficiency as a ratio of sums, over both denominators; NULL over zero."""
    return sums.withColumns({
        "cpu_eff_wall": F.try_divide("sum_cpu_hr", "sum_wall_by_cpus"),
        "cpu_eff_core": F.try_divide("sum_cpu_hr", "sum_core_hr"),
    })


def efficiency_by_hour(df: DataFrame, by: str = S.INPUT_DATA) -> DataFrame:
    """CPU efficiency per UTC hour of day and class; ``hour`` is 0-23."""
    return with_efficiency(df.groupBy(T.hour_of_day(S.RECORD_TIME).alias("hour"), by).agg(*efficiency_sums()))


def exit_code_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Jobs and wall hours per exit code, for rows that have one."""
    return df.groupBy(*keys, S.EXIT_CODE).agg(
        F.count(S.EXIT_CODE).alias("count_ExitCode"), exact_sum(S.WALL_HR).cast("double").alias("sum_WallClockHr"))


def outcomes_by_flag(df: DataFrame) -> DataFrame:
    """Failures, successes and core hours per exit flag (0, 1 or NULL)."""
    flagged = df.select(C.exit_flag().alias("exit_flag"), S.CORE_HR)
    return flagged.groupBy("exit_flag").agg(
        F.count_if(F.col("exit_flag") == 1).alias("count_fail"),
        F.count_if(F.col("exit_flag") == 0).alias("count_success"),
        F.sum(S.CORE_HR).alias(SUM_CORE))


def success_rates(df: DataFrame) -> DataFrame:
    """One row: success and failure percent, by jobs and by core hours.

    Jobs without a code count as neither. The values are taken by flag and never
    by the position of a group, which Spark does not define.
    """
    ok, bad = F.col("exit_flag") == 0, F.col("exit_flag") == 1
    sums = df.select(C.exit_flag().alias("exit_flag"), S.CORE_HR).agg(
        F.count_if(ok).alias("count_success"), F.count_if(bad).alias("count_fail"),
        F.sum(F.when(ok, F.col(S.CORE_HR))).alias("core_hr_success"),
        F.sum(F.when(bad, F.col(S.CORE_HR))).alias("core_hr_fail"))

    def percent(part: str, other: str) -> Column:
        total = F.coalesce(F.col(part), F.lit(0)) + F.coalesce(F.col(other), F.lit(0))
        return F.try_divide(F.col(part) * 100.0, total)

    return sums.withColumns({
        "pct_jobs_success": percent("count_success", "count_fail"),
        "pct_jobs_fail": percent("count_fail", "count_success"),
        "pct_core_success": percent("core_hr_success", "core_hr_fail"),
        "pct_core_fail": percent("core_hr_fail", "core_hr_success"),
    })


def dataset_cpu_by_day(df: DataFrame) -> DataFrame:
    """CPU hours per UTC day and dataset, as exact decimals; NULL datasets form a group."""
    return df.groupBy(T.record_date(S.RECORD_TIME).alias(S.RECORD_DATE), S.DATASET).agg(
        exact_sum(S.CPU_HR).alias("Sum_CpuTimeHr"))


def day_totals(daily: DataFrame) -> DataFrame:
    """CPU hours per day, from the day and dataset sums."""
    return daily.groupBy(S.RECORD_DATE).agg(sum_of_sums("Sum_CpuTimeHr").alias("day_cpu_hr"))


def period_total(daily: DataFrame) -> DataFrame:
    """CPU hours of the whole period, one row."""
    return daily.agg(sum_of_sums("Sum_CpuTimeHr").alias("period_cpu_hr"))


def dataset_usage(df: DataFrame, *keys: str, approximate: bool = False) -> DataFrame:
    """CPU hours, distinct users and distinct workflows per dataset.

    Jobs are first brought down to one row per dataset, user and workflow. The
    distinct counts, which copy each input row once per counted column, then run
    over that far smaller table and a hot dataset is spread over its workflows.
    ``approximate`` keeps sketches instead and needs one shuffle only.
    """
    group = [*keys, S.DATASET]
    cpu = exact_sum(S.CPU_HR).alias("sum_CpuTimeHr")
    if approximate:
        return df.groupBy(*group).agg(
            cpu, F.approx_count_distinct(S.USER_NAME).alias("distinct_CRAB_UserHN"),
            F.approx_count_distinct(S.WORKFLOW).alias("distinct_Workflow"))
    small = df.groupBy(*group, S.USER_NAME, S.WORKFLOW).agg(cpu)
    return small.groupBy(*group).agg(
        sum_of_sums("sum_CpuTimeHr").alias("sum_CpuTimeHr"),
        F.count_distinct(S.USER_NAME).alias("distinct_CRAB_UserHN"),
        F.count_distinct(S.WORKFLOW).alias("distinct_Workflow"))


def rates_by_dimension(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Efficiency, wall hours and failure rate per value of each dimension.

    Jobs are summed once over all dimensions together; the dimensions are then
    taken apart over those few rows, so no job row is copied.
    """
    names = list(dimensions)
    cells = df.select(*(c.cast("string").alias(n) for n, c in dimensions.items()),
                      S.CPU_HR, S.WALL_HR, S.CPUS, S.CORE_HR, C.exit_flag(S.EXIT_CODE).alias("exit_flag"))
    sums = cells.groupBy(*names).agg(
        *efficiency_sums(), F.sum(S.WALL_HR).alias("sum_wall_hr"),
        F.count_if(F.col("exit_flag") == 1).alias("jobs_failed"),
        F.count("exit_flag").alias("jobs_with_code"), F.count(F.lit(1)).alias("jobs"))
    measures = [c for c in sums.columns if c not in names]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value"))
                                for n in names))).alias("pair")
    long = sums.select(pairs, *measures).select("pair.*", *measures)
    grouped = long.groupBy("dimension", "value").agg(*(F.sum(m).alias(m) for m in measures))
    return with_efficiency(grouped).withColumn(
        "failure_pct", F.try_divide(F.col("jobs_failed") * 100.0, F.col("jobs_with_code")))


def profile(df: DataFrame, *statistics: str) -> DataFrame:
    """Column profile: count, mean, stddev, min, quartiles, max, as text per column."""
    return df.summary(*statistics)
