"""Where hours go: by tier, by kind of job, by hour, by outcome.

All functions take raw flat records; ``conditions`` are those of
:func:`jobtally.operators.clean.job_filter`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtally import schemas as S
from jobtally.functions import classify as C, labels as L, time as T
from jobtally.operators import aggregates as A, clean, exitcodes, series, shares

# What each analysis carries past the filter.
_HOURS = (S.WALL_HR, S.CORE_HR)
_EFFICIENCY = (S.INPUT_DATA, S.CPU_HR, S.WALL_HR, S.CPUS, S.CORE_HR)


def tier_hours(jobs: DataFrame, statuses=S.FINAL_STATUSES, **conditions) -> DataFrame:
    """Wall and core hours by data tier with their percents, smallest wall hours first."""
    sums = A.hours_by(clean.clean_jobs(jobs, [S.TIER, *_HOURS], statuses=statuses, **conditions), S.TIER)
    return shares.with_percent(sums, wall_pct=A.SUM_WALL, core_pct=A.SUM_CORE).orderBy(
        F.col(A.SUM_WALL).asc_nulls_first(), S.TIER)


def tier_shares(jobs: DataFrame, measure: str = A.SUM_WALL, below: float = 2, statuses=S.FINAL_STATUSES,
                **conditions) -> DataFrame:
    """Chart rows of the same with small tiers folded into ``Others``, which comes last."""
    sums = A.hours_by(clean.clean_jobs(jobs, [S.TIER, *_HOURS], statuses=statuses, **conditions), S.TIER)
    folded = shares.fold_small(sums, S.TIER, measure, below)
    return shares.with_label(folded).orderBy("is_others", "percent", "label")


def type_hours(jobs: DataFrame, statuses=S.FINAL_STATUSES, **conditions) -> DataFrame:
    """Production against analysis hours. The jobs are reduced to one record first,
    the type is looked at after that."""
    cleaned = clean.clean_jobs(jobs, [S.JOB_TYPE, *_HOURS], statuses=statuses, **conditions)
    sums = A.hours_by(cleaned.where(clean.job_filter(types=[S.PRODUCTION, S.ANALYSIS])), S.JOB_TYPE)
    return shares.with_percent(sums, wall_pct=A.SUM_WALL, core_pct=A.SUM_CORE)


def mc_hours(jobs: DataFrame, statuses=S.FINAL_STATUSES, **conditions) -> DataFrame:
    """Monte-Carlo against other hours of analysis jobs."""
    cleaned = clean.clean_jobs(jobs, [S.JOB_TYPE, S.BLOCK, *_HOURS], statuses=statuses, **conditions)
    sums = A.hours_by(cleaned.where(clean.job_filter(types=[S.ANALYSIS])), C.mc_class().alias("isMcprod"))
    return shares.with_percent(sums, wall_pct=A.SUM_WALL, core_pct=A.SUM_CORE)


def hourly_efficiency(jobs: DataFrame, statuses=S.FINAL_STATUSES, **conditions) -> DataFrame:
    """CPU efficiency by UTC hour and on/off-site, in time order; hours as "00" to "23"."""
    hourly = A.efficiency_by_hour(clean.clean_jobs(jobs, _EFFICIENCY, statuses=statuses, **conditions))
    return hourly.orderBy("hour", S.INPUT_DATA).withColumn("hour", T.hour_label("hour"))


def efficiency_series(jobs: DataFrame, value: str = "cpu_eff_wall", statuses=S.FINAL_STATUSES,
                      **conditions) -> DataFrame:
    """The two series over 24 hours, each with its constant mean line."""
    hourly = A.efficiency_by_hour(clean.clean_jobs(jobs, _EFFICIENCY, statuses=statuses, **conditions))
    return series.with_mean_lines(series.align_hours(hourly, value)).orderBy("hour")


def analysis_success(jobs: DataFrame, statuses=S.FINAL_STATUSES, **conditions) -> DataFrame:
    """Success rate of analysis jobs, per job and per core hour."""
    cleaned = clean.clean_jobs(jobs, [S.JOB_TYPE, S.WRAPPER_EXIT_CODE, S.CORE_HR], statuses=statuses, **conditions)
    return A.success_rates(cleaned.where(clean.job_filter(types=[S.ANALYSIS])))


EXIT_DETAIL = (S.JOB_TYPE, S.RECORD_TIME, S.JOB_EXIT_CODE, S.WRAPPER_EXIT_CODE, S.RUN_EXIT_CODE, S.EXIT_CODE)


def exit_code_detail(jobs: DataFrame, statuses=S.FINAL_STATUSES, **conditions) -> DataFrame:
    """All exit codes of analysis jobs that have one, in time order. The job id
    settles equal times and splits a very busy moment over sort tasks."""
    cleaned = clean.clean_jobs(jobs, EXIT_DETAIL, statuses=statuses, **conditions)
    failed = cleaned.where(clean.job_filter(types=[S.ANALYSIS], with_exit_code=True))
    return failed.orderBy(S.RECORD_TIME, S.JOB_ID).select(*EXIT_DETAIL, S.JOB_ID)


def exit_code_shares(jobs: DataFrame, below: float = 1, statuses=S.FINAL_STATUSES, **conditions) -> DataFrame:
    """How often each exit code comes, rare ones folded, with chart texts."""
    cleaned = clean.clean_jobs(jobs, [S.JOB_TYPE, S.EXIT_CODE, S.WALL_HR], statuses=statuses, **conditions)
    counts = A.exit_code_counts(cleaned.where(clean.job_filter(types=[S.ANALYSIS], with_exit_code=True)))
    folded = shares.fold_small(counts, S.EXIT_CODE, "count_ExitCode", below)
    text = F.when(F.col("is_others"), F.col("label")).otherwise(L.code_label("label", "percent"))
    return shares.with_label(folded, text=text).orderBy("is_others", F.col("percent").desc(), "label")


def failure_counts(jobs: DataFrame, *keys: str, types=(S.ANALYSIS,), tool: str | None = None,
                   statuses=("Completed",), **conditions) -> DataFrame:
    """Jobs and wall hours per exit code (and per ``keys``), before any description."""
    keep = [S.EXIT_CODE, S.WALL_HR, *([S.JOB_TYPE] if types else []), *([S.TOOL] if tool else []),
            *(k for k in keys if k != S.RECORD_DATE)]
    cleaned = clean.clean_jobs(jobs, keep, statuses=statuses, **conditions)
    if S.RECORD_DATE in keys:
        cleaned = cleaned.withColumn(S.RECORD_DATE, T.record_date(S.RECORD_TIME))
    return A.exit_code_counts(
        cleaned.where(clean.job_filter(types=types, tool=tool, with_exit_code=True)), *keys)


def failure_reasons(jobs: DataFrame, **options) -> DataFrame:
    """Exit codes by number of jobs and by wall hours, with percents, type and meaning."""
    counts = shares.with_percent(failure_counts(jobs, **options),
                                 count_pct="count_ExitCode", wall_pct="sum_WallClockHr")
    return exitcodes.with_description(counts).orderBy("count_ExitCode", S.EXIT_CODE)


def failure_shares(jobs: DataFrame, measure: str, below: float, **options) -> DataFrame:
    """Chart rows of one measure of :func:`failure_counts`, small codes folded."""
    return shares.fold_small(failure_counts(jobs, **options), S.EXIT_CODE, measure, below)


def failures_over_time(jobs: DataFrame, **options) -> DataFrame:
    """The same per UTC day, described."""
    return exitcodes.with_description(failure_counts(jobs, S.RECORD_DATE, **options))


def rates_by_dimension(jobs: DataFrame, statuses=S.FINAL_STATUSES, **conditions) -> DataFrame:
    """Efficiency, wall hours and failure rate by tier, site, Monte-Carlo class, on/off-site."""
    keep = [S.TIER, S.SITE, S.BLOCK, S.JOB_TYPE, S.EXIT_CODE, *_EFFICIENCY]
    return A.rates_by_dimension(clean.clean_jobs(jobs, keep, statuses=statuses, **conditions), {
        "tier": F.col(S.TIER), "site": F.col(S.SITE), "mc": C.is_mc_job(), "input": F.col(S.INPUT_DATA)})
