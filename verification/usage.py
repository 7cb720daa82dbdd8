"""Hours, efficiency, outcomes: queries on the job records alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtally import schemas as S, sinks
from jobtally.functions import classify as C
from jobtally.operators import aggregates as A, clean, exitcodes, shares
from jobtally.plans import usage
from verification.bindings import (DAY, EVENTS_CTE, FINAL, JOBS_CTE, clean_cte, events_as_jobs, jobs)
from verification.registry import query

HOURS = ["WallClockHr", "CoreHr"]
EFFICIENCY = ["InputData", "CpuTimeHr", "WallClockHr", "RequestCpus", "CoreHr"]
HOUR = "CAST((RecordTime % 86400000) // 3600000 AS INT)"
EFFICIENCY_SUMS = ("sum(CpuTimeHr) AS sum_cpu_hr, sum(WallClockHr * RequestCpus) AS sum_wall_by_cpus, "
                   "sum(CoreHr) AS sum_core_hr")
EFFICIENCY_RATIOS = ("sum(CpuTimeHr) / nullif(sum(WallClockHr * RequestCpus), 0) AS cpu_eff_wall, "
                     "sum(CpuTimeHr) / nullif(sum(CoreHr), 0) AS cpu_eff_core")


def final(keep, source=JOBS_CTE, where=FINAL, **kw):
    return f"WITH {source}, {clean_cte(keep, where, **kw)}"


def sums(key, where="TRUE"):
    return (f"sums AS (SELECT {key}, sum(WallClockHr) AS Sum_WallClockHr, sum(CoreHr) AS Sum_CoreHr "
            f"FROM clean WHERE {where} GROUP BY 1)")


PERCENTS = ("SELECT *, 100 * Sum_WallClockHr / sum(Sum_WallClockHr) OVER () AS wall_pct, "
            "100 * Sum_CoreHr / sum(Sum_CoreHr) OVER () AS core_pct FROM sums")
PERCENT_COLUMNS = "Sum_WallClockHr Sum_CoreHr wall_pct core_pct"


def folded(source, key, value, below):
    return (f"pct AS (SELECT coalesce(CAST({key} AS STRING), 'Null') AS label, "
            f"100.0 * {value} / sum({value}) OVER () AS percent FROM {source}), "
            f"fold AS (SELECT label, percent, FALSE AS is_others FROM pct WHERE percent >= {below} UNION ALL "
            f"SELECT 'Others', coalesce(sum(percent), 0.0), TRUE FROM pct WHERE percent < {below})")


# --- tiers, types, Monte Carlo -------------------------------------------------

@query("Q1 AGG1 AGG2 SRT1 SHR1 PRJ5", final(["CMSPrimaryDataTier", *HOURS]) + ", " + sums("CMSPrimaryDataTier")
       + " " + PERCENTS, PERCENT_COLUMNS)
def hours_by_tier(spark, sf_dir):
    return usage.tier_hours(jobs(spark, sf_dir, S.TIER, S.STATUS, *HOURS))


@query("AGG1 SRT1", final(["CMSPrimaryDataTier", "WallClockHr"]) +
       " SELECT CMSPrimaryDataTier, sum(WallClockHr) AS Sum_WallClockHr FROM clean GROUP BY 1", "Sum_WallClockHr")
def wall_hours_by_tier(spark, sf_dir):
    cleaned = clean.clean_jobs(jobs(spark, sf_dir, S.TIER, S.STATUS, S.WALL_HR), [S.TIER, S.WALL_HR],
                               statuses=S.FINAL_STATUSES)
    return cleaned.groupBy(S.TIER).agg(F.sum(S.WALL_HR).alias("Sum_WallClockHr")).sort("Sum_WallClockHr")


@query("Q1 SHR2 SHR4 LBL1 FN10", final(["CMSPrimaryDataTier", *HOURS]) + ", " + sums("CMSPrimaryDataTier") + ", "
       + folded("sums", "CMSPrimaryDataTier", "Sum_WallClockHr", 17) +
       " SELECT *, label || ': ' || printf('%.3f', percent) || '%' AS text FROM fold", "percent")
def tier_shares_folded(spark, sf_dir):
    return usage.tier_shares(jobs(spark, sf_dir, S.TIER, S.STATUS, *HOURS), below=17)


@query("SHR2", final(["CMSPrimaryDataTier", *HOURS]) + ", " + sums("CMSPrimaryDataTier") + ", "
       + folded("sums", "CMSPrimaryDataTier", "Sum_CoreHr", 17) +
       " SELECT label, percent FROM pct WHERE percent < 17", "percent")
def tier_shares_members_of_others(spark, sf_dir):
    cleaned = clean.clean_jobs(jobs(spark, sf_dir, S.TIER, S.STATUS, *HOURS), [S.TIER, *HOURS],
                               statuses=S.FINAL_STATUSES)
    return shares.folded_members(A.hours_by(cleaned, S.TIER), S.TIER, A.SUM_CORE, 17)


@query("Q2 FIL6 AGG2 SHR1", final(["Type", *HOURS]) + ", "
       + sums("Type", "Type IN ('production', 'analysis')") + " " + PERCENTS, PERCENT_COLUMNS)
def hours_by_type(spark, sf_dir):
    return usage.type_hours(jobs(spark, sf_dir, S.JOB_TYPE, S.STATUS, *HOURS))


@query("Q3 FIL3 PRJ7 AGG2 FN6", final(["Type", "CRAB_DataBlock", *HOURS]) + ", "
       + sums("CASE WHEN CRAB_DataBlock = 'MCFakeBlock' THEN 'mc' ELSE 'notMc' END AS isMcprod", "Type = 'analysis'")
       + " " + PERCENTS, PERCENT_COLUMNS)
def hours_of_monte_carlo(spark, sf_dir):
    return usage.mc_hours(jobs(spark, sf_dir, S.JOB_TYPE, S.BLOCK, S.STATUS, *HOURS))


@query("AGG4 PRJ2 SNK5 FN7", final(["CMSPrimaryDataTier", *HOURS]) +
       " SELECT CMSPrimaryDataTier, sum(WallClockHr) AS sumWallClockHr FROM clean GROUP BY 1", "sumWallClockHr")
def wall_hours_by_tier_from_sql_text(spark, sf_dir):
    """SQL text over nested records, as a user of a session view writes it."""
    cleaned = clean.clean_jobs(jobs(spark, sf_dir, S.TIER, S.STATUS, *HOURS), [S.TIER, *HOURS],
                               statuses=S.FINAL_STATUSES)
    nested = cleaned.select(F.struct(S.TIER, S.WALL_HR).alias("data"))
    return sinks.register_view(nested, "nested_jobs").sql(
        "SELECT data['CMSPrimaryDataTier'] AS CMSPrimaryDataTier, sum(data['WallClockHr']) AS sumWallClockHr "
        "FROM nested_jobs GROUP BY data['CMSPrimaryDataTier'] ORDER BY sum(data['WallClockHr'])")


# --- efficiency ----------------------------------------------------------------

@query("Q4 FN1 FN2 FN5 AGG9 AGG10 AGG11 SRT4", final(EFFICIENCY, EVENTS_CTE) +
       f" SELECT lpad(CAST({HOUR} AS STRING), 2, '0') AS hour, InputData, {EFFICIENCY_SUMS}, {EFFICIENCY_RATIOS} "
       "FROM clean GROUP BY 1, 2", "sum_cpu_hr sum_wall_by_cpus sum_core_hr cpu_eff_wall cpu_eff_core")
def efficiency_by_hour(spark, sf_dir):
    return usage.hourly_efficiency(events_as_jobs(spark, sf_dir, S.STATUS, *EFFICIENCY))


@query("SNK5 AGG9 AGG10 AGG11 SRT4 FN1 FN2 FN4 FN5", final(EFFICIENCY, EVENTS_CTE) +
       f" SELECT lpad(CAST({HOUR} AS STRING), 2, '0') AS hour, InputData, {EFFICIENCY_SUMS}, {EFFICIENCY_RATIOS} "
       "FROM clean GROUP BY 1, 2", "sum_cpu_hr sum_wall_by_cpus sum_core_hr cpu_eff_wall cpu_eff_core")
def efficiency_by_hour_from_sql_text(spark, sf_dir):
    cleaned = clean.clean_jobs(events_as_jobs(spark, sf_dir, S.STATUS, *EFFICIENCY), EFFICIENCY,
                               statuses=S.FINAL_STATUSES)
    return sinks.register_view(cleaned, "jobs_of_period").sql("""
        SELECT date_format(timestamp_millis(RecordTime), 'HH') AS hour, InputData,
               sum(CpuTimeHr) AS sum_cpu_hr, sum(WallClockHr * RequestCpus) AS sum_wall_by_cpus,
               sum(CoreHr) AS sum_core_hr,
               try_divide(sum(CpuTimeHr), sum(WallClockHr * RequestCpus)) AS cpu_eff_wall,
               try_divide(sum(CpuTimeHr), sum(CoreHr)) AS cpu_eff_core
        FROM jobs_of_period GROUP BY hour, InputData ORDER BY hour""")


@query("Q4 SER1 SER2 AGG16 FIL11", final(EFFICIENCY, EVENTS_CTE) +
       f", eff AS (SELECT {HOUR} AS hour, InputData, {EFFICIENCY_RATIOS} FROM clean GROUP BY 1, 2), "
       "wide AS (SELECT CAST(h AS INT) AS hour, max(cpu_eff_wall) FILTER (InputData = 'Onsite') AS Onsite, "
       "max(cpu_eff_wall) FILTER (InputData = 'Offsite') AS Offsite FROM range(24) AS r(h) "
       "LEFT JOIN eff ON h = hour GROUP BY 1) "
       "SELECT *, avg(Onsite) OVER () AS mean_Onsite, avg(Offsite) OVER () AS mean_Offsite FROM wide",
       "Onsite Offsite mean_Onsite mean_Offsite")
def efficiency_series(spark, sf_dir):
    return usage.efficiency_series(events_as_jobs(spark, sf_dir, S.STATUS, *EFFICIENCY))


@query("FIL11", final(EFFICIENCY, EVENTS_CTE) +
       f" SELECT {HOUR} AS hour, InputData, {EFFICIENCY_SUMS}, {EFFICIENCY_RATIOS} FROM clean "
       "WHERE InputData = 'Offsite' GROUP BY 1, 2",
       "sum_cpu_hr sum_wall_by_cpus sum_core_hr cpu_eff_wall cpu_eff_core")
def efficiency_offsite_only(spark, sf_dir):
    cleaned = clean.clean_jobs(events_as_jobs(spark, sf_dir, S.STATUS, *EFFICIENCY), EFFICIENCY,
                               statuses=S.FINAL_STATUSES)
    return A.efficiency_by_hour(cleaned).where(F.col(S.INPUT_DATA) == S.OFFSITE)


RATE_KEEP = ["CMSPrimaryDataTier", "CMSSite", "CRAB_DataBlock", "Type", "ExitCode", *EFFICIENCY]


@query("asked-for: rates by dimension; PRJ10", final(RATE_KEEP) + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, {e} AS value, * FROM clean" for n, e in (
        ("tier", "CMSPrimaryDataTier"), ("site", "CMSSite"),
        ("mc", "CAST(coalesce(CRAB_DataBlock = 'MCFakeBlock' AND Type = 'analysis', FALSE) AS STRING)"),
        ("input", "InputData"))) +
    f") SELECT dimension, value, {EFFICIENCY_SUMS}, sum(WallClockHr) AS sum_wall_hr, "
    "count(*) FILTER (ExitCode <> 0) AS jobs_failed, count(ExitCode) AS jobs_with_code, count(*) AS jobs, "
    f"{EFFICIENCY_RATIOS}, 100.0 * count(*) FILTER (ExitCode <> 0) / nullif(count(ExitCode), 0) AS failure_pct "
    "FROM long GROUP BY 1, 2",
    "sum_cpu_hr sum_wall_by_cpus sum_core_hr sum_wall_hr cpu_eff_wall cpu_eff_core failure_pct")
def rates_by_dimension(spark, sf_dir):
    return usage.rates_by_dimension(jobs(spark, sf_dir, S.STATUS, *RATE_KEEP))


# --- outcomes and exit codes ---------------------------------------------------
OUTCOME_KEEP = ["Type", "Chirp_CRAB3_Job_ExitCode", "CoreHr"]
FLAG = "CASE WHEN Chirp_CRAB3_Job_ExitCode <> 0 THEN 1 ELSE Chirp_CRAB3_Job_ExitCode END"


@query("AGG7 AGG17 PRJ8", final(OUTCOME_KEEP) +
       f" SELECT CAST({FLAG} AS BIGINT) AS exit_flag, count(*) FILTER (Chirp_CRAB3_Job_ExitCode <> 0) AS count_fail, "
       "count(*) FILTER (Chirp_CRAB3_Job_ExitCode = 0) AS count_success, sum(CoreHr) AS Sum_CoreHr FROM clean "
       "WHERE Type = 'analysis' GROUP BY 1", "Sum_CoreHr")
def outcomes_by_exit_flag(spark, sf_dir):
    cleaned = clean.clean_jobs(jobs(spark, sf_dir, S.STATUS, *OUTCOME_KEEP), OUTCOME_KEEP, statuses=S.FINAL_STATUSES)
    return A.outcomes_by_flag(cleaned.where(F.col(S.JOB_TYPE) == S.ANALYSIS))


@query("Q5 AGG7 AGG17 PRJ8", final(OUTCOME_KEEP) +
       ", o AS (SELECT count(*) FILTER (Chirp_CRAB3_Job_ExitCode = 0) AS count_success, "
       "count(*) FILTER (Chirp_CRAB3_Job_ExitCode <> 0) AS count_fail, "
       "sum(CoreHr) FILTER (Chirp_CRAB3_Job_ExitCode = 0) AS core_hr_success, "
       "sum(CoreHr) FILTER (Chirp_CRAB3_Job_ExitCode <> 0) AS core_hr_fail FROM clean WHERE Type = 'analysis') "
       "SELECT *, 100.0 * count_success / (count_success + count_fail) AS pct_jobs_success, "
       "100.0 * count_fail / (count_success + count_fail) AS pct_jobs_fail, "
       "100.0 * core_hr_success / (core_hr_success + core_hr_fail) AS pct_core_success, "
       "100.0 * core_hr_fail / (core_hr_success + core_hr_fail) AS pct_core_fail FROM o",
       "core_hr_success core_hr_fail pct_jobs_success pct_jobs_fail pct_core_success pct_core_fail")
def analysis_success_rate(spark, sf_dir):
    return usage.analysis_success(jobs(spark, sf_dir, S.STATUS, *OUTCOME_KEEP))


DETAIL = ["Type", "RecordTime", "JobExitCode", "Chirp_CRAB3_Job_ExitCode", "Chirp_WMCore_cmsRun_ExitCode", "ExitCode"]


@query("Q6 PRJ3 FIL8 SRT3", final(DETAIL) + " SELECT " + ", ".join(DETAIL) +
       ", GlobalJobId FROM clean WHERE Type = 'analysis' AND ExitCode IS NOT NULL")
def exit_code_detail(spark, sf_dir):
    return usage.exit_code_detail(jobs(spark, sf_dir, S.STATUS, *DETAIL))


@query("Q6 FIL5", final(DETAIL) + " SELECT " + ", ".join(DETAIL) + ", GlobalJobId FROM clean "
       "WHERE Type = 'analysis' AND ExitCode IS NOT NULL AND Chirp_WMCore_cmsRun_ExitCode IS NOT NULL")
def exit_code_detail_of_run_step(spark, sf_dir):
    return usage.exit_code_detail(jobs(spark, sf_dir, S.STATUS, *DETAIL)).where(F.col(S.RUN_EXIT_CODE).isNotNull())


CODES = ["Type", "ExitCode", "WallClockHr"]


def counts(where, keys="ExitCode"):
    return (f"counts AS (SELECT {keys}, count(ExitCode) AS count_ExitCode, sum(WallClockHr) AS sum_WallClockHr "
            f"FROM clean WHERE {where} GROUP BY ALL)")


ANALYSIS = "Type = 'analysis' AND ExitCode IS NOT NULL"
TYPE_OF = ("CASE WHEN ExitCode BETWEEN 1 AND 512 THEN 'standard ones in Unix and indicate a CMSSW abort that the "
           "cmsRun did not catch as exception' WHEN ExitCode BETWEEN 7000 AND 9000 THEN 'cmsRun (CMSSW) exit codes. "
           "These codes may depend on specific CMSSW version' WHEN ExitCode BETWEEN 50000 AND 59999 THEN "
           "'Failures related executable file' ELSE '' END")
MEANING_OF = ("CASE ExitCode WHEN 8021 THEN 'FileReadError (May be a site error)' "
              "WHEN 8028 THEN 'FileOpenError with fallback' "
              "WHEN 50660 THEN 'Application terminated by wrapper because using too much RAM (RSS)' ELSE '' END")


@query("AGG5 SRT2 FN8", final(CODES) + ", " + counts(ANALYSIS) + " SELECT ExitCode, count_ExitCode FROM counts")
def exit_code_counts(spark, sf_dir):
    cleaned = clean.clean_jobs(jobs(spark, sf_dir, S.STATUS, *CODES), CODES, statuses=S.FINAL_STATUSES)
    failed = cleaned.where(clean.job_filter(types=[S.ANALYSIS], with_exit_code=True))
    return A.exit_code_counts(failed).select(S.EXIT_CODE, "count_ExitCode").sort(F.col("count_ExitCode").desc())


@query("Q7 AGG5 SRT2 SHR3 LBL2", final(CODES) + ", " + counts(ANALYSIS) + ", "
       + folded("counts", "ExitCode", "count_ExitCode", 12.5) +
       " SELECT *, CASE WHEN is_others THEN label ELSE 'code ' || label || ': ' || printf('%.3f', percent) || '%' END "
       "AS text FROM fold", "percent")
def exit_code_shares(spark, sf_dir):
    return usage.exit_code_shares(jobs(spark, sf_dir, S.STATUS, *CODES), below=12.5)


@query("Q8 AGG6 FIL8 EXC1 JN8 JN9 SRC7 SHR1", final(CODES, where="Status IN ('Completed')") + ", " + counts(ANALYSIS) +
       f" SELECT *, 100.0 * count_ExitCode / sum(count_ExitCode) OVER () AS count_pct, "
       f"100.0 * sum_WallClockHr / sum(sum_WallClockHr) OVER () AS wall_pct, {TYPE_OF} AS Type, {MEANING_OF} "
       "AS Meaning FROM counts", "sum_WallClockHr count_pct wall_pct")
def failure_reasons(spark, sf_dir):
    return usage.failure_reasons(jobs(spark, sf_dir, S.STATUS, *CODES))


@query("Q8 SHR2 SHR4", final(CODES, where="Status IN ('Completed')") + ", " + counts(ANALYSIS) + ", "
       + folded("counts", "ExitCode", "sum_WallClockHr", 12.5) + " SELECT * FROM fold", "percent")
def failure_shares_by_wall_hours(spark, sf_dir):
    return usage.failure_shares(jobs(spark, sf_dir, S.STATUS, *CODES), "sum_WallClockHr", 12.5)


TOOL_CODES = ["ExitCode", "WallClockHr", "CMS_SubmissionTool"]
OF_TOOL = "CMS_SubmissionTool = 'CRAB' AND ExitCode IS NOT NULL"


@query("Q9 FIL9 AGG6 SHR2", final(TOOL_CODES, where="Status IN ('Completed')") + ", " + counts(OF_TOOL) +
       f" SELECT *, 100.0 * count_ExitCode / sum(count_ExitCode) OVER () AS count_pct, "
       f"100.0 * sum_WallClockHr / sum(sum_WallClockHr) OVER () AS wall_pct, {TYPE_OF} AS Type, {MEANING_OF} "
       "AS Meaning FROM counts", "sum_WallClockHr count_pct wall_pct")
def failure_reasons_of_one_tool(spark, sf_dir):
    df = jobs(spark, sf_dir, S.STATUS, *TOOL_CODES)
    return usage.failure_reasons(df, types=None, tool=S.ANALYSIS_TOOL)


@query("Q9 SHR2 SHR4", final(TOOL_CODES, where="Status IN ('Completed')") + ", " + counts(OF_TOOL) + ", "
       + folded("counts", "ExitCode", "count_ExitCode", 0.5) + " SELECT * FROM fold", "percent")
def failure_shares_of_one_tool(spark, sf_dir):
    return usage.failure_shares(jobs(spark, sf_dir, S.STATUS, *TOOL_CODES), "count_ExitCode", 0.5, types=None,
                                tool=S.ANALYSIS_TOOL)


@query("asked-for: failures over time; EXC1", final(CODES, where="Status IN ('Completed')") + ", "
       + counts(ANALYSIS, f"CAST({DAY} AS STRING) AS record_date, ExitCode") +
       f" SELECT *, {TYPE_OF} AS Type, {MEANING_OF} AS Meaning FROM counts", "sum_WallClockHr")
def failure_reasons_by_day(spark, sf_dir):
    return usage.failures_over_time(jobs(spark, sf_dir, S.STATUS, *CODES))


@query("JN8 SRC7", final(["ExitCode"], EVENTS_CTE) +
       f" SELECT GlobalJobId, ExitCode, {MEANING_OF} AS Meaning FROM clean")
def exit_code_meaning_of_every_job(spark, sf_dir):
    cleaned = clean.clean_jobs(events_as_jobs(spark, sf_dir, S.STATUS, S.EXIT_CODE), [S.EXIT_CODE],
                               statuses=S.FINAL_STATUSES)
    return exitcodes.with_meaning(cleaned).select(S.JOB_ID, S.EXIT_CODE, "Meaning")


@query("JN9", final(["ExitCode"]) + f" SELECT {TYPE_OF} AS type, count(*) AS jobs FROM clean GROUP BY 1")
def jobs_by_exit_code_type(spark, sf_dir):
    cleaned = clean.clean_jobs(jobs(spark, sf_dir, S.STATUS, S.EXIT_CODE), [S.EXIT_CODE], statuses=S.FINAL_STATUSES)
    return cleaned.groupBy(C.exit_type().alias("type")).agg(F.count(F.lit(1)).alias("jobs"))
