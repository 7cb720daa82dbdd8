"""Single operators: projections, classes, filters, de-duplication, scalar functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from jobtally import schemas as S
from jobtally.functions import classify as C, labels as L, time as T
from jobtally.operators import clean, shares
from jobtally.sources import jobs as source
from jobtally.sources.windows import TimeWindow, calendar_of, days_of
from verification.bindings import (DAY, EVENTS_CTE, JOBS_CTE, clean_cte, events_as_jobs, jobs)
from verification.registry import query
from verification.usage import HOUR, final

RAW = f"WITH {JOBS_CTE} "
RAW_EVENTS = f"WITH {EVENTS_CTE} "
def count_jobs():
    return F.count(F.lit(1)).alias("jobs")


# --- projections ---------------------------------------------------------------

@query("PRJ1", RAW + "SELECT GlobalJobId, RecordTime, CMSSite, WallClockHr, ExitCode FROM raw", "WallClockHr")
def nested_records_flattened(spark, sf_dir):
    columns = [S.JOB_ID, S.RECORD_TIME, S.SITE, S.WALL_HR, S.EXIT_CODE]
    nested = jobs(spark, sf_dir, *columns).select(F.struct(*columns).alias("data"))
    return source.flatten(nested)


@query("PRJ3 PRJ4", "SELECT l_orderkey AS task_number, l_quantity AS hours FROM lineitem", "hours")
def columns_selected_and_renamed(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lineitem.select("l_orderkey", "l_quantity").withColumnsRenamed(
        {"l_orderkey": "task_number", "l_quantity": "hours"})


@query("PRJ7", RAW + "SELECT GlobalJobId, RecordTime, CRAB_DataBlock, "
       "CASE WHEN CRAB_DataBlock = 'MCFakeBlock' THEN 'mc' ELSE 'notMc' END AS isMcprod FROM raw")
def monte_carlo_class_per_record(spark, sf_dir):
    return jobs(spark, sf_dir, S.BLOCK).withColumn("isMcprod", C.mc_class())


@query("PRJ8", RAW + "SELECT GlobalJobId, RecordTime, Chirp_CRAB3_Job_ExitCode, CAST(CASE WHEN "
       "Chirp_CRAB3_Job_ExitCode <> 0 THEN 1 ELSE Chirp_CRAB3_Job_ExitCode END AS BIGINT) AS exit_flag FROM raw")
def exit_flag_per_record(spark, sf_dir):
    return jobs(spark, sf_dir, S.WRAPPER_EXIT_CODE).withColumn("exit_flag", C.exit_flag())


@query("PRJ9", RAW + "SELECT CASE WHEN ExitCode = 0 THEN 'Success' WHEN ExitCode IS NOT NULL THEN 'Fail' "
       "ELSE 'Null Exit Code' END AS exit_class, count(*) AS jobs FROM raw GROUP BY 1")
def records_by_exit_class(spark, sf_dir):
    return jobs(spark, sf_dir, S.EXIT_CODE).groupBy(C.exit_class().alias("exit_class")).agg(count_jobs())


@query("PRJ10", RAW + "SELECT coalesce(CRAB_DataBlock = 'MCFakeBlock' AND Type = 'analysis', FALSE) AS is_mc, "
       "count(*) AS jobs FROM raw GROUP BY 1")
def records_by_monte_carlo_flag(spark, sf_dir):
    return jobs(spark, sf_dir, S.BLOCK, S.JOB_TYPE).groupBy(C.is_mc_job().alias("is_mc")).agg(count_jobs())


@query("PRJ11 PRJ12 FN5", RAW + "SELECT GlobalJobId, RecordTime, WallClockHr * RequestCpus AS core_hr, "
       "CpuTimeHr / nullif(WallClockHr * RequestCpus, 0) AS cpu_eff, "
       "abs(WallClockHr * RequestCpus - CoreHr) < 1e-6 AS core_hr_agrees FROM raw", "core_hr cpu_eff")
def efficiency_per_record(spark, sf_dir):
    return jobs(spark, sf_dir, S.WALL_HR, S.CPUS, S.CPU_HR, S.CORE_HR).select(
        S.JOB_ID, S.RECORD_TIME, C.core_hours().alias("core_hr"), C.cpu_efficiency().alias("cpu_eff"),
        (F.abs(C.core_hours() - F.col(S.CORE_HR)) < 1e-6).alias("core_hr_agrees"))


# --- filters -------------------------------------------------------------------

@query("FIL1", RAW + "SELECT GlobalJobId, RecordTime, Status FROM raw "
       "WHERE Status IN ('Completed', 'Removed', 'Held', 'Error')")
def records_with_final_status(spark, sf_dir):
    return jobs(spark, sf_dir, S.STATUS).where(clean.job_filter(statuses=S.FINAL_STATUSES))


PERIOD = TimeWindow(datetime(1997, 1, 1), datetime(1998, 1, 1))


@query("FIL2 SRC9 FN13", RAW + "SELECT GlobalJobId, RecordTime, WallClockHr FROM raw WHERE "
       "RecordTime >= epoch_ms(TIMESTAMP '1997-01-01') AND RecordTime < epoch_ms(TIMESTAMP '1998-01-01')", "WallClockHr")
def records_in_time_range(spark, sf_dir):
    return jobs(spark, sf_dir, S.WALL_HR).where(PERIOD.contains())


@query("FIL3", RAW + "SELECT GlobalJobId, RecordTime, CMS_SubmissionTool FROM raw WHERE CMS_SubmissionTool = 'CRAB'")
def records_of_one_tool(spark, sf_dir):
    return jobs(spark, sf_dir, S.TOOL).where(clean.job_filter(tool=S.ANALYSIS_TOOL))


@query("FIL4", RAW + "SELECT GlobalJobId, RecordTime, CMSPrimaryDataTier FROM raw WHERE CMSPrimaryDataTier <> 'Unknown'")
def records_with_known_tier(spark, sf_dir):
    return jobs(spark, sf_dir, S.TIER).where(clean.job_filter(known_tier=True))


@query("FIL5", RAW + "SELECT GlobalJobId, RecordTime, CRAB_DataBlock FROM raw WHERE CRAB_DataBlock IS NOT NULL")
def records_with_block(spark, sf_dir):
    return jobs(spark, sf_dir, S.BLOCK).where(clean.job_filter(with_block=True))


@query("FIL6", RAW_EVENTS + "SELECT GlobalJobId, RecordTime, Type FROM raw WHERE Type IN ('production', 'analysis')")
def records_of_known_types(spark, sf_dir):
    return events_as_jobs(spark, sf_dir, S.JOB_TYPE).where(clean.job_filter(types=[S.PRODUCTION, S.ANALYSIS]))


@query("FIL7", RAW + "SELECT DESIRED_CMSDataset, count(*) AS jobs FROM raw "
       "WHERE DESIRED_CMSDataset NOT LIKE '%HC%' GROUP BY 1")
def jobs_per_dataset_without_probes(spark, sf_dir):
    return clean.without_mark(jobs(spark, sf_dir, S.DATASET), S.DATASET).groupBy(S.DATASET).agg(count_jobs())


@query("FIL8", RAW + "SELECT GlobalJobId, RecordTime, Type, ExitCode FROM raw "
       "WHERE Type = 'analysis' AND ExitCode IS NOT NULL")
def analysis_records_with_exit_code(spark, sf_dir):
    return jobs(spark, sf_dir, S.JOB_TYPE, S.EXIT_CODE).where(
        clean.job_filter(types=[S.ANALYSIS], with_exit_code=True))


@query("FIL9", RAW + "SELECT WallClockHr, ExitCode FROM raw WHERE CMS_SubmissionTool = 'CRAB' AND ExitCode IS NOT NULL",
       "WallClockHr")
def tool_filtered_then_selected(spark, sf_dir):
    return jobs(spark, sf_dir, S.TOOL, S.WALL_HR, S.EXIT_CODE).where(
        clean.job_filter(tool=S.ANALYSIS_TOOL, with_exit_code=True)).select(S.WALL_HR, S.EXIT_CODE)


# --- de-duplication ------------------------------------------------------------

@query("DED1", final(["Status", "WallClockHr", "CMSSite"]) + " SELECT * FROM clean", "WallClockHr")
def jobs_deduplicated(spark, sf_dir):
    keep = [S.STATUS, S.WALL_HR, S.SITE]
    return clean.clean_jobs(jobs(spark, sf_dir, *keep), keep, statuses=S.FINAL_STATUSES)


@query("DED1 SNK3", f"WITH {JOBS_CTE}, " + clean_cte(
    ["WallClockHr"], "TRUE", "record_date, GlobalJobId", extra=f"{DAY} AS record_date") +
    " SELECT CAST(record_date AS STRING) AS record_date, count(*) AS jobs, sum(WallClockHr) AS wall_hr "
    "FROM clean GROUP BY 1", "wall_hr")
def jobs_deduplicated_within_days(spark, sf_dir):
    daily = clean.clean_jobs(jobs(spark, sf_dir, S.WALL_HR), [S.WALL_HR], per_day=True)
    return daily.groupBy(S.RECORD_DATE).agg(count_jobs(), F.sum(S.WALL_HR).alias("wall_hr"))


@query("DED1", "SELECT count(DISTINCT l_orderkey || '#' || l_linenumber) AS jobs FROM lineitem")
def number_of_jobs_any_record_kept(spark, sf_dir):
    return clean.any_per_key(jobs(spark, sf_dir, S.WALL_HR), [S.JOB_ID]).agg(count_jobs())


@query("DED4", RAW + "SELECT DISTINCT CMS_SubmissionTool FROM raw")
def distinct_tools(spark, sf_dir):
    return jobs(spark, sf_dir, S.TOOL).select(S.TOOL).distinct()


# --- scalar functions and labels -----------------------------------------------

@query("FN1 FN2 FN3 FN4 FN12 FN14", RAW_EVENTS + f"SELECT GlobalJobId, RecordTime, {HOUR} AS hour, "
       "strftime(make_timestamp(RecordTime * 1000), '%H') AS hour_text, "
       "strftime(make_timestamp(RecordTime * 1000), '%d') AS day_text, "
       f"CAST({DAY} AS STRING) AS record_date, strftime({DAY} - INTERVAL 3 DAY, '%Y/%m/%d') AS first_folder, "
       "strftime(make_timestamp(RecordTime * 1000), '%Y-%m-%d %H:%M:%S') AS time_text FROM raw")
def time_functions(spark, sf_dir):
    df = events_as_jobs(spark, sf_dir, S.JOB_ID)
    day = T.record_date(S.RECORD_TIME)
    return df.select(
        S.JOB_ID, S.RECORD_TIME, T.hour_of_day(S.RECORD_TIME).alias("hour"),
        F.date_format(T.record_ts(S.RECORD_TIME), "HH").alias("hour_text"),
        T.day_of_month(S.RECORD_TIME).alias("day_text"), day.alias("record_date"),
        T.day_folder(F.date_sub(day, 3)).alias("first_folder"), T.ms_text(S.RECORD_TIME).alias("time_text"))


@query("FN13", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def timestamps_as_epoch_ms(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", T.to_ms("ts").alias("ms"))


@query("FN11", "SELECT event_id, try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events", "k")
def text_to_number(spark, sf_dir):
    number = F.regexp_extract("props", "[0-9]+", 0).try_cast("double")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", number.alias("k"))


PATHS = ("SELECT p_partkey, '/' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '-' || p_brand END || '/' "
         "|| p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END || "
         "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '/RAW' END AS path FROM part")


def _short(cut):
    a, b, c = ("split_part(path, '/', %d)" % i for i in (2, 3, 4))
    both = (f"substr({a}, 1, 15)", f"substr({b}, 1, 15)") if cut else (a, b)
    return (f"SELECT p_partkey, path, CASE WHEN {c} = '' THEN NULL "
            f"WHEN length({a}) < 15 AND length({b}) < 15 THEN '/' || {a} || '/' || {b} || '/' || {c} "
            f"WHEN length({b}) > 15 AND length({a}) < 15 THEN '/' || {a} || '/' || substr({b}, 1, 15) || '.../' || {c} "
            f"WHEN length({a}) > 15 AND length({b}) < 15 THEN '/' || substr({a}, 1, 15) || '.../' || {b} || '/' || {c} "
            f"ELSE '/' || {both[0]} || '.../' || {both[1]} || '.../' || {c} END AS short_name FROM ({PATHS})")


def _paths(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(PATHS.replace("FROM part", "FROM {part}"), part=part)


@query("LBL3 FN9", _short(False))
def short_dataset_names(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("short_name", L.short_dataset_name("path"))


@query("LBL3 FN9", _short(True))
def short_dataset_names_cut(spark, sf_dir):
    return _paths(spark, sf_dir).withColumn("short_name", L.short_dataset_name("path", cut_last_branch=True))


@query("LBL1 LBL4 SHR1 FN10", "WITH g AS (SELECT CASE WHEN user_id % 9 <> 0 THEN event_type END AS kind, "
       "count(*) AS n FROM events GROUP BY 1), p AS (SELECT kind, 100.0 * n / sum(n) OVER () AS percent FROM g) "
       "SELECT kind, percent, coalesce(kind, 'Null') || ': ' || printf('%.3f', percent) || '%' AS text FROM p",
       "percent")
def percent_labels_with_null_key(spark, sf_dir):
    kind = F.expr("CASE WHEN user_id % 9 <> 0 THEN event_type END").alias("kind")
    grouped = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return shares.with_label(shares.with_percent(grouped, percent="n"), "kind").drop("n")


# --- calendars over the data ---------------------------------------------------

@query("SRC8", f"WITH {EVENTS_CTE}, m AS (SELECT DISTINCT date_trunc('month', {DAY}) AS m FROM raw), "
       "d AS (SELECT CAST(unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) "
       f"AS day FROM m), n AS (SELECT {DAY} AS day, count(*) AS jobs FROM raw GROUP BY 1) "
       "SELECT CAST(day AS STRING) AS record_date, epoch_ms(CAST(day AS TIMESTAMP)) AS start_ms, "
       "epoch_ms(CAST(day AS TIMESTAMP)) + 86400000 AS end_ms, coalesce(jobs, 0) AS jobs FROM d LEFT JOIN n USING (day)")
def jobs_by_calendar_day(spark, sf_dir):
    """Every day of every month the records touch, days without a job included."""
    per_day = events_as_jobs(spark, sf_dir, S.JOB_ID).groupBy(T.record_date(S.RECORD_TIME).alias(S.RECORD_DATE)).agg(count_jobs())
    return calendar_of(per_day).join(per_day, S.RECORD_DATE, "left").fillna(0, ["jobs"])


@query("SRC8 SRC9", f"WITH {EVENTS_CTE}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-07', "
       f"INTERVAL 1 DAY)) AS DATE) AS day), n AS (SELECT {DAY} AS day, count(*) AS jobs FROM raw GROUP BY 1) "
       "SELECT CAST(day AS STRING) AS record_date, jobs FROM d LEFT JOIN n USING (day)")
def jobs_of_one_week_by_day(spark, sf_dir):
    week = TimeWindow(datetime(2024, 1, 1), datetime(2024, 1, 8))
    per_day = (events_as_jobs(spark, sf_dir, S.JOB_ID).where(week.contains())
               .groupBy(T.record_date(S.RECORD_TIME).alias(S.RECORD_DATE)).agg(count_jobs()))
    return days_of(spark, week).join(per_day, S.RECORD_DATE, "left").select(S.RECORD_DATE, "jobs")
