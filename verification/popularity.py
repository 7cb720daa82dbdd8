"""Dataset usage by day and overall, and the size catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtally import schemas as S
from jobtally.functions import labels as L, time as T
from jobtally.operators import aggregates as A, catalogue, clean, hierarchy, topk
from jobtally.plans import extracts, popularity
from verification.bindings import (CATALOGUE_CTES, DAY, JOBS_CTE, blocks, clean_cte, datasets, files, jobs)
from verification.registry import query

# --- daily CPU hours -----------------------------------------------------------
CPU = ["DESIRED_CMSDataset", "CpuTimeHr"]
DAILY = (f"WITH {JOBS_CTE}, {clean_cte(CPU)}, daily AS (SELECT {DAY} AS record_date, DESIRED_CMSDataset, "
         "sum(CAST(CpuTimeHr AS DECIMAL(28, 9))) AS Sum_CpuTimeHr FROM clean GROUP BY 1, 2)")


def ranked(k):
    return (f"top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY record_date ORDER BY "
            f"Sum_CpuTimeHr DESC NULLS LAST, DESIRED_CMSDataset ASC NULLS FIRST) AS INT) AS rank FROM daily) "
            f"WHERE rank <= {k})")


def daily_jobs(spark, sf_dir):
    return jobs(spark, sf_dir, *CPU)


@query("Q10 AGG3 FN3", DAILY + " SELECT CAST(record_date AS STRING) AS record_date, DESIRED_CMSDataset, "
       "Sum_CpuTimeHr FROM daily", "Sum_CpuTimeHr")
def dataset_cpu_by_day(spark, sf_dir):
    return popularity.daily_cpu(daily_jobs(spark, sf_dir))


@query("Q10 AGG13", DAILY + " SELECT CAST(record_date AS STRING) AS record_date, sum(Sum_CpuTimeHr) AS day_cpu_hr "
       "FROM daily GROUP BY 1", "day_cpu_hr")
def cpu_by_day(spark, sf_dir):
    return A.day_totals(popularity.daily_cpu(daily_jobs(spark, sf_dir))).orderBy(S.RECORD_DATE)


@query("Q10 AGG12", DAILY + " SELECT sum(Sum_CpuTimeHr) AS period_cpu_hr FROM daily", "period_cpu_hr")
def cpu_of_period(spark, sf_dir):
    return A.period_total(popularity.daily_cpu(daily_jobs(spark, sf_dir)))


@query("FIL10 FN3", DAILY + " SELECT strftime(record_date, '%d') AS day_of_month, DESIRED_CMSDataset, "
       "sum(Sum_CpuTimeHr) AS Sum_CpuTimeHr FROM daily WHERE strftime(record_date, '%d') = '30' GROUP BY 1, 2",
       "Sum_CpuTimeHr")
def dataset_cpu_on_day_thirty(spark, sf_dir):
    """Keyed by day of month, which puts the thirtieth of every month together."""
    cleaned = clean.clean_jobs(daily_jobs(spark, sf_dir), CPU)
    keyed = cleaned.withColumn("day_of_month", T.day_of_month(S.RECORD_TIME))
    return keyed.where(F.col("day_of_month") == "30").groupBy("day_of_month", S.DATASET).agg(
        F.sum(S.CPU_HR).alias("Sum_CpuTimeHr"))


@query("Q11 TOP1 SET1", DAILY + ", " + ranked(5) +
       " SELECT CAST(record_date AS STRING) AS record_date, DESIRED_CMSDataset, Sum_CpuTimeHr, rank FROM top",
       "Sum_CpuTimeHr")
def top5_datasets_by_day(spark, sf_dir):
    return popularity.daily_top(daily_jobs(spark, sf_dir))


@query("asked-for: top 10 variant; TOP1", DAILY + ", " + ranked(10) +
       " SELECT CAST(record_date AS STRING) AS record_date, DESIRED_CMSDataset, Sum_CpuTimeHr, rank FROM top",
       "Sum_CpuTimeHr")
def top10_datasets_by_day(spark, sf_dir):
    return popularity.daily_top(daily_jobs(spark, sf_dir), 10)


@query("SET1", DAILY + " SELECT CAST(record_date AS STRING) AS record_date, sum(Sum_CpuTimeHr) AS cpu_hr, "
       "'day' AS kind FROM daily GROUP BY 1 UNION ALL SELECT NULL, sum(Sum_CpuTimeHr), 'period' FROM daily", "cpu_hr")
def day_and_period_totals_stacked(spark, sf_dir):
    daily = popularity.daily_cpu(daily_jobs(spark, sf_dir))
    return topk.stack(
        A.day_totals(daily).select(S.RECORD_DATE, F.col("day_cpu_hr").alias("cpu_hr"), F.lit("day").alias("kind")),
        A.period_total(daily).select(F.lit(None).cast("date"), "period_cpu_hr", F.lit("period")))


NODES = (DAILY + ", " + ranked(5) + ", nodes AS ("
         "SELECT 0 AS level, NULL AS record_date, CAST(NULL AS INT) AS rank, 'all days' AS label, '' AS parent, "
         "sum(Sum_CpuTimeHr) AS value, 'all days' AS name FROM daily UNION ALL "
         "SELECT 1, record_date, NULL, strftime(record_date, '%Y-%m-%d'), 'all days', sum(Sum_CpuTimeHr), "
         "strftime(record_date, '%Y-%m-%d') FROM daily GROUP BY record_date UNION ALL "
         "SELECT 2, record_date, rank, strftime(record_date, '%Y-%m-%d') || ' - Top' || rank, "
         "strftime(record_date, '%Y-%m-%d'), Sum_CpuTimeHr, DESIRED_CMSDataset FROM top)")


def nodes(spark, sf_dir):
    return popularity.usage_hierarchy(daily_jobs(spark, sf_dir), "all days", day_label="yyyy-MM-dd",
                                      day_short="yyyy-MM-dd")


@query("Q12 HIER1 LBL4 LBL5 LBL6", NODES + " SELECT level, CAST(record_date AS STRING) AS record_date, rank, label, "
       "parent, value, coalesce(name, 'Null') || ' - CPU Time: ' || printf('%.3f', CAST(value AS DOUBLE)) AS hover "
       "FROM nodes", "value")
def usage_hierarchy(spark, sf_dir):
    return nodes(spark, sf_dir)


@query("HIER2", NODES + ", t AS (SELECT sum(value) FILTER (level = 0) AS period, sum(value) FILTER (level = 1) AS days, "
       "sum(value) FILTER (level = 2) AS top FROM nodes) SELECT *, days + top AS nodes_minus_root, "
       "days + top - period AS top_part, abs(days - period) < 1e-3 AS balanced, 100 * top / period AS top_pct FROM t",
       "period days top nodes_minus_root top_part top_pct")
def usage_hierarchy_balance(spark, sf_dir):
    balance = hierarchy.hierarchy_balance(nodes(spark, sf_dir))
    return balance.withColumn("balanced", F.abs("days_minus_period") < 1e-3).drop("days_minus_period")


@query("asked-for: CPU share of the top datasets; AGG12 TOP1 SHR1", DAILY +
       ", d AS (SELECT DESIRED_CMSDataset, sum(Sum_CpuTimeHr) AS cpu FROM daily GROUP BY 1), t AS (SELECT cpu FROM d "
       "ORDER BY cpu DESC NULLS LAST, DESIRED_CMSDataset ASC NULLS FIRST LIMIT 10) "
       "SELECT (SELECT sum(cpu) FROM t) AS top_cpu_hr, (SELECT sum(cpu) FROM d) AS all_cpu_hr, "
       "100 * (SELECT sum(cpu) FROM t) / (SELECT sum(cpu) FROM d) AS top_pct", "top_cpu_hr all_cpu_hr top_pct")
def cpu_share_of_top10_datasets(spark, sf_dir):
    return catalogue.top_share(popularity.daily_cpu(daily_jobs(spark, sf_dir)), 10)


# --- popularity ----------------------------------------------------------------
USED = [*CPU, "CRAB_UserHN", "Workflow"]
USAGE = (f"WITH {JOBS_CTE}, {CATALOGUE_CTES}, {clean_cte(USED)}, usage AS (SELECT DESIRED_CMSDataset, "
         "count(DISTINCT CRAB_UserHN) AS distinct_CRAB_UserHN, count(DISTINCT Workflow) AS distinct_Workflow, "
         "sum(CAST(CpuTimeHr AS DECIMAL(28, 9))) AS sum_CpuTimeHr FROM clean GROUP BY 1), popular AS (SELECT DESIRED_CMSDataset, "
         "distinct_CRAB_UserHN, distinct_Workflow, sum_file_size, sum_CpuTimeHr FROM usage LEFT JOIN file_size "
         "ON DESIRED_CMSDataset = dataset WHERE DESIRED_CMSDataset IS NOT NULL)")


def popular(spark, sf_dir):
    sizes = catalogue.file_sizes(files(spark, sf_dir), datasets(spark, sf_dir))
    return popularity.dataset_popularity(jobs(spark, sf_dir, *USED), sizes)


@query("AGG8", USAGE + " SELECT DESIRED_CMSDataset, sum_CpuTimeHr, distinct_CRAB_UserHN, distinct_Workflow FROM usage",
       "sum_CpuTimeHr")
def distinct_users_and_workflows(spark, sf_dir):
    return A.dataset_usage(clean.clean_jobs(jobs(spark, sf_dir, *USED), USED))


@query("asked-for: users and workflows per dataset in the weekly view; AGG8",
       f"WITH {JOBS_CTE}, {clean_cte(USED)} SELECT CAST(CAST(date_trunc('week', {DAY}) AS DATE) AS STRING) AS week, "
       "DESIRED_CMSDataset, sum(CpuTimeHr) AS sum_CpuTimeHr, count(DISTINCT CRAB_UserHN) AS distinct_CRAB_UserHN, "
       "count(DISTINCT Workflow) AS distinct_Workflow FROM clean GROUP BY 1, 2", "sum_CpuTimeHr")
def distinct_users_and_workflows_by_week(spark, sf_dir):
    cleaned = clean.clean_jobs(jobs(spark, sf_dir, *USED), USED)
    return A.dataset_usage(cleaned.withColumn("week", F.trunc(T.record_date(S.RECORD_TIME), "week")), "week")


@query("AGG8 (approximate option)", USAGE + " SELECT DESIRED_CMSDataset, sum_CpuTimeHr, TRUE AS users_close, "
       "TRUE AS workflows_close FROM usage", "sum_CpuTimeHr")
def approximate_users_and_workflows(spark, sf_dir):
    """The sketches must stay within a quarter of the exact numbers, five times their expected error."""
    cleaned = clean.clean_jobs(jobs(spark, sf_dir, *USED), USED)
    exact = A.dataset_usage(cleaned).select(
        F.col(S.DATASET).alias("name"), F.col("distinct_CRAB_UserHN").alias("users"),
        F.col("distinct_Workflow").alias("workflows"))
    close = A.dataset_usage(cleaned, approximate=True)
    return close.join(exact, close[S.DATASET].eqNullSafe(exact["name"])).select(
        S.DATASET, "sum_CpuTimeHr",
        (F.abs(F.col("distinct_CRAB_UserHN") - F.col("users")) <= 0.25 * F.col("users")).alias("users_close"),
        (F.abs(F.col("distinct_Workflow") - F.col("workflows")) <= 0.25 * F.col("workflows")).alias("workflows_close"))


@query("Q13 AGG8 AGG14 JN3 SRT2", USAGE + " SELECT * FROM popular", "sum_CpuTimeHr")
def dataset_popularity(spark, sf_dir):
    return popularity.most_used_first(popular(spark, sf_dir))


def top_lists(k, where="TRUE"):
    return (USAGE + ", long AS (UNPIVOT (SELECT DESIRED_CMSDataset, CAST(distinct_CRAB_UserHN AS DECIMAL(38, 9)) AS "
            "distinct_CRAB_UserHN, CAST(distinct_Workflow AS DECIMAL(38, 9)) AS distinct_Workflow, CAST(sum_file_size AS DECIMAL(38, 9)) "
            f"AS sum_file_size, sum_CpuTimeHr FROM popular WHERE {where}) ON distinct_CRAB_UserHN, distinct_Workflow, "
            "sum_file_size, sum_CpuTimeHr INTO NAME metric VALUE value) "
            "SELECT metric, CAST(r AS INT) AS rank, DESIRED_CMSDataset, value, DESIRED_CMSDataset AS short_name FROM ("
            "SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, DESIRED_CMSDataset) AS r "
            f"FROM long) WHERE r <= {k}")


@query("Q14 TOP2 LBL3 SRT2", top_lists(20), "value")
def top20_datasets_by_metric(spark, sf_dir):
    return popularity.top_lists(popular(spark, sf_dir))


@query("Q14 TOP2 FIL7 LBL3", top_lists(20, "DESIRED_CMSDataset NOT LIKE '%HC%'"), "value")
def top20_datasets_by_metric_without_probes(spark, sf_dir):
    return popularity.top_lists(popular(spark, sf_dir), with_probes=False)


@query("TOP2", USAGE + " SELECT * FROM popular ORDER BY sum_CpuTimeHr DESC NULLS LAST, DESIRED_CMSDataset LIMIT 20",
       "sum_CpuTimeHr")
def top20_datasets_by_cpu(spark, sf_dir):
    return topk.top_rows(popular(spark, sf_dir), "sum_CpuTimeHr", 20, [S.DATASET])


@query("TOP3", USAGE + " SELECT * FROM popular ORDER BY distinct_Workflow DESC NULLS LAST, DESIRED_CMSDataset LIMIT 40",
       "sum_CpuTimeHr")
def popularity_preview(spark, sf_dir):
    return popularity.most_used_first(popular(spark, sf_dir)).limit(40)


# --- sizes ---------------------------------------------------------------------
SIZES = f"WITH {CATALOGUE_CTES} "


def sizes_by_dataset(spark, sf_dir):
    return catalogue.dataset_sizes(datasets(spark, sf_dir), files(spark, sf_dir))


def sizes_by_file(spark, sf_dir):
    return catalogue.file_sizes(files(spark, sf_dir), datasets(spark, sf_dir))


def sizes_by_block(spark, sf_dir):
    return catalogue.block_sizes(blocks(spark, sf_dir))


@query("Q15 JN1 AGG14 PRJ4", SIZES + "SELECT * FROM dataset_size")
def dataset_sizes(spark, sf_dir):
    return sizes_by_dataset(spark, sf_dir)


@query("Q15 JN2 AGG14 SRT2", SIZES + "SELECT * FROM file_size")
def dataset_sizes_from_files(spark, sf_dir):
    return topk.largest_first(sizes_by_file(spark, sf_dir), "sum_file_size", ["dataset"])


@query("Q16 PRJ4", SIZES + "SELECT * FROM block_size")
def block_sizes(spark, sf_dir):
    return sizes_by_block(spark, sf_dir)


# --- active datasets and blocks ------------------------------------------------
ACCESS = ["CMSPrimaryDataTier", "DESIRED_CMSDataset", "CRAB_DataBlock", "CRAB_Workflow"]
ACTIVE = "CMS_SubmissionTool = 'CRAB' AND CMSPrimaryDataTier <> 'Unknown' AND CRAB_DataBlock IS NOT NULL"
EARLIEST = ("First_Access, Last_Access, CMSPrimaryDataTier, DESIRED_CMSDataset NULLS FIRST, CRAB_DataBlock, "
            "CRAB_Workflow NULLS FIRST")


def access_ctes(key="", where=ACTIVE, source=JOBS_CTE, cleaned=None):
    """Accesses, active datasets and blocks; ``key`` is "" or "record_date, "; ``cleaned`` may define the table clean."""
    cleaned = cleaned or (clean_cte(ACCESS, where, "record_date, GlobalJobId", extra=f"{DAY} AS record_date") if key
               else clean_cte(ACCESS, where))
    return (f"WITH {source}, {CATALOGUE_CTES}, {cleaned}, access AS (SELECT {key}{', '.join(ACCESS)}, "
            "min(RecordTime) AS First_Access, max(RecordTime) AS Last_Access FROM clean GROUP BY ALL), "
            f"active_datasets AS (SELECT {key}CMSPrimaryDataTier, DESIRED_CMSDataset FROM access QUALIFY row_number() "
            f"OVER (PARTITION BY {key}DESIRED_CMSDataset ORDER BY {EARLIEST}) = 1), "
            f"active_blocks AS (SELECT {key}DESIRED_CMSDataset, CRAB_DataBlock, CRAB_Workflow, "
            f"min(First_Access) OVER b AS First_Access, max(Last_Access) OVER b AS Last_Access FROM access "
            f"WINDOW b AS (PARTITION BY {key}CRAB_DataBlock) QUALIFY row_number() OVER "
            f"(PARTITION BY {key}CRAB_DataBlock ORDER BY {EARLIEST.replace('First_Access, Last_Access', 'access.First_Access, access.Last_Access')}) = 1), "
            f"sized_datasets AS (SELECT {key}CMSPrimaryDataTier, DESIRED_CMSDataset, Dataset_Size FROM active_datasets "
            "JOIN dataset_size ON DESIRED_CMSDataset = d_dataset), "
            f"sized_blocks AS (SELECT {key}DESIRED_CMSDataset, CRAB_DataBlock, Block_Size, CRAB_Workflow, First_Access, "
            "Last_Access FROM active_blocks JOIN block_size ON CRAB_DataBlock = b_block_name), "
            f"combined AS (SELECT {key}CMSPrimaryDataTier, DESIRED_CMSDataset, Dataset_Size, CRAB_DataBlock, Block_Size, "
            f"CRAB_Workflow, First_Access, Last_Access FROM sized_datasets JOIN sized_blocks "
            f"USING ({key}DESIRED_CMSDataset)) ")


def access_jobs(spark, sf_dir):
    return jobs(spark, sf_dir, S.TOOL, *ACCESS)


def access(spark, sf_dir):
    return catalogue.accesses(clean.clean_jobs(access_jobs(spark, sf_dir), ACCESS, tool=S.ANALYSIS_TOOL,
                                               known_tier=True, with_block=True))


@query("DED2", access_ctes() + "SELECT * FROM active_datasets")
def active_datasets(spark, sf_dir):
    return catalogue.active_datasets(access(spark, sf_dir))


@query("WIN1 DED3", access_ctes() + "SELECT * FROM active_blocks")
def active_blocks(spark, sf_dir):
    return catalogue.active_blocks(access(spark, sf_dir))


@query("WIN2", f"WITH {JOBS_CTE}, {clean_cte(['CRAB_DataBlock'])} "
       "SELECT *, min(RecordTime) OVER (PARTITION BY CRAB_DataBlock) AS First_Access, "
       "max(RecordTime) OVER (PARTITION BY CRAB_DataBlock) AS Last_Access FROM clean")
def jobs_with_block_access(spark, sf_dir):
    return catalogue.with_block_access(clean.clean_jobs(jobs(spark, sf_dir, S.BLOCK), [S.BLOCK]))


@query("Q17 DED2 JN5", access_ctes() + "SELECT * FROM sized_datasets")
def active_datasets_with_size(spark, sf_dir):
    return catalogue.sized_datasets(catalogue.active_datasets(access(spark, sf_dir)), sizes_by_dataset(spark, sf_dir))


@query("Q18 WIN1 DED3 JN6", access_ctes() + "SELECT * FROM sized_blocks")
def active_blocks_with_size(spark, sf_dir):
    return catalogue.sized_blocks(catalogue.active_blocks(access(spark, sf_dir)), sizes_by_block(spark, sf_dir))


@query("Q19 JN7 PRJ6 SRT2", access_ctes() + "SELECT * FROM combined")
def dataset_block_table(spark, sf_dir):
    return extracts.largest_dataset_blocks(access_jobs(spark, sf_dir), sizes_by_dataset(spark, sf_dir),
                                           sizes_by_block(spark, sf_dir))


@query("Q20 SNK3 (rows before writing)", access_ctes("record_date, ") +
       "SELECT * REPLACE (CAST(record_date AS STRING) AS record_date) FROM combined")
def dataset_block_table_by_day(spark, sf_dir):
    return extracts.dataset_blocks(access_jobs(spark, sf_dir), sizes_by_dataset(spark, sf_dir),
                                   sizes_by_block(spark, sf_dir), per_day=True)


@query("asked-for: retention candidates", access_ctes() +
       "SELECT * FROM combined WHERE Last_Access < epoch_ms(TIMESTAMP '2001-06-01')")
def blocks_not_used_lately(spark, sf_dir):
    table = extracts.dataset_blocks(access_jobs(spark, sf_dir), sizes_by_dataset(spark, sf_dir),
                                    sizes_by_block(spark, sf_dir))
    return catalogue.last_accessed_before(table, 991353600000)


TOOL_JOBS = (f"WITH {JOBS_CTE}, {CATALOGUE_CTES}, "
             f"{clean_cte(['DESIRED_CMSDataset'], chr(39).join(['CMS_SubmissionTool = ', 'CRAB', '']))}")


def tool_jobs(spark, sf_dir):
    return clean.clean_jobs(jobs(spark, sf_dir, S.TOOL, S.DATASET), [S.DATASET], tool=S.ANALYSIS_TOOL)


@query("JN4 FIL5 SRT2", TOOL_JOBS + " SELECT DESIRED_CMSDataset, sum_file_size FROM clean LEFT JOIN file_size "
       "ON DESIRED_CMSDataset = dataset WHERE DESIRED_CMSDataset IS NOT NULL")
def dataset_size_of_every_job(spark, sf_dir):
    sized = catalogue.job_dataset_sizes(tool_jobs(spark, sf_dir), sizes_by_file(spark, sf_dir))
    return topk.largest_first(sized, "sum_file_size", [S.DATASET, S.JOB_ID]).select(S.DATASET, "sum_file_size")


@query("JN4 (one row per dataset)", TOOL_JOBS + " SELECT DESIRED_CMSDataset, count(*) AS jobs, "
       "any_value(sum_file_size) AS sum_file_size FROM clean LEFT JOIN file_size ON DESIRED_CMSDataset = dataset "
       "WHERE DESIRED_CMSDataset IS NOT NULL GROUP BY 1")
def dataset_size_of_used_datasets(spark, sf_dir):
    return catalogue.distinct_dataset_sizes(tool_jobs(spark, sf_dir), sizes_by_file(spark, sf_dir))


MONTHS = (f"WITH {JOBS_CTE}, {CATALOGUE_CTES}, " +
          clean_cte(["DESIRED_CMSDataset"], "CMS_SubmissionTool = 'CRAB'", "period, GlobalJobId",
                    extra=f"CAST(date_trunc('month', {DAY}) AS DATE) AS period"))


@query("Q21 JN4 SNK4 (rows before writing)", MONTHS + " SELECT CAST(period AS STRING) AS period, DESIRED_CMSDataset, "
       "sum_file_size FROM clean LEFT JOIN file_size ON DESIRED_CMSDataset = dataset "
       "WHERE DESIRED_CMSDataset IS NOT NULL")
def dataset_sizes_by_month(spark, sf_dir):
    return extracts.period_dataset_sizes(jobs(spark, sf_dir, S.TOOL, S.DATASET), sizes_by_file(spark, sf_dir))


@query("Q21 JN4 (one row per dataset)", MONTHS + " SELECT CAST(period AS STRING) AS period, DESIRED_CMSDataset, "
       "count(*) AS jobs, any_value(sum_file_size) AS sum_file_size FROM clean LEFT JOIN file_size "
       "ON DESIRED_CMSDataset = dataset WHERE DESIRED_CMSDataset IS NOT NULL GROUP BY 1, 2")
def used_dataset_sizes_by_month(spark, sf_dir):
    return extracts.period_dataset_sizes(jobs(spark, sf_dir, S.TOOL, S.DATASET), sizes_by_file(spark, sf_dir),
                                         distinct_datasets=True)


# --- profiles ------------------------------------------------------------------
PROFILED = (("d", "Dataset_Size", "Dataset_Size"), ("b", "Block_Size", "Block_Size"),
            ("u", "days_used", "(Last_Access - First_Access) / 86400000"))


@query("Q23 AGG15", access_ctes() + ", " + ", ".join(
    f"{c} AS (SELECT CAST({e} AS DOUBLE) AS v FROM combined), p{c} AS (SELECT "
    "unnest(['count', 'mean', 'stddev', 'min', '25%', '50%', '75%', 'max']) AS summary, "
    "unnest([count(v), avg(v), stddev_samp(v), min(v), quantile_disc(v, 0.25), quantile_disc(v, 0.5), "
    f"quantile_disc(v, 0.75), max(v)]) AS {n} FROM {c})" for c, n, e in PROFILED) +
    " SELECT * FROM pd JOIN pb USING (summary) JOIN pu USING (summary)", "Dataset_Size Block_Size days_used")
def dataset_block_profile(spark, sf_dir):
    table = extracts.dataset_blocks(access_jobs(spark, sf_dir), sizes_by_dataset(spark, sf_dir),
                                    sizes_by_block(spark, sf_dir))
    used = (F.col(S.LAST_ACCESS) - F.col(S.FIRST_ACCESS)) / 86_400_000
    profile = A.profile(table.select(S.DATASET_SIZE, S.BLOCK_SIZE, used.alias("days_used")))
    return profile.select("summary", *(F.col(c).cast("double").alias(c) for c in profile.columns[1:]))


@query("AGG15 DED2", access_ctes() + "SELECT unnest(['count', 'min', 'max']) AS summary, "
       "unnest([CAST(count(CMSPrimaryDataTier) AS STRING), min(CMSPrimaryDataTier), max(CMSPrimaryDataTier)]) "
       "AS CMSPrimaryDataTier, unnest([CAST(count(DESIRED_CMSDataset) AS STRING), min(DESIRED_CMSDataset), "
       "max(DESIRED_CMSDataset)]) AS DESIRED_CMSDataset FROM active_datasets")
def active_dataset_profile(spark, sf_dir):
    return A.profile(catalogue.active_datasets(access(spark, sf_dir)), "count", "min", "max")
