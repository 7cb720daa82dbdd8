"""Archives, daily runs, mergeable parts and counted reads: what is stored answers like the records themselves."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from jobtally import schemas as S, sinks
from jobtally.functions import time as T
from jobtally.operators import catalogue, clean, state
from jobtally.plans import archive, daily, extracts, popularity, usage
from jobtally.session import shared_folder
from jobtally.sources import jobs as source
from jobtally.sources.windows import TimeWindow
from verification import bindings as B, popularity as P
from verification.registry import query
from verification.usage import HOURS, PERCENT_COLUMNS, PERCENTS, final, sums

SLASHES = "%Y/%m/%d"
EXTRACT = list(S.EXTRACT_COLUMNS)
MIDDLE = TimeWindow(datetime(2024, 1, 1), datetime(2024, 1, 16))
REST = TimeWindow(datetime(2024, 1, 16), datetime(2024, 4, 1))


def _archive(spark, sf_dir) -> str:
    """All event records in an archive, added in two batches that share no record but many jobs."""
    table = f"archive_{uuid.uuid4().hex}"
    records = B.events_as_jobs(spark, sf_dir, *EXTRACT)
    archive.create(records, table, shared_folder(spark, "archive"), buckets=8, window=MIDDLE)
    archive.append(records, table, window=REST)
    return table


@query("DED1 Q22: no shuffle by job id", final(EXTRACT, B.EVENTS_CTE) + " SELECT * FROM clean", "CpuTimeHr WallClockHr CoreHr")
def jobs_deduplicated_from_archive(spark, sf_dir):
    return clean.clean_jobs(archive.read(spark, _archive(spark, sf_dir)), EXTRACT, statuses=S.FINAL_STATUSES)


@query("Q1 DED1: from the archive", final(["CMSPrimaryDataTier", *HOURS], B.EVENTS_CTE) + ", " + sums("CMSPrimaryDataTier")
       + " " + PERCENTS, PERCENT_COLUMNS)
def hours_by_tier_from_archive(spark, sf_dir):
    return usage.tier_hours(archive.read(spark, _archive(spark, sf_dir)))


@query("DED1: looked up by job id", f"WITH {B.EVENTS_CTE}, " + B.clean_cte(["Status", "CMSSite"], B.FINAL) +
       ", wanted AS (SELECT DISTINCT GlobalJobId FROM raw WHERE Status NOT IN ('Completed', 'Held')) "
       "SELECT w.GlobalJobId, c.Status, c.CMSSite FROM wanted w LEFT JOIN clean c ON w.GlobalJobId = c.GlobalJobId")
def archived_jobs_looked_up(spark, sf_dir):
    """The last known state of every job that was not, or not only, seen completed or held."""
    wanted = (B.events_as_jobs(spark, sf_dir, S.STATUS).where(~F.col(S.STATUS).isin("Completed", "Held"))
              .select(S.JOB_ID).distinct())
    return archive.look_up(spark, _archive(spark, sf_dir), wanted, [S.STATUS, S.SITE])


# --- one wide extract for all analyses ------------------------------------------

def _wide(spark, sf_dir):
    path = shared_folder(spark, "wide")
    extracts.write_clean_extract(B.jobs(spark, sf_dir), path, once=True, columns=None, statuses=None)
    return source.read_extract(spark, path)


@query("Q13 Q22 SRC6: from a wide extract", f"WITH {B.JOBS_CTE}, {B.CATALOGUE_CTES}, {B.clean_cte(list(B.JOB_COLUMNS))}, usage AS ("
       "SELECT DESIRED_CMSDataset, count(DISTINCT CRAB_UserHN) AS distinct_CRAB_UserHN, count(DISTINCT Workflow) AS distinct_Workflow, "
       "sum(CAST(CpuTimeHr AS DECIMAL(28, 9))) AS sum_CpuTimeHr FROM clean GROUP BY 1) SELECT DESIRED_CMSDataset, distinct_CRAB_UserHN, "
       "distinct_Workflow, sum_file_size, sum_CpuTimeHr FROM usage LEFT JOIN file_size ON DESIRED_CMSDataset = dataset "
       "WHERE DESIRED_CMSDataset IS NOT NULL", "sum_CpuTimeHr")
def dataset_popularity_from_wide_extract(spark, sf_dir):
    return popularity.dataset_popularity(_wide(spark, sf_dir), P.sizes_by_file(spark, sf_dir), already_clean=True)


@query("Q19 Q22 SRC6: from a wide extract", P.access_ctes(cleaned=B.clean_cte(list(B.JOB_COLUMNS), name="once") +
                                                          f", clean AS (SELECT * FROM once WHERE {P.ACTIVE})") + "SELECT * FROM combined")
def dataset_block_table_from_extract(spark, sf_dir):
    return extracts.dataset_blocks(_wide(spark, sf_dir), P.sizes_by_dataset(spark, sf_dir), P.sizes_by_block(spark, sf_dir),
                                   already_clean=True)


# --- daily runs -------------------------------------------------------------------

def _arrivals(spark, sf_dir, records=None) -> str:
    """All event records in year, month and day folders of the day they arrive, up to two days late."""
    records = B.events_as_jobs(spark, sf_dir) if records is None else records
    arrival = F.date_add(T.record_date(S.RECORD_TIME), F.pmod(F.col(S.RECORD_TIME), F.lit(3)).cast("int"))
    base, flat = shared_folder(spark, "arrivals"), shared_folder(spark, "by_day")
    sinks.write_json_by(records.select(arrival.alias("day"), F.struct(*records.columns).alias("data")), flat, ["day"])
    _into_slashes(spark, flat, base)
    return base


def _into_slashes(spark, flat: str, base: str) -> None:
    """Move the folders ``day=2024-01-05`` of the writer to ``2024/01/05``, the layout of the records' source."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(flat).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.listStatus(hadoop.Path(flat)):
        name = found.getPath().getName()
        if name.startswith("day="):
            target = hadoop.Path(f"{base}/{name[4:].replace('-', '/')}")
            fs.mkdirs(target.getParent())
            fs.rename(found.getPath(), target)


def _window(first: int, last: datetime) -> TimeWindow:
    return TimeWindow(datetime(2024, 1, first), last)


def _two_runs(spark, sf_dir, *tables: daily.DailyTable) -> str:
    """Arrivals of the first twenty days, then those from the eighteenth day on."""
    base, home = _arrivals(spark, sf_dir), shared_folder(spark, "home")
    for window in (_window(1, datetime(2024, 1, 21)), _window(18, datetime(2024, 3, 1))):
        daily.run(spark, base, home, window, tables, day_folder=SLASHES)
    return home


@query("Q20 SNK3 SRC1 SRC2: incremental run", P.access_ctes("record_date, ", source=B.EVENTS_CTE) +
       "SELECT * REPLACE (CAST(record_date AS STRING) AS record_date) FROM combined")
def dataset_blocks_of_two_daily_runs(spark, sf_dir):
    """Two overlapping runs end where one over everything would."""
    table = daily.dataset_blocks(P.sizes_by_dataset(spark, sf_dir), P.sizes_by_block(spark, sf_dir))
    return daily.read(spark, _two_runs(spark, sf_dir, table), table)


CLEAN_DAYS = (f"WITH {B.EVENTS_CTE}, " + B.clean_cte(EXTRACT, B.FINAL, "record_date, GlobalJobId", extra=f"{B.DAY} AS record_date"))


@query("Q22 SNK3: incremental run", CLEAN_DAYS + " SELECT * REPLACE (CAST(record_date AS STRING) AS record_date) FROM clean",
       "CpuTimeHr WallClockHr CoreHr")
def clean_extract_of_two_daily_runs(spark, sf_dir):
    table = daily.clean_records()
    return daily.read(spark, _two_runs(spark, sf_dir, table), table)


PER_DAY = B.clean_cte(P.ACCESS, P.ACTIVE, "record_date, GlobalJobId", extra=f"{B.DAY} AS record_date")


@query("WIN1 Q18: kept up to date", P.access_ctes(source=B.EVENTS_CTE, cleaned=PER_DAY) + "SELECT * FROM sized_blocks")
def block_access_from_daily_parts(spark, sf_dir):
    """Every run adds its days' first and last accesses; merging them gives those of the whole time."""
    table = daily.access_state()
    parts = daily.read(spark, _two_runs(spark, sf_dir, table), table)
    return catalogue.sized_blocks(catalogue.active_blocks(state.merged_accesses(parts)), P.sizes_by_block(spark, sf_dir))


# --- sketches ---------------------------------------------------------------------

USED_DAYS = (f"WITH {B.JOBS_CTE}, " + B.clean_cte(P.USED, keys="record_date, GlobalJobId", extra=f"{B.DAY} AS record_date"))


@query("AGG8 Q13: daily sketches", USED_DAYS + " SELECT DESIRED_CMSDataset, CAST(year(record_date) AS INT) AS year, "
       "sum(CAST(CpuTimeHr AS DECIMAL(28, 9))) AS sum_CpuTimeHr, count(*) AS jobs, TRUE AS users_close, TRUE AS workflows_close "
       "FROM clean GROUP BY 1, 2", "sum_CpuTimeHr")
def usage_by_year_from_daily_sketches(spark, sf_dir):
    """Distinct users and workflows of years, out of days: within the bound the sketches state."""
    cleaned = clean.clean_jobs(B.jobs(spark, sf_dir, *P.USED), P.USED, per_day=True)
    year = F.year(S.RECORD_DATE).alias("year")
    close = state.merged_usage(state.usage_parts(cleaned), year)
    exact = cleaned.groupBy(year.alias("y"), F.col(S.DATASET).alias("name")).agg(
        F.count_distinct(S.USER_NAME).alias("users"), F.count_distinct(S.WORKFLOW).alias("workflows"))
    both = close.join(exact, (close["year"] == exact["y"]) & close[S.DATASET].eqNullSafe(exact["name"]))
    near = lambda got, true: F.abs(F.col(got) - F.col(true)) <= F.ceil(state.USERS_ERROR * F.col(true))
    return both.select(S.DATASET, "year", "sum_CpuTimeHr", "jobs", near("distinct_CRAB_UserHN", "users").alias("users_close"),
                       near("distinct_Workflow", "workflows").alias("workflows_close"))


PROFILED = ("WallClockHr", "CpuTimeHr")


@query("AGG15 Q23: daily sketches", f"WITH {B.JOBS_CTE}, " + B.clean_cte(list(PROFILED), keys="record_date, GlobalJobId",
                                                                        extra=f"{B.DAY} AS record_date") +
       ", long AS (UNPIVOT (SELECT WallClockHr, CpuTimeHr FROM clean) ON WallClockHr, CpuTimeHr INTO NAME measure VALUE v) "
       "SELECT measure, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS stddev, min(v) AS min, max(v) AS max, "
       "TRUE AS q25_close, TRUE AS q50_close, TRUE AS q75_close FROM long GROUP BY 1", "mean stddev min max")
def profile_from_daily_sketches(spark, sf_dir):
    """Quartiles out of daily sketches: their rank among all values is within the bound the sketches state.

    The quartiles are one row a measure, two in all, and go to every task; a join by measure would gather all values in two tasks.
    """
    cleaned = clean.clean_jobs(B.jobs(spark, sf_dir, *PROFILED), PROFILED, per_day=True)
    merged = state.merged_profile(state.profile_parts(cleaned, PROFILED, S.RECORD_DATE))
    values = cleaned.select(*PROFILED).unpivot([], list(PROFILED), "m", "v").where("v IS NOT NULL")
    ranks = values.join(F.broadcast(merged), F.col("measure") == F.col("m")).groupBy("measure").agg(
        *(F.avg((F.col("v") < F.col(q)).cast("int")).alias(f"{q}_below") for q in ("q25", "q50", "q75")),
        *(F.avg((F.col("v") <= F.col(q)).cast("int")).alias(f"{q}_to") for q in ("q25", "q50", "q75")))
    close = lambda q, at: (F.col(f"{q}_below") <= at + state.RANK_ERROR) & (F.col(f"{q}_to") >= at - state.RANK_ERROR)
    return merged.join(ranks, "measure").select(
        "measure", "count", "mean", "stddev", "min", "max",
        *(close(q, at).alias(f"{q}_close") for q, at in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))))


# --- counted reads ------------------------------------------------------------------

BAD = "event_id % 10 = 7"


@query("SRC4: malformed lines are counted", "WITH e AS (SELECT epoch_us(ts) // 1000 AS t, " + BAD + " AS bad FROM events) "
       "SELECT count(*) AS read, count(*) FILTER (NOT bad AND t >= epoch_ms(TIMESTAMP '2024-01-05') AND t < epoch_ms(TIMESTAMP '2024-01-20')) AS kept, "
       "count(*) FILTER (NOT bad AND NOT (t >= epoch_ms(TIMESTAMP '2024-01-05') AND t < epoch_ms(TIMESTAMP '2024-01-20'))) AS outside, "
       "count(*) FILTER (bad) AS malformed, count(*) FILTER (bad) AS quarantined, "
       "count(*) FILTER (NOT bad AND t >= epoch_ms(TIMESTAMP '2024-01-05') AND t < epoch_ms(TIMESTAMP '2024-01-20')) AS records FROM e")
def records_read_kept_outside_and_malformed(spark, sf_dir):
    """One line in ten is cut short: not one of them goes unnoticed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    data = F.to_json(F.struct(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias(S.RECORD_TIME),
                                       F.concat(F.lit("e"), "event_id").alias(S.JOB_ID)).alias("data")))
    line = F.when(F.expr(BAD), F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line"))
    base = shared_folder(spark, "lines")
    events.select("event_id", data.alias("line")).select(line.alias("value")).write.text(f"{base}/2024/01/15")
    reading = source.read_jobs_counted(spark, base, TimeWindow(datetime(2024, 1, 5), datetime(2024, 1, 20)), [], slack=40)
    records = reading.records.count()
    counts = reading.counts.get
    return reading.quarantine.agg(F.count(F.lit(1)).alias("quarantined")).select(
        *(F.lit(counts[c]).cast("long").alias(c) for c in ("read", "kept", "outside", "malformed")), "quarantined",
        F.lit(records).cast("long").alias("records"))
