"""Sources and sinks: what the tables hold is written, read back and analysed.

Folders are new for every run and lie below the cluster's shared folder.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from jobtally import schemas as S, sinks
from jobtally.functions import time as T
from jobtally.operators import catalogue, clean
from jobtally.plans import extracts, usage
from jobtally.session import shared_folder
from jobtally.sources import catalogue as dumps, jobs as source
from jobtally.sources.windows import TimeWindow
from verification import bindings as B, popularity as P
from verification.registry import query
from verification.usage import (EFFICIENCY, EFFICIENCY_RATIOS, EFFICIENCY_SUMS, HOUR, HOURS, PERCENT_COLUMNS, PERCENTS,
                                final, sums)

EXTRACT = list(S.EXTRACT_COLUMNS)
WINDOW = TimeWindow(datetime(2024, 1, 5), datetime(2024, 1, 20))
IN_WINDOW = ("RecordTime >= epoch_ms(TIMESTAMP '2024-01-05') AND RecordTime < epoch_ms(TIMESTAMP '2024-01-20') AND "
             + B.FINAL)
DAY_FOLDER = "day=%Y-%m-%d"


def _json_folders(spark, sf_dir) -> str:
    """All event records as nested JSON, each in the folder of a day up to two days late."""
    records = B.events_as_jobs(spark, sf_dir)
    arrival = F.date_add(T.record_date(S.RECORD_TIME), F.pmod(F.col(S.RECORD_TIME), F.lit(3)).cast("int"))
    base = shared_folder(spark, "records")
    sinks.write_json_by(records.select(arrival.alias("day"), F.struct(*records.columns).alias("data")), base, ["day"])
    return base


@query("SRC1 SRC2 SRC4 SRC9 PRJ1 FIL1 FIL2 DED1", final(EFFICIENCY, B.EVENTS_CTE, IN_WINDOW) +
       " SELECT * FROM clean", "CpuTimeHr WallClockHr CoreHr")
def jobs_from_json_day_folders(spark, sf_dir):
    """The shared front of every analysis: folders with slack, exact window, one record per job."""
    columns = [S.STATUS, *EFFICIENCY]
    records = source.read_jobs(spark, _json_folders(spark, sf_dir), WINDOW, columns, day_folder=DAY_FOLDER)
    return clean.clean_jobs(records, EFFICIENCY, statuses=S.FINAL_STATUSES)


@query("SRC4 Q4", final(EFFICIENCY, B.EVENTS_CTE) +
       f" SELECT lpad(CAST({HOUR} AS STRING), 2, '0') AS hour, InputData, {EFFICIENCY_SUMS}, {EFFICIENCY_RATIOS} "
       "FROM clean GROUP BY 1, 2", "sum_cpu_hr sum_wall_by_cpus sum_core_hr cpu_eff_wall cpu_eff_core")
def efficiency_by_hour_from_json(spark, sf_dir):
    """All days of the records, whatever they are."""
    first, last = B.events_as_jobs(spark, sf_dir).agg(*(f(T.record_date(S.RECORD_TIME)) for f in (F.min, F.max))).first()
    at = lambda day: datetime(day.year, day.month, day.day)
    whole = TimeWindow(at(first), at(last) + timedelta(days=1))
    records = source.read_jobs(spark, _json_folders(spark, sf_dir), whole, [S.STATUS, *EFFICIENCY], day_folder=DAY_FOLDER)
    return usage.hourly_efficiency(records)


@query("SRC3", final(["Status"], B.EVENTS_CTE, IN_WINDOW) + " SELECT * FROM clean")
def jobs_from_json_with_tmp_folders(spark, sf_dir):
    """Records that came late are in the ``.tmp`` folder of their day."""
    records = B.events_as_jobs(spark, sf_dir, S.STATUS)
    late = F.when(F.pmod(F.col(S.RECORD_TIME), F.lit(2)) == 1, ".tmp").otherwise("")
    day = F.concat(T.record_date(S.RECORD_TIME).cast("string"), late)
    base = shared_folder(spark, "records")
    sinks.write_json_by(records.select(day.alias("day"), F.struct(*records.columns).alias("data")), base, ["day"])
    read = source.read_jobs(spark, base, WINDOW, [S.STATUS], include_tmp=True, day_folder=DAY_FOLDER)
    return clean.clean_jobs(read, [S.STATUS], statuses=S.FINAL_STATUSES)


def _csv_catalogue(spark, sf_dir):
    base = shared_folder(spark, "catalogue")
    for name, df in (("files", B.files(spark, sf_dir)), ("datasets", B.datasets(spark, sf_dir)),
                     ("blocks", B.blocks(spark, sf_dir))):
        sinks.write_csv(df, f"{base}/{name}")
    return (dumps.read_files(spark, f"{base}/files"), dumps.read_datasets(spark, f"{base}/datasets"),
            dumps.read_blocks(spark, f"{base}/blocks"))


@query("SRC5 Q15 JN1 AGG14", P.SIZES + "SELECT * FROM dataset_size")
def dataset_sizes_from_csv(spark, sf_dir):
    files, datasets, _ = _csv_catalogue(spark, sf_dir)
    return catalogue.dataset_sizes(datasets, files)


@query("SRC5 Q15 JN2 AGG14", P.SIZES + "SELECT * FROM file_size")
def dataset_sizes_of_files_from_csv(spark, sf_dir):
    files, datasets, _ = _csv_catalogue(spark, sf_dir)
    return catalogue.file_sizes(files, datasets)


@query("SRC5 Q16 PRJ4", P.SIZES + "SELECT * FROM block_size")
def block_sizes_from_csv(spark, sf_dir):
    return catalogue.block_sizes(_csv_catalogue(spark, sf_dir)[2])


@query("SNK1 SRC6", P.SIZES + "SELECT * FROM dataset_size")
def dataset_sizes_written_and_read(spark, sf_dir):
    path = shared_folder(spark, "sizes")
    extracts.write_dataset_sizes(P.sizes_by_dataset(spark, sf_dir), path)
    return source.read_extract(spark, path)


DAILY = (f"WITH {B.EVENTS_CTE}, " + B.clean_cte(EXTRACT, B.FINAL, "record_date, GlobalJobId",
                                            extra=f"{B.DAY} AS record_date"))


@query("Q22 SNK2 SNK3 SRC6 DED1", DAILY + " SELECT * REPLACE (CAST(record_date AS STRING) AS record_date) FROM clean",
       "CpuTimeHr WallClockHr CoreHr")
def daily_clean_extract(spark, sf_dir):
    """Every day's clean records in one gzip Parquet job, read back."""
    path = shared_folder(spark, "extract")
    extracts.write_clean_extract(B.events_as_jobs(spark, sf_dir, *EXTRACT), path)
    return source.read_extract(spark, path)


@query("Q22 Q1 SRC6", final(["CMSPrimaryDataTier", *HOURS], B.EVENTS_CTE) + ", " + sums("CMSPrimaryDataTier")
       + " " + PERCENTS, PERCENT_COLUMNS)
def hours_by_tier_from_clean_extract(spark, sf_dir):
    """An extract that holds each job once answers without another de-duplication."""
    path = shared_folder(spark, "extract")
    extracts.write_clean_extract(B.events_as_jobs(spark, sf_dir, *EXTRACT), path, once=True)
    return usage.tier_hours(source.read_extract(spark, path), already_clean=True)


@query("SRC6 SRC9", DAILY + " SELECT CAST(record_date AS STRING) AS record_date, count(*) AS jobs FROM clean WHERE "
       "RecordTime >= epoch_ms(TIMESTAMP '2024-01-05') AND RecordTime < epoch_ms(TIMESTAMP '2024-01-20') GROUP BY 1")
def daily_clean_extract_of_a_window(spark, sf_dir):
    """The same, part of it read: the window prunes the day partitions."""
    path = shared_folder(spark, "extract")
    extracts.write_clean_extract(B.events_as_jobs(spark, sf_dir, *EXTRACT), path)
    return source.read_extract(spark, path, WINDOW).groupBy(S.RECORD_DATE).agg(F.count(F.lit(1)).alias("jobs"))


@query("Q20 SNK3 SRC6", P.access_ctes("record_date, ", source=B.EVENTS_CTE) +
       "SELECT * REPLACE (CAST(record_date AS STRING) AS record_date) FROM combined")
def daily_dataset_block_extract(spark, sf_dir):
    path = shared_folder(spark, "blocks")
    extracts.write_daily_dataset_blocks(B.events_as_jobs(spark, sf_dir, S.TOOL, *P.ACCESS), P.sizes_by_dataset(spark, sf_dir),
                                        P.sizes_by_block(spark, sf_dir), path)
    return source.read_extract(spark, path)


@query("Q21 SNK4 SRC6", P.MONTHS + " SELECT CAST(period AS STRING) AS period, DESIRED_CMSDataset, sum_file_size "
       "FROM clean LEFT JOIN file_size ON DESIRED_CMSDataset = dataset WHERE DESIRED_CMSDataset IS NOT NULL")
def monthly_dataset_size_extract(spark, sf_dir):
    path = shared_folder(spark, "months")
    extracts.write_period_dataset_sizes(B.jobs(spark, sf_dir, S.TOOL, S.DATASET), P.sizes_by_file(spark, sf_dir), path)
    return source.read_extract(spark, path)
