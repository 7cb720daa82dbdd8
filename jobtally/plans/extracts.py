"""Tables written once and read many times.

A clean extract is the place to start from on large data: it is columnar, holds
one record per job and day, and its day partitions and column statistics prune
what the raw JSON cannot.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from jobtally import contract, passes as P, schemas as S, sinks
from jobtally.contract import ONE_PER_JOB, ONE_PER_JOB_AND_DAY, Contract
from jobtally.functions import time as T
from jobtally.operators import catalogue, clean, topk
from jobtally.session import shared_base, shared_folder, shuffles_freed


def clean_extract(jobs: DataFrame, statuses=S.FINAL_STATUSES, once: bool = False, columns=S.EXTRACT_COLUMNS,
                  **conditions) -> DataFrame:
    """Columns of finished jobs and their UTC day: fourteen by default, with ``columns=None`` all that ``jobs`` has.

    One record per job and day, as a run per day gives; with ``once`` one per job
    in all, so that analyses of the extract can pass ``already_clean=True``. The
    extract carries a contract that says which of the two it is; a wide one
    answers every analysis of the library.
    """
    columns = jobs.columns if columns is None else columns
    cleaned = clean.clean_jobs(jobs, columns, per_day=not once, statuses=statuses, **conditions)
    if once:
        cleaned = cleaned.withColumn(S.RECORD_DATE, T.record_date(S.RECORD_TIME))
    held = None if statuses is None else tuple(statuses)
    return Contract(ONE_PER_JOB if once else ONE_PER_JOB_AND_DAY, held).of(cleaned)


def _check_replaced(window, replace: bool, period: str = "day") -> None:
    """Refuse to replace partitions that the window holds only in part: the rest would be lost.

    The window has to be given to the writer: records cut before could hold part of a day without anything to show it.
    """
    if not replace:
        return
    if window is None:
        raise ValueError("replace needs the window whose partitions are renewed")
    bounds = (datetime.fromtimestamp(ms / 1000, timezone.utc) for ms in (window.start_ms, window.end_ms))
    starts = {"day": lambda d: True, "week": lambda d: d.weekday() == 0, "month": lambda d: d.day == 1,
              "quarter": lambda d: d.day == 1 and d.month % 3 == 1, "year": lambda d: (d.month, d.day) == (1, 1)}
    if period not in starts:
        raise ValueError(f"partitions of period {period!r} can't be replaced by a window")
    if not window.whole_days or not all(starts[period](d) for d in bounds):
        raise ValueError(f"replace needs a window of whole UTC {period}s")


def write_clean_extract(jobs: DataFrame, path: str, replace: bool = False, passes: int | None = None, **options) -> None:
    """Gzip Parquet, a partition per day; all days in one job, or a large table in several ``passes``.

    ``replace`` takes the place of whole days, so a window must be whole UTC days. How many passes there are
    follows from the size of the files read (:func:`jobtally.passes.needed`) if it is not given; they need the shared folder.
    """
    _check_replaced(options.get("window"), replace)
    count = passes or P.needed(jobs)
    if count == 1 or shared_base(jobs.sparkSession) is None:
        sinks.write_by(clean_extract(jobs, **options), path, compression="gzip", replace=replace)
    else:
        _write_in_passes(jobs, path, replace, count, options)


_DAYS = "__days"


def _write_in_passes(jobs: DataFrame, path: str, replace: bool, count: int, options: dict) -> None:
    """Clean a part of the jobs at a time, then write a part of the days at a time.

    A pass reads all records, takes the jobs whose id falls to it and keeps their best records as compressed columns,
    sorted out by parts of the days. So the disk holds these, what is written, and the shuffles of one pass. Every day is
    written by one pass: it has no more files than in one job. Should a pass fail, a new table is taken back; a replaced
    one has days of both until it is written again. ``jobs`` has to give the same records each time it is read.
    """
    spark = jobs.sparkSession
    if not replace and sinks.exists(spark, path):
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path already exists: {path}")
    kept, begun = shared_folder(spark, "cleaned"), False
    try:
        with shuffles_freed(spark):
            for i in range(count):
                cleaned = clean_extract(jobs.where(P.number(S.JOB_ID, count) == i), pack=False, **options)
                sinks.write_parts(cleaned.withColumn(_DAYS, P.number(S.RECORD_DATE, count)), kept, _DAYS)
            for i in range(count):
                part = f"{kept}/{_DAYS}={i}"
                days = sinks.read_part(cleaned, part)
                sinks.write_by(days, path, compression="gzip", replace=replace, pack=False, begun=begun, complete=i == count - 1)
                begun = True
                sinks.remove(spark, part)
    except BaseException:
        if begun and not replace:
            sinks.remove(spark, path)
        raise
    finally:
        sinks.remove(spark, kept)


ACCESS_COLUMNS = (S.TIER, S.DATASET, S.BLOCK, S.TASK)


def dataset_blocks(jobs: DataFrame, dataset_size: DataFrame, block_size: DataFrame, *, per_day: bool = False,
                   tool: str | None = S.ANALYSIS_TOOL, window=None, access_path: str | None = None,
                   already_clean: bool = False) -> DataFrame:
    """Accessed datasets and blocks with sizes, first and last access.

    The dataset and the block table both come from the accesses, which are few
    against the records. They are written once, to ``access_path`` or a new folder
    below the shared one, and read back for the two: the records are cleaned and
    grouped in one pass. The folder stays until it is deleted
    (:func:`jobtally.sinks.remove_inputs`); in a session without a shared folder
    the result stays lazy and both tables share the shuffled records.
    """
    cleaned = clean.clean_jobs(jobs, ACCESS_COLUMNS, per_day=per_day, tool=tool, known_tier=True, with_block=True,
                               window=window, already_clean=already_clean)
    keys = [S.RECORD_DATE] if per_day else []
    access = catalogue.accesses(cleaned, *keys)
    if access_path is None and shared_base(jobs.sparkSession):
        access_path = shared_folder(jobs.sparkSession, "accesses")
    if access_path is not None:
        access = sinks.written(access, access_path)
    return catalogue.dataset_block_table(access, dataset_size, block_size, *keys)


def largest_dataset_blocks(jobs: DataFrame, dataset_size: DataFrame, block_size: DataFrame, **options) -> DataFrame:
    """The same, largest datasets first."""
    return topk.largest_first(dataset_blocks(jobs, dataset_size, block_size, **options),
                              S.DATASET_SIZE, [S.DATASET, S.BLOCK])


def write_daily_dataset_blocks(jobs: DataFrame, dataset_size: DataFrame, block_size: DataFrame, path: str,
                               replace: bool = False, **options) -> None:
    """One table per UTC day, all days in one job; the size tables are made once."""
    _check_replaced(options.get("window"), replace)
    table = dataset_blocks(jobs, dataset_size, block_size, per_day=True, **options)
    sinks.write_by(table, path, replace=replace)


def period_dataset_sizes(jobs: DataFrame, sizes: DataFrame, period: str = "month", tool: str | None = S.ANALYSIS_TOOL,
                         distinct_datasets: bool = False, window=None, already_clean: bool = False) -> DataFrame:
    """Sizes of the datasets used in each period ("day", "week", "month", ...).

    A job counts once per period. By default there is a row for every job; with
    ``distinct_datasets`` one per dataset and its number of jobs. An extract with
    one record per job (``already_clean``) has each job in its last period only.
    """
    if already_clean:
        contract.check_clean(jobs, per_day=False)
    kept = jobs.where(clean.job_filter(tool=tool, window=window)).select(S.JOB_ID, S.RECORD_TIME, S.DATASET)
    day = T.record_date(S.RECORD_TIME)
    dated = kept.withColumn("period", day if period == "day" else F.trunc(day, period))
    once = dated if already_clean else clean.latest_per_key(dated, ["period", S.JOB_ID])
    if distinct_datasets:
        return catalogue.distinct_dataset_sizes(once, sizes, "period")
    return catalogue.job_dataset_sizes(once, sizes).select("period", S.DATASET, "sum_file_size")


def write_period_dataset_sizes(jobs: DataFrame, sizes: DataFrame, path: str, replace: bool = False, **options) -> None:
    """A partition per period, written in one job. To ``replace``, a window must be whole periods in UTC."""
    _check_replaced(options.get("window"), replace, options.get("period", "month"))
    sinks.write_by(period_dataset_sizes(jobs, sizes, **options), path, ["period"], replace=replace)


def write_dataset_sizes(sizes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Keep the size catalogue as a table: made once, its measured size then lets
    Spark choose a broadcast by itself where it is small enough."""
    sinks.write_parquet(sizes, path, mode=mode)
