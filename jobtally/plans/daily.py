"""A daily run: read what has arrived, renew the days it touches, and note both.

Records of a day arrive in its folder and, late, in those of the following days. A run looks at the folders of a window
of arrival days, reads those that hold files it has not seen, and finds the record days they touch. Only these days are
made again, each from all folders that can hold its records, and take the place of their partitions. What was read is
noted last: a run that died leaves no note, and the next one does the same work again with the same result.

So runs over any overlapping windows of arrival days end where one run over all of them would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtally import schemas as S, sinks
from jobtally.functions import time as T
from jobtally.operators import clean, state
from jobtally.plans import extracts
from jobtally.session import shared_base, shared_folder
from jobtally.sources import jobs as source
from jobtally.sources.windows import SLACK_DAYS, TimeWindow

SEEN, DAYS = "_seen", "_days"
_SEEN = "run INT, folder STRING, file STRING, length BIGINT, modified TIMESTAMP, arrival_day DATE"
_DAYS = f"run INT, {S.RECORD_DATE} DATE, arrived BIGINT"


class DailyTable(NamedTuple):
    """A table with one partition per UTC day: its name, the record columns it needs, and how whole days are made from records."""

    name: str
    columns: tuple[str, ...]
    make: Callable[[DataFrame], DataFrame]


def clean_records(columns: tuple[str, ...] = S.EXTRACT_COLUMNS, statuses=S.FINAL_STATUSES) -> DailyTable:
    """The clean extract: one record per job and day."""
    return DailyTable("clean", (*columns, S.STATUS), lambda r: extracts.clean_extract(r, statuses, columns=columns))


def dataset_blocks(dataset_size: DataFrame, block_size: DataFrame, tool: str | None = S.ANALYSIS_TOOL) -> DailyTable:
    """Accessed datasets and blocks with sizes, first and last access."""
    make = lambda r: extracts.dataset_blocks(r, dataset_size, block_size, per_day=True, tool=tool)
    return DailyTable("blocks", (S.TOOL, *extracts.ACCESS_COLUMNS), make)


def access_state(tool: str | None = S.ANALYSIS_TOOL) -> DailyTable:
    """Daily parts of the accesses, for :func:`jobtally.operators.state.merged_accesses`."""
    def make(records: DataFrame) -> DataFrame:
        return state.access_parts(clean.clean_jobs(records, extracts.ACCESS_COLUMNS, per_day=True, tool=tool, known_tier=True, with_block=True))

    return DailyTable("accesses", (S.TOOL, *extracts.ACCESS_COLUMNS), make)


def usage_state(**conditions) -> DailyTable:
    """Daily parts of dataset usage, for :func:`jobtally.operators.state.merged_usage`."""
    columns = (S.DATASET, S.CPU_HR, S.USER_NAME, S.WORKFLOW)
    return DailyTable("usage", columns, lambda r: state.usage_parts(clean.clean_jobs(r, columns, per_day=True, **conditions)))


class Run(NamedTuple):
    """What a run did: its number, the folders with new files, and the record days that were made again."""

    number: int
    folders: list[str]
    days: list[date]


def _noted(spark: SparkSession, home: str, name: str, schema: str) -> DataFrame:
    """What earlier runs noted; nothing at first."""
    try:
        return spark.read.schema(schema).parquet(f"{home}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _listed(spark: SparkSession, base: str, days: dict[str, date]) -> DataFrame:
    """Files of the day folders by name, length and time; no file is opened."""
    depth = next(iter(days)).count("/") + 2
    try:
        found = spark.read.format("binaryFile").load(source.candidate_glob(base, days))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        source.check_base(spark, base)
        return spark.createDataFrame([], "folder STRING, file STRING, length BIGINT, modified TIMESTAMP")
    tail = F.substring_index("path", "/", -depth)
    name = F.substring_index("path", "/", -1)
    return found.select(F.expr(f"substring_index(substring_index(path, '/', -{depth}), '/', {depth - 1})").alias("folder"),
                        name.alias("file"), "length", F.col("modificationTime").alias("modified")).where(tail.isNotNull())


def run(spark: SparkSession, base: str, home: str, arrivals: TimeWindow, tables: Iterable[DailyTable], *, slack: int = SLACK_DAYS,
        include_tmp: bool = False, day_folder: str = source.DAY_FOLDER, compression: str | None = "gzip") -> Run:
    """Bring the tables below ``home`` up to what arrived in the folders of the ``arrivals`` days.

    ``home`` has a folder for each table and the notes of all runs. Give every run the same tables: a day is noted once for
    all of them. Records more than ``slack`` days from their folder's day belong to no day, as when a window is read. A
    day that once had rows keeps its partition, even if all its records should vanish from their folders.
    """
    tables = list(tables)
    folder_days = {f: d for d in arrivals.folder_days(0) for f in
                   [d.strftime(day_folder) + suffix for suffix in (("", ".tmp") if include_tmp else ("",))]}
    past = _noted(spark, home, SEEN, _SEEN)
    number = (past.agg(F.max("run")).first()[0] or 0) + 1
    if not folder_days:
        return Run(number, [], [])
    arrived_on = F.create_map(*(F.lit(x) for pair in folder_days.items() for x in pair))
    listed = _listed(spark, base, folder_days).withColumn("arrival_day", arrived_on[F.col("folder")])
    known = past.where(F.col("arrival_day").between(*arrivals.utc_days)).select("folder", "file", "length", "modified")
    # Kept as it is now: what comes while this run reads is new to the next one.
    fresh = sinks.written(listed.join(known, ["folder", "file", "length", "modified"], "left_anti"), shared_folder(spark, "arrived"))
    folders = sorted(r.folder for r in fresh.select("folder").distinct().collect())
    if not folders:
        return Run(number, [], [])
    near = lambda d: any(abs((d - folder_days[f]).days) <= slack for f in folders)
    first, last = min(folder_days[f] for f in folders), max(folder_days[f] for f in folders)
    day = T.record_date(S.RECORD_TIME)
    times = source.flatten(source.read_folders(spark, base, folders, [S.RECORD_TIME, S.JOB_ID]))
    counts = (times.select(day.alias(S.RECORD_DATE)).where(F.col(S.RECORD_DATE).between(first - timedelta(slack), last + timedelta(slack)))
              .groupBy(S.RECORD_DATE).agg(F.count(F.lit(1)).alias("arrived")).collect())
    touched = {r[S.RECORD_DATE]: r.arrived for r in counts if near(r[S.RECORD_DATE])}
    days = sorted(touched)
    if days:
        _renew(spark, base, home, days, tables, slack, include_tmp, day_folder, compression)
        notes = spark.createDataFrame([(number, d, touched[d]) for d in days], _DAYS)
        notes.coalesce(1).write.mode("append").parquet(f"{home}/{DAYS}")
    noted = fresh.select(F.lit(number).alias("run"), "folder", "file", "length", "modified", "arrival_day")
    noted.write.mode("append").parquet(f"{home}/{SEEN}")
    sinks.remove_inputs(fresh, shared_base(spark))
    return Run(number, folders, days)


def _renew(spark, base, home, days, tables, slack, include_tmp, day_folder, compression) -> None:
    """Make the days again, in all tables, from one reading of the folders that can hold their records."""
    around = sorted({d + timedelta(i) for d in days for i in range(-slack, slack + 1)})
    folders = [d.strftime(day_folder) + suffix for d in around for suffix in (("", ".tmp") if include_tmp else ("",))]
    columns = list(dict.fromkeys([S.RECORD_TIME, S.JOB_ID, *(c for t in tables for c in t.columns)]))
    records = source.flatten(source.read_folders(spark, base, folders, columns))
    whole = records.where(T.record_date(S.RECORD_TIME).isin(days))
    whole = sinks.written(whole, shared_folder(spark, "touched"))
    for table in tables:
        sinks.write_by(table.make(whole), f"{home}/{table.name}", compression=compression, replace=True)
    sinks.remove_inputs(whole, shared_base(spark))


def read(spark: SparkSession, home: str, table: DailyTable | str, window: TimeWindow | None = None) -> DataFrame:
    """A table of the runs; a window of whole UTC days reads their partitions alone."""
    return source.read_extract(spark, f"{home}/{table if isinstance(table, str) else table.name}", window)


def touched_days(spark: SparkSession, home: str) -> DataFrame:
    """(run, record_date, arrived): the days every run made again, and how many records of them had arrived in its new folders."""
    return _noted(spark, home, DAYS, _DAYS)
