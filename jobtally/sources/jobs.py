"""Job records: nested JSON, one folder per day."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from jobtally import schemas as S
from jobtally.sources.windows import SLACK_DAYS, TimeWindow

DAY_FOLDER = "%Y/%m/%d"


def candidate_folders(window: TimeWindow, slack: int = SLACK_DAYS, include_tmp: bool = False,
                      day_folder: str = DAY_FOLDER) -> list[str]:
    """Day folders, relative to the base, that can hold records of the window.

    ``include_tmp`` also names the ``.tmp`` folders of days not compacted yet.
    """
    names = [d.strftime(day_folder) for d in window.folder_days(slack)]
    return [n + suffix for n in names for suffix in (("", ".tmp") if include_tmp else ("",))]


def candidate_glob(base: str, folders: Iterable[str]) -> str:
    """One glob over all folders: it matches those that exist and skips the others."""
    return f"{base.rstrip('/')}/{{{','.join(folders)}}}"


def check_base(spark: SparkSession, base: str) -> None:
    """Raise if the base folder does not exist. One look at the folder itself, nothing is listed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {base}")


def read_folders(spark: SparkSession, base: str, folders: Iterable[str], columns: Iterable[str] | None = None,
                 malformed: str | None = None) -> DataFrame:
    """Nested records (one ``data`` struct) of the named folders; those that do not exist are skipped.

    With ``malformed`` lines that don't fit the schema keep their text in a column of that name.
    """
    schema = S.job_schema(columns)
    wanted = ["data"]
    if malformed:
        schema, wanted = schema.add(malformed, "string"), ["data", malformed]
    folders = list(folders)
    if not folders:
        check_base(spark, base)
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", base).schema(schema)
    if malformed:
        reader = reader.option("columnNameOfCorruptRecord", malformed)
    try:
        # The records alone: a folder named like key=value must not add columns.
        return reader.json(candidate_glob(base, folders)).select(*wanted)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        check_base(spark, base)
        return spark.createDataFrame([], schema)


def scan_json(spark: SparkSession, base: str, window: TimeWindow, columns: Iterable[str] | None = None, *,
              slack: int = SLACK_DAYS, include_tmp: bool = False,
              day_folder: str = DAY_FOLDER, malformed: str | None = None) -> DataFrame:
    """Nested records (one ``data`` struct) of the folders around the window.

    Only the named columns are parsed. Lines that are not JSON come back as rows
    of NULLs. A window with no folder at all gives an empty result; a base folder
    that does not exist is an error.
    """
    return read_folders(spark, base, candidate_folders(window, slack, include_tmp, day_folder), columns, malformed)


def read_jobs(spark: SparkSession, base: str, window: TimeWindow, columns: Iterable[str] | None = None,
              **scan) -> DataFrame:
    """Flat records of the window: folders with slack are read, rows filtered exactly."""
    wanted = None if columns is None else list(dict.fromkeys([S.RECORD_TIME, S.JOB_ID, *columns]))
    return flatten(scan_json(spark, base, window, wanted, **scan)).where(window.contains())


MALFORMED = "malformed"


class Reading(NamedTuple):
    """Records of a window, the lines that are no records, and counts that an action on ``records`` fills.

    ``counts.get`` has ``read``, ``kept``, ``outside`` and ``malformed`` once a query has read all of ``records``;
    read is the sum of the other three.
    """

    records: DataFrame
    quarantine: DataFrame
    counts: Observation


def read_jobs_counted(spark: SparkSession, base: str, window: TimeWindow, columns: Iterable[str] | None = None,
                      **scan) -> Reading:
    """Like :func:`read_jobs`, but no line goes unnoticed.

    A line is malformed if it is not JSON, if a field has another type, or if it has no record time: without one nobody
    can tell the window it belongs to. Its text is in ``quarantine``. The counts come from the same pass over the files that
    reads the records.
    """
    wanted = None if columns is None else list(dict.fromkeys([S.RECORD_TIME, S.JOB_ID, *columns]))
    lines = scan_json(spark, base, window, wanted, malformed=MALFORMED, **scan)
    bad = F.col(MALFORMED).isNotNull() | F.col(f"data.{S.RECORD_TIME}").isNull()
    kept = ~bad & F.coalesce(window.contains(f"data.{S.RECORD_TIME}"), F.lit(False))
    counts = Observation(f"jobs read {uuid.uuid4().hex}")
    seen = lines.observe(counts, F.count(F.lit(1)).alias("read"), F.count_if(kept).alias("kept"),
                         F.count_if(~bad & ~kept).alias("outside"), F.count_if(bad).alias("malformed"))
    text = F.coalesce(F.col(MALFORMED), F.to_json(F.struct("data")))
    return Reading(flatten(seen.where(kept)), lines.where(bad).select(text.alias("line")), counts)


def flatten(nested: DataFrame) -> DataFrame:
    """The fields under ``data`` as top-level columns."""
    return nested.select("data.*")


def read_extract(spark: SparkSession, path: str, window: TimeWindow | None = None) -> DataFrame:
    """A Parquet extract; a window prunes its day partitions and then its rows.

    A partition is named after the UTC day of its records, so no slack is needed. A
    table without record times holds whole days: there the window must be whole UTC
    days, and a table with neither times nor days (one row per period) takes none.
    """
    df = spark.read.parquet(path)
    if window is None:
        return df
    timed, dated = S.RECORD_TIME in df.columns, S.RECORD_DATE in df.columns
    if not timed and not (dated and window.whole_days):
        raise ValueError(f"{path} has no record times, so this window can't be cut from it exactly")
    if window.utc_days is None:
        return df.limit(0)
    if dated:
        df = df.where(df[S.RECORD_DATE].between(*window.utc_days))
    return df.where(window.contains()) if timed else df
