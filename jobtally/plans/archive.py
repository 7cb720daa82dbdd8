"""An archive of job records that is de-duplicated and looked up by job id without a shuffle.

The archive is a bucketed table: the records of a job lie in one bucket, sorted by id, whatever the day they came.
:func:`jobtally.operators.clean.clean_jobs` on it needs no exchange by id, nor does a join of two archives with as many
buckets. Days are partitions, so a window reads its days alone. Records are added with :func:`append`; a job that comes
again has several records until the next reading keeps the newest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtally import schemas as S
from jobtally.contract import MANY, Contract
from jobtally.functions import time as T
from jobtally.operators import clean
from jobtally.sources.windows import TimeWindow

BUCKETS = 256


def create(jobs: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS, columns: Sequence[str] | None = None,
           statuses=S.FINAL_STATUSES, **conditions) -> None:
    """A new archive of the newest record of every job in ``jobs``; an existing table of that name is an error.

    ``path`` is where an external table keeps its files. Choose ``buckets`` so that a day's bucket is a file of
    some 100 MB; it can't change later.
    """
    _write(jobs, table, path, buckets, "errorifexists", columns, statuses, conditions)


def append(jobs: DataFrame, table: str, columns: Sequence[str] | None = None, statuses=S.FINAL_STATUSES, **conditions) -> None:
    """More records: the newest of every job in ``jobs``. Only these are shuffled, not the archive."""
    _write(jobs, table, None, buckets_of(jobs.sparkSession, table), "append", columns, statuses, conditions)


def _write(jobs, table, path, buckets, mode, columns, statuses, conditions) -> None:
    cleaned = clean.clean_jobs(jobs, jobs.columns if columns is None else columns, statuses=statuses, **conditions)
    held = Contract(MANY, None if statuses is None else tuple(statuses))
    dated = held.of(cleaned).withColumn(S.RECORD_DATE, T.record_date(S.RECORD_TIME))
    # Dealt out like the buckets, so that a task writes files of its own bucket alone.
    writer = dated.repartition(buckets, S.JOB_ID).write.mode(mode).partitionBy(S.RECORD_DATE).bucketBy(buckets, S.JOB_ID).sortBy(S.JOB_ID)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def buckets_of(spark: SparkSession, table: str) -> int:
    """How many buckets the archive has."""
    told = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return int(told["Num Buckets"])


def read(spark: SparkSession, table: str, window: TimeWindow | None = None) -> DataFrame:
    """The records, several for some jobs. A window prunes day partitions, then rows."""
    df = spark.table(table)
    if window is None:
        return df
    if window.utc_days is None:
        return df.limit(0)
    return df.where(F.col(S.RECORD_DATE).between(*window.utc_days) & window.contains())


def look_up(spark: SparkSession, table: str, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``wanted`` job ids with ``columns`` of their newest archived record, NULL where the archive has none.

    The archive stays where it is; the ids are brought to its buckets, unless they come from an archive themselves.
    """
    newest = clean.clean_jobs(read(spark, table), columns).select(F.col(S.JOB_ID).alias("__id"), *(F.col(c).alias(f"__{c}") for c in columns))
    found = wanted.join(newest, wanted[S.JOB_ID] == newest["__id"], "left")
    return found.select(*wanted.columns, *(F.col(f"__{c}").alias(c) for c in columns if c not in wanted.columns))
