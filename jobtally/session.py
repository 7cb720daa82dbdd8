"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_utc(spark: SparkSession) -> SparkSession:
    """Make timestamps render in UTC; call it before any plan is built."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="jobtally-")


def shared_base(spark: SparkSession) -> str | None:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session, whose driver and executors are one process, gets a
    folder of its own; on a cluster there is none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    return _own_folder() if spark.sparkContext.master.split("[")[0] == "local" else None


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder name below the shared folder."""
    base = shared_base(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir, when the session is built, to a folder that all executors share")
    return f"{base}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of every query run inside as it ends, and not when the driver next collects its garbage.

    The one option besides the time zone that the library sets, and it is put back. Should another query
    of the session need such a file again, Spark makes it again.
    """
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)
