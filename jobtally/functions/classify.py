"""Row-level classes and measures of a job record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobtally import schemas as S
from jobtally.sources.exitcodes import TYPES


def mc_class(block=S.BLOCK) -> Column:
    """``mc`` for the Monte-Carlo marker block, ``notMc`` for all else, NULL included."""
    return F.when(F.col(block) == S.MC_BLOCK, "mc").otherwise("notMc")


def is_mc_job(block=S.BLOCK, job_type=S.JOB_TYPE) -> Column:
    """True for analysis jobs on the marker block, false otherwise, never NULL."""
    return F.coalesce((F.col(block) == S.MC_BLOCK) & (F.col(job_type) == S.ANALYSIS), F.lit(False))


def exit_flag(code=S.WRAPPER_EXIT_CODE) -> Column:
    """1 for a failure, 0 for a success, NULL when no code was reported."""
    return F.when(F.col(code) != 0, F.lit(1)).otherwise(F.col(code)).cast("bigint")


def exit_class(code=S.EXIT_CODE) -> Column:
    """The same three cases as text."""
    return (F.when(F.col(code) == 0, "Success").when(F.col(code).isNotNull(), "Fail")
            .otherwise("Null Exit Code"))


def exit_type(code=S.EXIT_CODE) -> Column:
    """Failure type of the range the code lies in, "" outside all ranges and for NULL."""
    (lo, hi, text), *rest = TYPES
    found = F.when(F.col(code).between(lo, hi), text)
    for lo, hi, text in rest:
        found = found.when(F.col(code).between(lo, hi), text)
    return found.otherwise("")


def core_hours() -> Column:
    """Wall hours times requested CPUs."""
    return F.col(S.WALL_HR) * F.col(S.CPUS)


def cpu_efficiency() -> Column:
    """CPU hours per core hour of one job; NULL when the job has no core hours."""
    return F.try_divide(F.col(S.CPU_HR), core_hours())
