"""Row filters and de-duplication of job records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobtally import contract, schemas as S
from jobtally.functions import time as T
from jobtally.operators import packing
from jobtally.sources.windows import TimeWindow

_RANK = "__rank"


def job_filter(*, window: TimeWindow | None = None, statuses: Sequence[str] | None = None,
               types: Sequence[str] | None = None, tool: str | None = None,
               known_tier: bool = False, with_block: bool = False, with_exit_code: bool = False) -> Column:
    """One conjunction of the asked conditions; a NULL never satisfies one."""
    parts = [F.lit(True)]
    if window is not None:
        parts.append(window.contains())
    if statuses is not None:
        parts.append(F.col(S.STATUS).isin(*statuses))
    if types is not None:
        parts.append(F.col(S.JOB_TYPE).isin(*types))
    if tool is not None:
        parts.append(F.col(S.TOOL) == tool)
    if known_tier:
        parts.append(F.col(S.TIER) != S.UNKNOWN_TIER)
    if with_block:
        parts.append(F.col(S.BLOCK).isNotNull())
    if with_exit_code:
        parts.append(F.col(S.EXIT_CODE).isNotNull())
    condition = parts[0]
    for part in parts[1:]:
        condition = condition & part
    return condition


def without_mark(df: DataFrame, column: str, mark: str = S.PROBE_MARK) -> DataFrame:
    """Rows whose name does not contain ``mark`` (case matters); NULL names are dropped."""
    return df.where(~F.col(column).contains(mark))


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: str = S.RECORD_TIME, pack: bool = True) -> DataFrame:
    """One row per key: the newest, equal times settled by all other columns in name order.

    The order covers every column, so the result never depends on how the rows
    are spread. Each task first keeps its own best row per key, so a hot key
    (a NULL id, say) sends one row per task through the shuffle and not all.
    Sorting goes by a hash of the key first: job ids share a long prefix, and the
    numbers are told apart at once where the texts would be compared in full.
    Of many columns those next to each other in the order go as one text that sorts
    as they do: the one shuffle of whole records has fewer bytes. Where there is disk enough, without ``pack``,
    they stay columns, which takes less CPU.
    """
    ties = sorted(c for c in df.columns if c not in keys and c != newest)
    narrow, ties, unpacked = packing.packed(df, packing.runs(df, ties) if pack else [[c] for c in ties])
    order = [F.col(newest).desc_nulls_last(), *(F.col(c).asc_nulls_first() for c in ties)]
    ranked = narrow.withColumn(_RANK, F.row_number().over(W.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)))
    return unpacked(ranked.where(F.col(_RANK) == 1).drop(_RANK))


def any_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, whichever Spark meets first."""
    return df.dropDuplicates(list(keys))


def clean_jobs(df: DataFrame, keep: Sequence[str] | None = None, *, per_day: bool = False,
               already_clean: bool = False, pack: bool = True, **conditions) -> DataFrame:
    """Filter, then keep one record per job id: the front of every analysis.

    The filter has to come first: a job with a running and a final record keeps
    the final one only because the running one is gone by then. Of the columns
    only id, time and ``keep`` go on, so that no others are shuffled. ``per_day``
    keeps one record per job and UTC day and adds ``record_date``, which is what
    a run per day would give; a job seen on two days is then in both.
    ``already_clean`` is for extracts that hold each job once: they are filtered
    only, which saves the one shuffle that grows with the records. A table whose
    contract says otherwise is refused. ``pack`` goes to :func:`latest_per_key`.
    """
    if already_clean:
        contract.check_clean(df, per_day, conditions.get("statuses"))
    kept = df.where(job_filter(**conditions))
    if keep is not None:
        kept = kept.select(*dict.fromkeys([S.JOB_ID, S.RECORD_TIME, *keep]))
    if per_day:
        kept = kept.withColumn(S.RECORD_DATE, T.record_date(S.RECORD_TIME))
    if already_clean:
        return kept
    return latest_per_key(kept, [S.RECORD_DATE, S.JOB_ID] if per_day else [S.JOB_ID], pack=pack)
