"""Time windows: half-open in epoch milliseconds, widened to day folders for reading."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobtally import schemas as S

DAY_MS = 86_400_000
SLACK_DAYS = 3  # a day folder can hold records of days this far away


@dataclass(frozen=True)
class TimeWindow:
    """``[start, end)``, both local times of ``zone``.

    Day and hour keys are always UTC. ``zone`` only moves the bounds, for windows
    that were asked for in the local time of some machine.
    """

    start: datetime
    end: datetime
    zone: str = "UTC"

    def __post_init__(self):
        if self.end_ms < self.start_ms:
            raise ValueError(f"the window ends before it starts: {self.start} to {self.end}")

    def _ms(self, when: datetime) -> int:
        return round(when.replace(tzinfo=ZoneInfo(self.zone)).timestamp() * 1000)

    @property
    def start_ms(self) -> int:
        return self._ms(self.start)

    @property
    def end_ms(self) -> int:
        return self._ms(self.end)

    def contains(self, column: str = S.RECORD_TIME) -> Column:
        """Row filter of the window; NULL times fail it."""
        return (F.col(column) >= self.start_ms) & (F.col(column) < self.end_ms)

    @property
    def utc_days(self) -> tuple[date, date] | None:
        """First and last UTC date that the window touches; None if it is empty."""
        if self.end_ms == self.start_ms:
            return None
        first, last = (datetime.fromtimestamp(ms / 1000, timezone.utc).date() for ms in (self.start_ms, self.end_ms - 1))
        return first, last

    @property
    def whole_days(self) -> bool:
        """Whether both bounds are the starts of UTC days."""
        return self.start_ms % DAY_MS == 0 and self.end_ms % DAY_MS == 0

    def folder_days(self, slack: int = SLACK_DAYS) -> list[date]:
        """Days whose folders can hold records of the window: its UTC days and ``slack`` days on both sides."""
        if self.utc_days is None:
            return []
        first, last = self.utc_days
        return [first + timedelta(days=i) for i in range(-slack, (last - first).days + slack + 1)]


def month_window(year: int, month: int) -> TimeWindow:
    """The whole calendar month, whatever its length."""
    following = (year + 1, 1) if month == 12 else (year, month + 1)
    return TimeWindow(datetime(year, month, 1), datetime(*following, 1))


def days_of(spark: SparkSession, window: TimeWindow) -> DataFrame:
    """One row per UTC day that the window touches: (record_date, start_ms, end_ms)."""
    if window.utc_days is None:
        return with_day_bounds(spark.createDataFrame([], f"{S.RECORD_DATE} DATE"))
    day = F.explode(F.sequence(*(F.lit(d) for d in window.utc_days)))
    return with_day_bounds(spark.range(1).select(day.alias(S.RECORD_DATE)))


def calendar_of(days: DataFrame, column: str = S.RECORD_DATE) -> DataFrame:
    """Every day of the months that ``days`` touches, with its bounds.

    Only one row per month is kept before the days are laid out, so the result
    grows with the calendar and not with the input.
    """
    months = days.select(F.trunc(column, "month").alias("m")).where("m IS NOT NULL").distinct()
    day = F.explode(F.sequence(F.col("m"), F.last_day("m")))
    return with_day_bounds(months.select(day.alias(S.RECORD_DATE)))


def with_day_bounds(days: DataFrame) -> DataFrame:
    """Add the epoch-millisecond bounds ``[start_ms, end_ms)`` of each UTC day."""
    start = F.unix_date(S.RECORD_DATE).cast("bigint") * DAY_MS
    return days.withColumns({"start_ms": start, "end_ms": start + DAY_MS})
