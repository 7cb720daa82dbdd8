"""UTC calendar keys of epoch-millisecond columns.

Day and hour are whole-number arithmetic on the epoch, so they are UTC whatever
the session's time zone is, and they group as numbers instead of as text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_ts(ms) -> Column:
    """Epoch milliseconds as TIMESTAMP."""
    return F.timestamp_millis(_col(ms))


def record_date(ms) -> Column:
    """UTC date of epoch milliseconds."""
    start_of_day = _col(ms) - F.pmod(_col(ms), F.lit(DAY_MS))
    return F.date_from_unix_date(F.call_function("div", start_of_day, F.lit(DAY_MS)).cast("int"))


def hour_of_day(ms) -> Column:
    """UTC hour 0-23 of epoch milliseconds."""
    return F.call_function("div", F.pmod(_col(ms), F.lit(DAY_MS)), F.lit(HOUR_MS)).cast("int")


def hour_label(hour) -> Column:
    """Hour as the text "00" to "23"."""
    return F.lpad(_col(hour).cast("string"), 2, "0")


def day_of_month(ms) -> Column:
    """Day of the month as the text "01" to "31"; mixes months by design."""
    return F.date_format(record_date(ms), "dd")


def day_folder(date) -> Column:
    """Date as the folder name ``YYYY/MM/DD``."""
    return F.date_format(_col(date), "yyyy/MM/dd")


def ms_text(ms) -> Column:
    """Epoch milliseconds as ``YYYY-MM-DD HH:MM:SS`` in the session's zone."""
    return F.date_format(record_ts(ms), "yyyy-MM-dd HH:mm:ss")


def to_ms(ts) -> Column:
    """Timestamp (or zone-less timestamp, read in the session's zone) as epoch milliseconds."""
    return F.unix_millis(_col(ts).cast("timestamp"))
