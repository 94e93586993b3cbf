"""Time column helpers (H1 flush_window, H4 time_codecs).

All arithmetic goes through epoch microseconds so the results do not depend
on ``spark.sql.session.timeZone``: TIMESTAMP columns use their instant,
TIMESTAMP_NTZ columns are read as UTC wall-clock time.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, TimestampNTZType

def epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")

US_PER_DAY = 86_400_000_000


def micros_of(td: timedelta) -> int:
    return int(td / timedelta(microseconds=1))


def epoch_micros(col: Column | str, dtype: DataType | None = None) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", epoch_ntz(), c)
    return F.unix_micros(c)


def ntz_from_micros(us: Column) -> Column:
    """TIMESTAMP_NTZ for epoch microseconds (UTC wall clock)."""
    return F.timestamp_add("MICROSECOND", us, epoch_ntz())


def floor_micros(us: Column, step_us: int) -> Column:
    return us - F.pmod(us, F.lit(step_us))


#: Fixed value: days from the first day of year 1 to the epoch.
YEAR1_DAYS = 719_162


def _year1_shift(flush: timedelta) -> int:
    """Time since the last multiple of the interval, counted from year 1, at the epoch."""
    return YEAR1_DAYS * US_PER_DAY % micros_of(flush)


def flush_window(us: Column, flush: timedelta) -> Column:
    """H1: index of the UTC flush window holding ``us``. Windows count from
    the first day of year 1, shifted to the window at the epoch, so any
    interval gives the service's boundaries (for intervals that divide a day
    the shift is zero)."""
    return F.floor((us + F.lit(_year1_shift(flush))) / F.lit(micros_of(flush))).cast("long")


def flush_boundary_micros(window_idx: Column, flush: timedelta) -> Column:
    """H1: next UTC boundary = truncate(t, interval) + interval."""
    return (window_idx + 1) * F.lit(micros_of(flush)) - F.lit(_year1_shift(flush))


# H4 encodings of the state tables.
def ts_nanos(us: Column) -> Column:
    """Tip timestamp as unix nanoseconds."""
    return us * F.lit(1000)


def ts_seconds(us: Column) -> Column:
    """crt as unix seconds (lossy on purpose: used as a TTL)."""
    return F.floor(us / F.lit(1_000_000)).cast("long")


# fixed value: checkpoint text format, microsecond precision, fixed width
CHECKPOINT_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def checkpoint_text(ts: Column) -> Column:
    return F.date_format(ts, CHECKPOINT_TEXT_FORMAT)
