"""Month arithmetic on ``YYYYMM`` codes: plain Python for run control, Columns for data."""

from __future__ import annotations

import calendar
from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_ZONE = "America/Lima"


def _index(month: int | str) -> int:
    code = int(month)
    year, number = divmod(code, 100)
    if not 1 <= number <= 12:
        raise ValueError(f"not a YYYYMM month: {month!r}")
    return year * 12 + number - 1


def _code(index: int) -> int:
    return index // 12 * 100 + index % 12 + 1


def shift_month(month: int | str, n: int) -> str:
    """Month ``n`` months later (earlier when negative)."""
    return str(_code(_index(month) + n))


def month_list(start: int | str, end: int | str) -> list[str]:
    """Every month of the interval, newest first."""
    first, last = _index(start), _index(end)
    if first > last:
        raise ValueError(f"first month {start} is after last month {end}")
    return [str(_code(i)) for i in range(last, first - 1, -1)]


def analysis_windows(start: int | str, end: int | str, back: int = 11) -> list[tuple[str, str]]:
    """(analysis month, first month of its window), newest first."""
    return [(m, shift_month(m, -back)) for m in month_list(start, end)]


def month_ordinal(analysis: int | str, month: int | str) -> int:
    """1 for the analysis month itself, 12 for eleven months before it."""
    return _index(analysis) - _index(month) + 1


def process_month_end(run_date: date | str) -> str:
    """Month closed on ``run_date``: its own month on the last calendar day, else the one before."""
    day = date.fromisoformat(run_date) if isinstance(run_date, str) else run_date
    month = day.year * 100 + day.month
    closed = day.day == calendar.monthrange(day.year, day.month)[1]
    return shift_month(month, 0 if closed else -1)


def process_month_cutoff(run_date: date | str, cutoff_day: int | str) -> int:
    """Its own month from ``cutoff_day`` on, else the month before."""
    day = date.fromisoformat(run_date) if isinstance(run_date, str) else run_date
    month = day.year * 100 + day.month
    return int(shift_month(month, 0 if day.day >= int(cutoff_day) else -1))


def run_timestamp(zone: str = RUN_ZONE) -> datetime:
    """Wall-clock time of the run in ``zone``, to the second and without an offset."""
    return datetime.now(ZoneInfo(zone)).replace(microsecond=0, tzinfo=None)


# Column versions


def month_index_col(month: Column) -> Column:
    code = month.cast("int")
    return F.floor(code / 100).cast("int") * 12 + code % 100 - 1


def month_from_index_col(index: Column) -> Column:
    return (F.floor(index / 12) * 100 + index % 12 + 1).cast("int")


def month_of_col(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def shift_month_col(month: Column, n: int) -> Column:
    return month_from_index_col(month_index_col(month) + F.lit(n))


def month_ordinal_col(analysis: Column, month: Column) -> Column:
    return month_index_col(analysis) - month_index_col(month) + 1


def process_month_end_col(day: Column) -> Column:
    month = month_of_col(day)
    closed = F.to_date(day) == F.last_day(day)
    return F.when(closed, month).otherwise(shift_month_col(month, -1))


def process_month_cutoff_col(day: Column, cutoff_day: int) -> Column:
    month = month_of_col(day)
    return F.when(F.dayofmonth(day) >= cutoff_day, month).otherwise(shift_month_col(month, -1))


def analysis_windows_df(
    df: DataFrame, start: str, end: str, back: int = 11, month: str = "codmes", first: str = "first_month"
) -> DataFrame:
    """One row per analysis month of each (start, end) row; a start after the end is an error."""
    first_index, last_index = month_index_col(F.col(start)), month_index_col(F.col(end))
    ordered = F.when(first_index <= last_index, F.sequence(first_index, last_index))
    reversed_range = F.raise_error(F.lit("the first month is after the last month")).cast("array<int>")
    index = F.explode(F.when(first_index > last_index, reversed_range).otherwise(ordered)).alias("_i")
    return df.select(index).select(
        month_from_index_col(F.col("_i")).alias(month),
        month_from_index_col(F.col("_i") - back).alias(first),
    )


def audit_cols(df: DataFrame, run_date: date | str, ts: datetime | None = None) -> DataFrame:
    """Add the routine date and the record timestamp."""
    stamp = (ts or run_timestamp()).strftime("%Y-%m-%d %H:%M:%S")
    return df.withColumns(
        {
            "fecrutina": F.lit(str(run_date)).cast("date"),
            "fecactualizacionregistro": F.lit(stamp).cast("timestamp"),
        }
    )
