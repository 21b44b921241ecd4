"""Customer x month grid with zeros for months without activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.config import KEYS


def distinct_periods(df: DataFrame, period: str = KEYS.period) -> list[int]:
    """Months present in the data, newest first: a handful of values, bounded by the month range read."""
    return sorted((int(r[0]) for r in df.select(period).distinct().collect() if r[0] is not None), reverse=True)


def customer_grid(
    df: DataFrame, keys: Sequence[str], months: Sequence[int], period: str = KEYS.period
) -> DataFrame:
    """Every customer in every month, by exploding the month list of each distinct customer."""
    return df.select(*keys).distinct().withColumn(period, F.explode(F.array(*(F.lit(int(m)) for m in months))))


def densify(
    df: DataFrame, keys: Sequence[str], period: str = KEYS.period, fill: float | None = 0,
    months: Sequence[int] | None = None,
) -> DataFrame:
    """Rows for every customer and month; numeric columns of missing months become ``fill``."""
    months = distinct_periods(df, period) if months is None else months
    panel = df.withColumn(period, F.col(period).cast("int"))
    dense = customer_grid(panel, keys, months, period).join(panel, [*keys, period], "left")
    others = [c for c in df.columns if c not in (*keys, period)]
    return dense if fill is None else dense.na.fill(fill, subset=others)


def at_analysis_month(df: DataFrame, period: str = KEYS.period, analysis: str = KEYS.analysis) -> DataFrame:
    """Keep the row of the analysis month; use it after windows, not before."""
    return df.where(F.col(period).cast("int") == F.col(analysis).cast("int"))


def assert_has_month(df: DataFrame, month: int | str, period: str = KEYS.period) -> None:
    if df.where(F.col(period) == int(month)).limit(1).count() == 0:
        raise ValueError(f"no rows for analysis month {month}")
