"""General month-horizon aggregates.

All of them are one group-by of conditional aggregates over the month ordinal (1 = analysis month), so
they combine map-side and shuffle once on the keys, and specs from several builders can run in a single
``trailing_agg``. Missing months are not filled: NULL values are skipped as SQL aggregates skip them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.config import KEYS
from featmatrix.functions.naming import frequency_suffix
from featmatrix.functions.periods import month_ordinal_col

ORDINAL = "_ordinal"

# Months covered by "the previous n months", and the value for "never opened".
PREVIOUS_BLOCKS = {3: (4, 6), 6: (7, 12), 1: (2, 2)}
NO_OPENING = 300001
OPENING_NAME = "FATC_FEC_CODMES_AP_TC"


@dataclass(frozen=True)
class AggSpec:
    """``fn`` over ``value`` (SQL) of the rows with ordinal ``lo..hi`` that satisfy ``predicate``.

    ``otherwise`` is the value of the other rows; ``default`` replaces a NULL result.
    """

    name: str
    fn: str
    value: str
    lo: int | None = None
    hi: int | None = None
    predicate: str | None = None
    otherwise: str | None = None
    default: str | None = None

    def sql(self) -> str:
        tests = [f"{ORDINAL} between {self.lo} and {self.hi}"] if self.lo is not None else []
        if self.predicate:
            tests.append(f"({self.predicate})")
        value = self.value
        if tests:
            rest = f" else {self.otherwise}" if self.otherwise is not None else ""
            value = f"case when {' and '.join(tests)} then {value}{rest} end"
        result = f"{self.fn}({value})"
        return result if self.default is None else f"coalesce({result}, {self.default})"


def trailing_agg(
    df: DataFrame, specs: Sequence[AggSpec], keys: Sequence[str] = KEYS.matrix,
    period: str = KEYS.period, analysis: str = KEYS.analysis,
) -> DataFrame:
    names = [s.name for s in specs]
    if len(set(names)) != len(names):
        raise ValueError("two aggregates have the same output name")
    ordinal = month_ordinal_col(F.col(analysis), F.col(period)).cast("double")
    aggregates = [F.expr(s.sql()).alias(s.name) for s in specs]
    return df.withColumn(ORDINAL, ordinal).groupBy(*keys).agg(*aggregates)


def _months(offset: int) -> int:
    """Horizons of the first builders are offsets: 0, -2 or 2, ... mean 1, 3, ... months."""
    return abs(offset) + 1


def _until(n: int) -> str:
    return f"U{n}" if n == 12 else f"U{n}M"


def frequency(columns: Iterable[str], offsets: Iterable[int]) -> list[AggSpec]:
    """Months with a value above zero."""
    columns = list(columns)
    return [
        AggSpec(f"{c}_{frequency_suffix(n)}", "count", c, 1, n, f"coalesce({c}, 0) > 0")
        for n in map(_months, offsets)
        for c in columns
    ]


def recency(columns: Iterable[str]) -> list[AggSpec]:
    """Ordinal of the newest month with a value above zero, else 0."""
    return [
        AggSpec(f"{c}_REC", "min", f"case when coalesce({c}, 0) > 0 then {ORDINAL} end", default="0D") for c in columns
    ]


def seniority_mean(columns: Iterable[str], offsets: Iterable[int]) -> list[AggSpec]:
    columns = list(columns)
    return [
        AggSpec(f"{c}_U1M" if n == 1 else f"{c}_PRM_{_until(n)}", "avg", c, 1, n)
        for n in map(_months, offsets)
        for c in columns
    ]


def type_extremes(columns: Iterable[str], offsets: Iterable[int]) -> list[AggSpec]:
    """Maximum (the value itself for one month) and, from two months up to twelve on, minimum."""
    columns = list(columns)
    specs = []
    for n in map(_months, offsets):
        specs += [AggSpec(f"{c}_U1M" if n == 1 else f"{c}_MAX_{_until(n)}", "max", c, 1, n) for c in columns]
        if 1 < n <= 12:
            specs += [AggSpec(f"{c}_MIN_{_until(n)}", "min", c, 1, n) for c in columns]
    return specs


def block(
    fn: str, columns: Iterable[str], months: Iterable[int | str], label: str, previous: bool = False,
    plain_twelve: bool = True,
) -> list[AggSpec]:
    """``fn`` over the last or the previous n months, such as ``x_PRM_U3M`` or ``x_SUM_P6M``.

    The label is left out for one month. ``plain_twelve`` names the last twelve months ``U12``.
    """
    columns = list(columns)
    specs = []
    for n in map(int, months):
        if previous and n not in PREVIOUS_BLOCKS:
            raise ValueError(f"there is no previous block of {n} months; use one of {sorted(PREVIOUS_BLOCKS)}")
        lo, hi = PREVIOUS_BLOCKS[n] if previous else (1, n)
        end = f"P{n}M" if previous else (f"U{n}" if n == 12 and plain_twelve else f"U{n}M")
        middle = "" if n == 1 else f"_{label}"
        specs += [AggSpec(f"{c}{middle}_{end}", fn, c, lo, hi) for c in columns]
    return specs


def mean(columns, months, label="PRM", previous=False, plain_twelve=True) -> list[AggSpec]:
    return block("avg", columns, months, label, previous, plain_twelve)


def total(columns, months, label="SUM", previous=False, plain_twelve=True) -> list[AggSpec]:
    return block("sum", columns, months, label, previous, plain_twelve)


def maximum(columns, months, label="MAX", previous=False, plain_twelve=True) -> list[AggSpec]:
    return block("max", columns, months, label, previous, plain_twelve)


def minimum(columns: Iterable[str], months: Iterable[int | str]) -> list[AggSpec]:
    columns = list(columns)
    return [AggSpec(f"{c}_MIN_U{n}M", "min", c, 1, int(n)) for n in months for c in columns]


def _edge(
    columns: Iterable[str], months: Iterable[int | str], predicate, tags: tuple[str, str, str, str], tail: str,
    first: bool, ordinal: bool, period: str,
) -> list[AggSpec]:
    """First or last month, or its ordinal, among the months that satisfy the predicate."""
    # smallest month = first; smallest ordinal = latest
    columns = list(columns)
    fn = "min" if first != ordinal else "max"
    tag = tags[(0 if first else 1) + (2 if ordinal else 0)]
    value = ORDINAL if ordinal else period
    return [
        AggSpec(f"{c}_{tag}_{tail}U{n}M", fn, value, 1, int(n), predicate(c)) for n in months for c in columns
    ]


def month_above(
    columns, months, limit: float = 0, first: bool = True, ordinal: bool = False, period: str = KEYS.period
) -> list[AggSpec]:
    """Month (or ordinal) of the first or last value above ``limit``."""
    tags = ("PRI", "U", "DS_PRI", "DS_U")
    return _edge(columns, months, lambda c: f"{c} > {limit}", tags, f"{limit}_", first, ordinal, period)


def month_above_column(
    columns, months, other: str, first: bool = True, ordinal: bool = False, period: str = KEYS.period
) -> list[AggSpec]:
    """As ``month_above``, with the limit taken from another column."""
    tags = ("PRI3", "U3", "DS_PRI", "DS_U")
    return _edge(columns, months, lambda c: f"{c} > {other}", tags, "", first, ordinal, period)


def month_both_above(
    columns, months, other: str, limit: float = 0, other_limit: float = 0, first: bool = True,
    ordinal: bool = False, period: str = KEYS.period,
) -> list[AggSpec]:
    """As ``month_above``, with a second column above its own limit; NULL counts as zero."""
    tags = ("PRI1", "U1", "DS_PRI1", "DS_U1")
    both = lambda c: f"coalesce({c}, 0) > {limit} and coalesce({other}, 0) > {other_limit}"
    return _edge(columns, months, both, tags, f"{limit}_{other_limit}_", first, ordinal, period)


def _indicator(columns, months, fn, test, known, name) -> list[AggSpec]:
    columns = list(columns)
    value = lambda c: f"case when {test(c)} then 1 when {known(c)} then 0 end"
    return [AggSpec(name(c, n), fn, value(c), 1, int(n)) for n in months for c in columns]


def indicator(columns, months, fn: str, tag: str, limit: float = 0) -> list[AggSpec]:
    """``fn`` over 1 (value above ``limit``), 0 (any other value) and NULL (no value)."""
    return _indicator(
        columns, months, fn,
        lambda c: f"coalesce({c}, 0) > {limit}", lambda c: f"{c} is not null",
        lambda c, n: f"{c}{tag}{limit}_U{n}M",
    )


def indicator_vs_column(columns, months, fn: str, tag: str, other: str) -> list[AggSpec]:
    """Indicator "above another column"; 0 only where both have a value."""
    return _indicator(
        columns, months, fn,
        lambda c: f"coalesce({c}, 0) > coalesce({other}, 0)", lambda c: f"{c} is not null and {other} is not null",
        lambda c, n: f"{c}{tag}U{n}M",
    )


def indicator_both(
    columns, months, fn: str, tag: str, other: str, limit: float = 0, other_limit: float = 0
) -> list[AggSpec]:
    """Indicator "this and another column above their limits"; 0 only where both have a value."""
    return _indicator(
        columns, months, fn,
        lambda c: f"coalesce({c}, 0) > {limit} and coalesce({other}, 0) > {other_limit}",
        lambda c: f"{c} is not null and {other} is not null",
        lambda c, n: f"{c}{tag}{limit}_{other_limit}_U{n}M",
    )


def earliest_opening(column: str, months: int | str, limit: float = 0) -> list[AggSpec]:
    """Smallest value above ``limit`` in the horizon; rows outside count as the never-opened value.

    The output name is fixed, so this takes one column and one horizon.
    """
    return [
        AggSpec(OPENING_NAME, "min", column, 1, int(months), f"{column} > {limit}", otherwise=str(NO_OPENING))
    ]
