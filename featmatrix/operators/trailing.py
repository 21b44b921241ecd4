"""Trailing aggregates of a monthly panel: the heart of the feature matrix.

A feature is an aggregate of one measure over a run of *rows* before the analysis month, where a row
is a month that is present somewhere in the data (``periods='present'``) or any calendar month
(``periods='calendar'``). Months without activity count as zero: they lower a mean, and bring minimum
and maximum to zero. Only the analysis-month row of each customer is wanted, so no window over a dense
grid is needed:

1. one shuffle brings the (at most twelve) rows of a customer together; each row travels as one
   compact array of doubles, and an aggregate puts the arrays into one slot per month, zeros for gaps;
2. the slots are zipped to one struct of month values per measure;
3. a ``transform`` per group of like measures computes block sums, minima and maxima, and from these
   the features; overlapping frames share their blocks;
4. the features are unpacked to columns.

Rows are streamed customer by customer, the plan has one expression tree per measure group and not one
per feature, and nothing is pivoted. ``trailing_by_window`` is the direct form (grid and windows), kept
as the slow reference for tests.

A customer with two rows in one month is an error, raised by the aggregate that builds the slots. Rows outside the
window are ignored, so a customer seen only there gets no row.

Known differences from a text-concatenating implementation: a frame without any present month makes
only its own feature NULL, and NULL customer keys are kept unless dropped beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmatrix.config import KEYS, FeatureSpec
from featmatrix.functions.naming import feature_name, feature_suffix
from featmatrix.functions.periods import month_index_col, month_ordinal, shift_month
from featmatrix.operators.densify import at_analysis_month, densify, distinct_periods

FUNCTIONS = ("avg", "sum", "min", "max")


def expand_specs(
    measures: Sequence[str], fns: Sequence[str], starts: Sequence[int], ends: Sequence[int], style: str = "all_of_n"
) -> list[FeatureSpec]:
    """Product of measures, functions and frames, named by rule."""
    return [
        FeatureSpec(feature_name(m, f, a, b, style), f, m, a, b)
        for m in measures
        for f in fns
        for a in starts
        for b in ends
    ]


def present_ordinals(present: Sequence[int], month: int | str, periods: str = "present", back: int = 11) -> tuple[int, ...]:
    """Month ordinals (1 = analysis month) that count as rows, newest first."""
    if periods == "calendar":
        return tuple(range(1, back + 2))
    if periods != "present":
        raise ValueError(f"periods must be present or calendar, not {periods!r}")
    first = int(shift_month(month, -back))
    ordinals = sorted(month_ordinal(month, m) for m in present if first <= int(m) <= int(month))
    if not ordinals or ordinals[0] != 1:
        raise ValueError(f"no rows for analysis month {month}")
    return tuple(ordinals)


def frame_rows(start: int, end: int, n_rows: int) -> tuple[int, ...]:
    """Row numbers (0 = analysis month) of frame ``start..end`` that exist among ``n_rows`` rows."""
    return tuple(r for r in range(-end, -start + 1) if r < n_rows)


class BlockExpressions:
    """SQL for features over the month values ``x.s0, x.s1, ...`` of one measure, in two levels.

    The first level computes blocks of months (``blocks``), the second combines blocks. Frames asked
    for with ``frame`` must be registered with ``want`` first, so that overlapping frames share blocks.
    """

    _COMBINE: Mapping[str, Callable[[list[str]], str]] = {
        "sum": lambda xs: "(" + " + ".join(xs) + ")",
        "count": lambda xs: "(" + " + ".join(xs) + ")",
        "max": lambda xs: f"greatest({', '.join(xs)})" if len(xs) > 1 else xs[0],
        "min": lambda xs: f"least({', '.join(xs)})" if len(xs) > 1 else xs[0],
    }

    def __init__(self) -> None:
        self._wanted: dict[str, set[tuple[int, ...]]] = {}
        self.blocks: dict[str, str] = {}

    def want(self, kind: str, rows: tuple[int, ...]) -> None:
        self._wanted.setdefault(kind, set()).add(rows)

    def _parts(self, kind: str, rows: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Split the rows where any wanted frame of this kind begins or ends."""
        groups: dict[tuple[tuple[int, ...], ...], list[int]] = {}
        for r in rows:
            signature = tuple(sorted(w for w in self._wanted[kind] if r in w))
            groups.setdefault(signature, []).append(r)
        return [tuple(g) for g in groups.values()]

    def _block(self, kind: str, rows: tuple[int, ...]) -> str:
        if kind == "count":
            name, parts = f"c{rows[0]}_{rows[-1]}", [f"if(x.s{r} > 0, 1, 0)" for r in rows]
        elif len(rows) == 1:
            name, parts = f"v{rows[0]}", [f"x.s{rows[0]}"]
        else:
            name, parts = f"{kind}{rows[0]}_{rows[-1]}", [f"x.s{r}" for r in rows]
        self.blocks[name] = self._COMBINE[kind](parts)
        return f"y.{name}"

    def frame(self, kind: str, rows: tuple[int, ...]) -> str:
        if not rows:
            return "cast(null as double)" if kind != "count" else "0"
        return self._COMBINE[kind]([self._block(kind, p) for p in self._parts(kind, rows)])

    def aggregate(self, fn: str, rows: tuple[int, ...]) -> str:
        if fn == "avg":
            return f"({self.frame('sum', rows)} / {len(rows)})" if rows else "cast(null as double)"
        return self.frame(fn, rows)

    def latest_active(self, ordinals: Sequence[int]) -> str:
        """Ordinal of the newest month with a value above zero, 0 if there is none."""
        cases = " ".join(f"when x.s{r} > 0 then {o}" for r, o in enumerate(ordinals))
        self.blocks["latest"] = f"case {cases} else 0 end"
        return "y.latest"


@dataclass(frozen=True)
class FeatureGroup:
    """Measures that share a template; ``features`` maps suffixes to second-level SQL, ``blocks`` is the first level."""

    measures: tuple[str, ...]
    blocks: Mapping[str, str]
    features: Mapping[str, str]


def _struct(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in fields.items()) + ")"


def month_slots(
    panel: DataFrame, measures: Sequence[str], keys: Sequence[str], ordinals: Sequence[int],
    analysis: Column, period: str = KEYS.period, partitions: int | None = None,
) -> DataFrame:
    """One row per key with one array of measure values per month row ``s0, s1, ...``.

    ``analysis`` is the analysis month: a literal, or a column that is also one of the keys. The rows go
    to ``partitions`` tasks (``spark.sql.shuffle.partitions`` by default). The number is fixed because the
    expansion behind this exchange makes many times its input bytes, sparse months compress well, and
    adaptive coalescing, which sees only the compressed input, would leave a few overloaded tasks.
    """
    if partitions is None:
        partitions = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = ", ".join(f"coalesce(cast(`{m}` as double), 0D)" for m in measures)
    ordinal = month_index_col(analysis) - month_index_col(F.col(period)) + 1
    rows = panel.select(*keys, ordinal.alias("_ordinal"), F.expr(f"array({values})").alias("_values"))
    # The explicit exchange comes first so that the aggregate, which cannot shrink one-row-per-month
    # input, runs once after it instead of also sorting before it.
    inside = rows.where(F.col("_ordinal").isin([int(o) for o in ordinals]))

    def slot(o: int) -> Column:
        found = f"any_value(_values) filter (where _ordinal = {o})"
        message = f"a customer has several rows in month {o} of its window"
        return F.expr(f"if(count_if(_ordinal = {o}) > 1, cast(raise_error('{message}') as array<double>), {found})")

    slotted = inside.repartition(partitions, *keys).groupBy(*keys).agg(
        *(slot(o).alias(f"s{r}") for r, o in enumerate(ordinals))
    )
    zeros = f"array_repeat(0D, {len(measures)})"
    return slotted.select(*keys, *(F.expr(f"coalesce(s{r}, {zeros})").alias(f"s{r}") for r in range(len(ordinals))))


def expand_groups(
    slots: DataFrame, groups: Sequence[FeatureGroup], keys: Sequence[str], n_rows: int
) -> tuple[DataFrame, dict[str, str]]:
    """Packed features: one array of structs per group, and the SQL path of every feature name."""
    zipped = slots.select(*keys, F.expr(f"arrays_zip({', '.join(f's{r}' for r in range(n_rows))})").alias("_months"))
    packed, paths, offset = [], {}, 1
    for g, group in enumerate(groups):
        part = f"slice(_months, {offset}, {len(group.measures)})"
        blocks = f"transform({part}, x -> {_struct(group.blocks)})"
        packed.append(F.expr(f"transform({blocks}, y -> {_struct(group.features)})").alias(f"_g{g}"))
        for i, measure in enumerate(group.measures):
            for suffix in group.features:
                paths[f"{measure}_{suffix}"] = f"_g{g}[{i}].{suffix}"
        offset += len(group.measures)
    return zipped.select(*keys, *packed), paths


def trailing_matrix(
    panel: DataFrame,
    specs: Sequence[FeatureSpec],
    month: int | str | None = None,
    keys: Sequence[str] = KEYS.matrix,
    period: str = KEYS.period,
    analysis: str = KEYS.analysis,
    periods: str = "present",
    present: Sequence[int] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Trailing features, one row per analysis month and customer of its window.

    ``panel`` has one row per key and month, repeated rows raise. With ``month`` only the rows of that analysis
    month are used; otherwise every analysis month of the data is computed, those with the same present months in
    one plan.
    """
    for s in specs:
        if s.fn not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {s.fn!r}")
    if present is None and periods == "present":
        present = distinct_periods(panel, period)
    if month is not None:
        months = [int(month)]
        if analysis in panel.columns:
            panel = panel.where(F.col(analysis) == int(month))
    else:
        months = distinct_periods(panel, analysis)
        if not months:
            raise ValueError("the panel has no analysis month")
    by_pattern: dict[tuple[int, ...], list[int]] = {}
    for m in months:
        by_pattern.setdefault(present_ordinals(present or (), m, periods), []).append(m)
    parts = []
    for ordinals, group in by_pattern.items():
        rows = panel if len(months) == 1 else panel.where(F.col(analysis).isin(group))
        parts.append(_one_pattern(rows, specs, group, keys, period, analysis, ordinals, partitions))
    return reduce(DataFrame.unionByName, parts)


def _one_pattern(
    panel: DataFrame, specs: Sequence[FeatureSpec], months: Sequence[int], keys: Sequence[str], period: str,
    analysis: str, ordinals: Sequence[int], partitions: int | None,
) -> DataFrame:
    """Features of analysis months whose windows hold the same present months."""
    templates: dict[str, list[FeatureSpec]] = {}
    for s in specs:
        templates.setdefault(s.measure, []).append(s)
    by_template: dict[tuple, list[str]] = {}
    for measure, wanted in templates.items():
        by_template.setdefault(tuple((s.fn, s.start, s.end) for s in wanted), []).append(measure)
    groups, renames = [], {}
    for template, measures in by_template.items():
        sql = BlockExpressions()
        frames = {(f, a, b): frame_rows(a, b, len(ordinals)) for f, a, b in template}
        for (f, _, _), rows in frames.items():
            sql.want("sum" if f == "avg" else f, rows)
        features = {f"f{i}": sql.aggregate(key[0], frames[key]) for i, key in enumerate(template)}
        groups.append(FeatureGroup(tuple(measures), sql.blocks, features))
        for m in measures:
            renames.update({s.name: f"{m}_f{i}" for i, s in enumerate(templates[m])})
    ordered = [m for g in groups for m in g.measures]
    # a single analysis month is a constant: grouping by it would only widen the exchange
    single = months[0] if len(months) == 1 else None
    ids = [k for k in keys if k != analysis]
    by = ids if single is not None else [analysis, *ids]
    month = F.lit(single) if single is not None else F.col(analysis)
    slots = month_slots(panel, ordered, by, ordinals, month, period, partitions)
    packed, paths = expand_groups(slots, groups, by, len(ordinals))
    out_keys = [f"{single} as {analysis}" if k == analysis and single is not None else k for k in keys]
    return packed.selectExpr(*out_keys, *(f"{paths[renames[s.name]]} as `{s.name}`" for s in specs))


def trailing_by_window(
    panel: DataFrame,
    specs: Sequence[FeatureSpec],
    keys: Sequence[str] = KEYS.matrix,
    period: str = KEYS.period,
    analysis: str = KEYS.analysis,
    months: Sequence[int] | None = None,
) -> DataFrame:
    """The same features by row windows over the dense grid: slow, for small data and as a cross-check."""
    dense = densify(panel, keys, period, 0, months)
    window = Window.partitionBy(*keys).orderBy(period)
    columns = [getattr(F, s.fn)(s.measure).over(window.rowsBetween(s.start, s.end)).alias(s.name) for s in specs]
    return at_analysis_month(dense.select(*keys, period, *columns), period, analysis).drop(period)


__all__ = [
    "BlockExpressions",
    "FeatureGroup",
    "expand_groups",
    "expand_specs",
    "feature_suffix",
    "frame_rows",
    "month_slots",
    "present_ordinals",
    "trailing_by_window",
    "trailing_matrix",
]
