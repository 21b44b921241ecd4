"""Many analysis months from one set of month states.

A state is what one identity has in one month: sums, maxima and minima, consolidated once, together with the set of
analysis months that see it under this identity. Twelve-month windows of successive analysis months overlap in all
but a month, so the states of a customer are brought together once and every analysis month takes its own twelve of them
from the row; nothing is copied per analysis month before or in a shuffle. Where an identity changed between two
snapshots a month has several states, which merge by the rule of each measure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmatrix.config import LOOK_BACK, Channel
from featmatrix.functions.periods import month_index_col, shift_month
from featmatrix.operators.identity import analysis_bits, consolidate, consolidation_rule, resolve_spans
from featmatrix.sources.tables import read_months

ANALYSES = "analyses"

#: Analysis months of one plan; a longer backfill is cut into several.
SPAN_MONTHS = 24

# How two states of one month merge; NULL stands for no value.
_RULES = {"sum": "coalesce(p + q, p, q)", "max": "greatest(p, q)", "min": "least(p, q)"}


def _window_bits(period: Column, bits: dict[int, int]) -> Column:
    """The analysis months whose window holds the month, as bits."""
    index = month_index_col(period)
    out = F.lit(0).cast("long")
    for month, bit in bits.items():
        inside = (month_index_col(F.lit(month)) - index).between(0, LOOK_BACK)
        out = out.bitwiseOR(F.when(inside, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def month_states(
    concept: DataFrame, identity: DataFrame, channel: Channel, months: Sequence[int],
    duplicates: str = "raise", broadcast_rows: int | None = None,
) -> DataFrame:
    """One row per identity, month and set of analysis months (``analyses``, as bits by ascending month)."""
    keys = channel.keys
    codes = sorted({int(m) for m in months})
    bits = analysis_bits(codes)
    measures = [m.name for m in channel.measures]
    panel = read_months(
        concept, shift_month(codes[0], -LOOK_BACK), codes[-1], [keys.period, *keys.ids, *measures], keys.period
    )
    snapshots = identity.where(F.col(keys.period).isin(codes)).select(
        F.col(keys.period).cast("int").alias(keys.analysis), keys.client, keys.party, keys.concept
    )
    window = _window_bits(F.col(keys.period), bits)
    spans = resolve_spans(
        panel, snapshots, bits, window, channel.trim, keys.analysis, duplicates, broadcast_rows, keys, ANALYSES
    )
    return consolidate(spans, measures, (keys.period, ANALYSES, *keys.ids))


def gather_states(
    states: DataFrame, channel: Channel, measures: Sequence[str], months: Sequence[int], partitions: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """One row per identity: for every month ``m<code>`` of the windows, the states of that month.

    A month has one state unless the identity changed between snapshots, so a row stays as small as its months.
    States that are ``stored`` in buckets by the ids are gathered where they lie.
    """
    keys = channel.keys
    if partitions is None:
        partitions = int(states.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = ", ".join(f"cast(`{m}` as double)" for m in measures)
    rows = states.select(*keys.ids, F.col(keys.period).cast("int").alias("_month"), ANALYSES, F.expr(f"array({values})").alias("_values"))
    wanted = sorted({int(shift_month(m, -back)) for m in months for back in range(LOOK_BACK + 1)})
    state = f"struct({ANALYSES} as a, _values as v)"
    slots = (F.expr(f"collect_list({state}) filter (where _month = {code})").alias(f"m{code}") for code in wanted)
    together = rows if stored else rows.repartition(partitions, *keys.ids)
    return together.groupBy(*keys.ids).agg(*slots)


def _merge_sql(measures: Sequence[str]) -> str:
    """Values of two states, element by element; neighbouring measures of one rule are merged together."""
    runs, at = [], 1
    for rule, group in groupby(measures, consolidation_rule):
        size = len(list(group))
        runs.append(f"zip_with(slice(s, {at}, {size}), slice(x.v, {at}, {size}), (p, q) -> {_RULES[rule]})")
        at += size
    return f"concat({', '.join(runs)})"


def slide(
    gathered: DataFrame, channel: Channel, measures: Sequence[str], ordinals: Sequence[int], months: Sequence[int],
    bits: Mapping[int, int],
) -> DataFrame:
    """Slots ``s0, s1, ...`` of every customer and analysis month; all the months have the same present months.

    A customer without a state in the window of an analysis month has no row for it.
    """
    keys = channel.keys
    merge = _merge_sql(measures)

    def value(code: int, bit: int) -> str:
        """A month as one analysis month sees it, NULL without a state."""
        seen = f"filter(m{code}, x -> x.a & {bit}L <> 0)"
        return f"aggregate({seen}, cast(null as array<double>), (s, x) -> if(s is null, x.v, {merge}))"

    windows = []
    for month in months:
        codes = (int(shift_month(month, 1 - o)) for o in ordinals)
        cells = ", ".join(f"'s{r}', {value(code, bits[month])}" for r, code in enumerate(codes))
        windows.append(f"named_struct('analysis', {month}, {cells})")
    slots = [f"s{r}" for r in range(len(ordinals))]
    each = gathered.select(*keys.ids, F.expr(f"explode(array({', '.join(windows)})) as _w"))
    each = each.select(F.col("_w.analysis").alias(keys.analysis), *keys.ids, *(f"_w.{s}" for s in slots))
    zeros = f"array_repeat(0D, {len(measures)})"
    filled = (F.expr(f"coalesce(transform({s}, v -> coalesce(v, 0D)), {zeros})").alias(s) for s in slots)
    return each.where(F.coalesce(*slots).isNotNull()).select(*keys.matrix, *filled)
