"""From a monthly panel and an identity map to the wide, typed feature matrix."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.config import CTD, FLG, HORIZONS, LOOK_BACK, MTO, TKT, Channel, FeatureSpec
from featmatrix.functions.naming import feature_suffix, frequency_suffix
from featmatrix.functions.periods import audit_cols, shift_month
from featmatrix.operators.densify import distinct_periods
from featmatrix.operators.derive import GROWTH, exactly_sql, growth_sql, min_gate_sql, party_key
from featmatrix.operators.identity import analysis_bits, consolidate, resolve_identity
from featmatrix.operators.trailing import (
    BlockExpressions,
    FeatureGroup,
    expand_groups,
    expand_specs,
    frame_rows,
    month_slots,
    present_ordinals,
)
from featmatrix.plans.sliding import SPAN_MONTHS, gather_states, month_states, slide
from featmatrix.sources.tables import read_months

_TRAILING = tuple(1 - n for n in HORIZONS)

# Frames per family: (function, starts, end). The previous blocks are months 7-12, 4-6 and 2.
_MEANS = ("avg", (0, *_TRAILING), 0)
_PREVIOUS = (("avg", (-11,), -6), ("avg", (-5,), -3), ("avg", (-1,), -1))
_MAXIMA = ("max", _TRAILING, 0)
_MINIMA = ("min", _TRAILING, 0)
_SUMS = ("sum", _TRAILING, 0)
_LATEST = ("avg", (0,), 0)

# Measure classes in the order of the slot arrays.
SLOT_ORDER = (MTO, TKT, CTD, FLG)


def _families(channel: Channel, cls: str) -> list[tuple[str, tuple[int, ...], int]]:
    if cls == FLG:
        return [_LATEST, _MAXIMA, _SUMS]
    previous = _PREVIOUS if cls in channel.with_previous else ()
    return [_MEANS, *previous, _MAXIMA, _MINIMA]


def matrix_specs(channel: Channel) -> list[FeatureSpec]:
    """Every trailing feature of the channel, in output order: flags, then block by block."""
    blocks = ((FLG,), *channel.blocks)
    return [
        spec
        for block in blocks
        for fn, starts, end in _families(channel, block[0])
        for spec in expand_specs(channel.names(*block), (fn,), starts, (end,))
    ]


def _growth_classes(channel: Channel) -> list[str]:
    return [c for c in (MTO, TKT, CTD) if c in channel.with_previous]


def feature_types(channel: Channel) -> dict[str, str]:
    """Feature name -> SQL type, in output order."""
    types = {s.name: "int" if f"_{FLG}_" in s.name else "double" for s in matrix_specs(channel)}
    counts = channel.names(CTD)
    types.update({f"{m}_REC": "double" for m in counts})
    types.update({f"{m}_{frequency_suffix(n)}": channel.frequency_type for n in HORIZONS for m in counts})
    types.update({f"{m}_{g}": "double" for g in GROWTH for c in _growth_classes(channel) for m in channel.names(c)})
    return types


def class_template(channel: Channel, cls: str, ordinals: Sequence[int]) -> FeatureGroup:
    """Template of one measure class: trailing aggregates, their derived rules, and the final types."""
    sql = BlockExpressions()
    n_rows = len(ordinals)
    frames = [
        (feature_suffix(fn, a, end), fn, 1 - a, frame_rows(a, end, n_rows))
        for fn, starts, end in _families(channel, cls)
        for a in starts
    ]
    active = {n: tuple(r for r, o in enumerate(ordinals) if o <= n) for n in HORIZONS} if cls == CTD else {}
    for _, fn, _, rows in frames:
        sql.want("sum" if fn == "avg" else fn, rows)
    for rows in active.values():
        sql.want("count", rows)

    raw = {suffix: sql.aggregate(fn, rows) for suffix, fn, _, rows in frames}
    frequency = {n: sql.frame("count", rows) for n, rows in active.items()}
    out = dict(raw)
    for suffix, fn, n, _ in frames:
        if cls == FLG:
            whole = f"cast({raw[suffix]} as int)"
            exact = fn == "sum" or (suffix == "U1M" and channel.strict_flag_u1m)
            out[suffix] = exactly_sql(whole, n) if exact else whole
        elif cls == CTD and fn == "min":
            out[suffix] = min_gate_sql(raw[suffix], frequency[n], n)
    if cls == CTD:
        out["REC"] = f"cast({sql.latest_active(ordinals)} as double)"
        out.update({frequency_suffix(n): f"cast({e} as {channel.frequency_type})" for n, e in frequency.items()})
    if cls in channel.with_previous:
        out.update({g: growth_sql(raw[u], raw[p]) for g, (u, p) in GROWTH.items()})
    return FeatureGroup(tuple(channel.names(cls)), sql.blocks, out)


def consolidated_panel(
    concept: DataFrame, identity: DataFrame, channel: Channel, month: int,
    duplicates: str = "raise", broadcast_rows: int | None = None,
) -> DataFrame:
    """Window rows of one analysis month, re-keyed and consolidated per customer and month."""
    keys = channel.keys
    measures = [m.name for m in channel.measures]
    columns = [keys.period, *keys.ids, *measures]
    panel = read_months(concept, shift_month(month, -LOOK_BACK), month, columns, keys.period)
    snapshot = identity.where(F.col(keys.period) == int(month)).select(keys.client, keys.party, keys.concept)
    resolved = resolve_identity(panel, snapshot, channel.trim, duplicates, broadcast_rows, keys)
    return consolidate(resolved, measures, (keys.period, *keys.ids))


def feature_groups(channel: Channel, ordinals: Sequence[int]) -> list[FeatureGroup]:
    return [class_template(channel, c, ordinals) for c in SLOT_ORDER if channel.names(c)]


def slot_measures(channel: Channel) -> list[str]:
    """Measures in the order of the slot arrays."""
    return channel.names(*SLOT_ORDER)


def expand_slots(slots: DataFrame, channel: Channel, ordinals: Sequence[int], month: int | None = None) -> DataFrame:
    """Feature columns of month slots; ``month`` is the analysis month, without it the rows carry it as a column."""
    keys = channel.keys
    by = keys.ids if month is not None else keys.matrix
    packed, paths = expand_groups(slots, feature_groups(channel, ordinals), by, len(ordinals))
    first = keys.analysis if month is None else f"{month} as {keys.analysis}"
    return packed.selectExpr(first, *keys.ids, *(f"{paths[f]} as {f.lower()}" for f in feature_types(channel)))


def expand_matrix(
    consolidated: DataFrame, channel: Channel, ordinals: Sequence[int], month: int, partitions: int | None = None
) -> DataFrame:
    """Feature columns of the consolidated rows of one analysis month."""
    keys = channel.keys
    slots = month_slots(consolidated, slot_measures(channel), keys.ids, ordinals, F.lit(month), keys.period, partitions)
    return expand_slots(slots, channel, ordinals, month)


def project_matrix(
    features: DataFrame, channel: Channel, run_date: date | str, ts: datetime | None = None
) -> DataFrame:
    """Final layout: ids and their keys, features, audit columns, month partition."""
    keys = channel.keys
    party = F.trim(keys.party) if channel.trim_output_party else F.col(keys.party)
    heads = features.select(
        F.col(keys.client).cast("string").alias(keys.client),
        F.col(keys.client).alias("codclaveunicocli"),
        party_key(F.col(keys.party)).alias("codclavepartycli"),
        party.cast("string").alias(keys.party),
        F.col(keys.analysis).cast("int").alias(keys.analysis),
        F.expr(f"* except ({', '.join(keys.matrix)})"),
    )
    return audit_cols(heads, run_date, ts).withColumn(keys.period, F.col(keys.analysis).cast("int"))


def build_features(
    concept: DataFrame,
    identity: DataFrame,
    channel: Channel,
    months: Sequence[int | str],
    periods: str = "present",
    drop_null_keys: bool = True,
    duplicates: str = "raise",
    broadcast_rows: int | None = None,
    partitions: int | None = None,
    present: Sequence[int] | None = None,
) -> DataFrame:
    """Keys and feature columns for the given analysis months, one row per customer and month.

    Several months slide over one set of month states; a single month takes its twelve months as they are.
    Customers without an identity in the snapshot (NULL ids) are left out unless ``drop_null_keys`` is
    off. The months that count as present are those of the concept table, before that filter; a run over many
    months hands them down as ``present``.
    """
    keys = channel.keys
    codes = sorted({int(m) for m in months}, reverse=True)
    window = read_months(concept, shift_month(codes[-1], -LOOK_BACK), codes[0], None, keys.period)
    if present is None:
        present = distinct_periods(window, keys.period) if periods == "present" else ()
    named = F.col(keys.client).isNotNull() & F.col(keys.party).isNotNull()
    kept = (lambda rows: rows.where(named)) if drop_null_keys else (lambda rows: rows)
    if len(codes) == 1:
        ordinals = present_ordinals(present, codes[0], periods)
        rows = kept(consolidated_panel(concept, identity, channel, codes[0], duplicates, broadcast_rows))
        return expand_matrix(rows, channel, ordinals, codes[0], partitions)

    parts = []
    for at in range(0, len(codes), SPAN_MONTHS):
        span = codes[at : at + SPAN_MONTHS]
        states = kept(month_states(concept, identity, channel, span, duplicates, broadcast_rows))
        parts.append(features_of_states(states, channel, span, span, present, periods, partitions))
    return reduce(DataFrame.unionByName, parts)


def features_of_states(
    states: DataFrame, channel: Channel, months: Sequence[int], span: Sequence[int], present: Sequence[int],
    periods: str = "present", partitions: int | None = None, stored: bool = False,
) -> DataFrame:
    """Feature columns of some analysis months from the month states of a span of them.

    ``stored`` states lie in buckets by the ids, so each further month is a scan and no shuffle.
    """
    measures, bits = slot_measures(channel), analysis_bits(span)
    gathered = gather_states(states, channel, measures, months, partitions, stored)
    by_pattern: dict[tuple[int, ...], list[int]] = {}
    for m in months:
        by_pattern.setdefault(present_ordinals(present, m, periods), []).append(m)
    parts = [
        expand_slots(slide(gathered, channel, measures, ordinals, group, bits), channel, ordinals)
        for ordinals, group in by_pattern.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def build_matrix(
    concept: DataFrame, identity: DataFrame, channel: Channel, months: Sequence[int | str],
    run_date: date | str, ts: datetime | None = None, **options,
) -> DataFrame:
    """The typed matrix of the given analysis months, ready to write."""
    return project_matrix(build_features(concept, identity, channel, months, **options), channel, run_date, ts)
