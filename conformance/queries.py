"""Registry of queries over the sample tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance import adapter as A
from conformance import sql as S
from conformance.adapter import BACKFILL, MONTH
from featmatrix.config import Namespace
from featmatrix.functions import periods as P
from featmatrix.operators import columns as C
from featmatrix.operators import library as L
from featmatrix.operators import parity as PAR
from featmatrix.operators.densify import assert_has_month, at_analysis_month, densify, distinct_periods
from featmatrix.operators.derive import exactly_n, growth, min_gate, party_key
from featmatrix.operators.digest_tree import differing_nodes, tree_cell_diff, trees
from featmatrix.operators.identity import base_client, consolidate, resolve_identity, with_lookup_key
from featmatrix.operators.joins import LOOKUP_KEY, combine_blocks
from featmatrix.operators.metadata import meta_find, meta_groups, meta_lengths, meta_pairs
from featmatrix.operators.sketches import (
    difference_sketches, error_distribution, key_counts, key_sketches, merge_difference_sketches, merge_key_sketches,
)
from featmatrix.operators.trailing import expand_specs, trailing_by_window, trailing_matrix
from featmatrix.plans.channels import agent_channel, atm_channel, pos_channel
from featmatrix.plans.matrix import build_matrix, features_of_states
from featmatrix.plans.pipeline import SESSION_OPTIONS, RunConfig, run_backfill
from featmatrix.plans.refresh import refresh_month
from featmatrix.plans.sliding import month_states
from featmatrix.sources import sinks
from featmatrix.sources.tables import listed_periods, measure_rows, measures_for, read_identity, read_months, read_partition, read_run_params, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RUN_DATE = "2001-01-05"
IDS = "codmesanalisis, codunicocli, codinternocomputacional"
H = (3, 6, 9, 12)
OFFSETS = (0, -2, -5, -8, -11)


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# Sources


@query(
    "src_months_scan",
    f"with {S.panel()} select codmes, codunicocli, mto_tot, ctd_tot from panel where codmes between {S.FIRST} and {MONTH}",
)
def src_months_scan(spark, sf):
    panel = A.orders_panel(spark, sf, months=(S.FIRST, MONTH))
    return read_months(panel, S.FIRST, MONTH, ["codmes", "codunicocli", "mto_tot", "ctd_tot"])


@query(
    "src_run_params",
    f"with {S.ORDERS} select cast(min(codmes) as varchar) as first_month, cast(max(codmes) as varchar) as last_month from orders_m",
)
def src_run_params(spark, sf):
    return spark.createDataFrame([read_run_params(A.run_params(spark, sf))], "first_month string, last_month string")


GROUPS_SQL = """g as (select 'P' || (p_size % 3 + 1) as nomgrupo,
  case when p_partkey % 5 = 0 then 'hm_concepto_' || lower(p_type) || ' ' else 'HM_CONCEPTO_' || p_type end as nomtablaconcepto,
  'c_' || p_partkey as nomconcepto from part)"""


@query(
    "src_measures_for",
    f"with {GROUPS_SQL} select upper(nomconcepto) as nomconcepto from g where nomgrupo = 'P2' and upper(trim(nomtablaconcepto)) = 'HM_CONCEPTO_ECONOMY'",
)
def src_measures_for(spark, sf):
    return measure_rows(A.measure_groups(spark, sf), "P2", "hm_concepto_economy")


@query(
    "src_identity",
    f"with {S.identity(BACKFILL)} select codmes, codunicocli, codinternocomputacional, codinternocomputacionalconcepto from ident where codmes = {MONTH}",
)
def src_identity(spark, sf):
    return read_identity(A.identity_map(spark, sf, BACKFILL), MONTH)


# Periods


def _prior(column: str, n: int) -> str:
    i = f"({column} // 100 * 12 + {column} % 100 - 1 - {n})"
    return f"cast({i} // 12 * 100 + {i} % 12 + 1 as int)"


@query(
    "per_shift_month",
    f"with {S.ORDERS} select o_orderkey, codmes, {_prior('codmes', 11)} as prior_month from orders_m",
)
def per_shift_month(spark, sf):
    rows = A.monthly_orders(spark, sf)
    return rows.select("o_orderkey", "codmes", P.shift_month_col(F.col("codmes"), -11).alias("prior_month"))


def _windows_sql(back: int) -> str:
    return f"""with {S.ORDERS}, span as (select min(codmes) as a, max(codmes) as b from orders_m),
m as (select unnest(range(a // 100 * 12 + a % 100 - 1, b // 100 * 12 + b % 100)) as i from span)
select cast(i // 12 * 100 + i % 12 + 1 as int) as codmes,
       cast((i - {back}) // 12 * 100 + (i - {back}) % 12 + 1 as int) as first_month from m"""


@query("per_analysis_windows", _windows_sql(11))
def per_analysis_windows(spark, sf):
    return P.analysis_windows_df(A.run_params(spark, sf), "codmesinicio", "codmesfin")


@query("per_analysis_windows_24", _windows_sql(23))
def per_analysis_windows_24(spark, sf):
    return P.analysis_windows_df(A.run_params(spark, sf), "codmesinicio", "codmesfin", back=23)


@query(
    "per_process_month_eom",
    f"""with {S.ORDERS} select o.o_orderkey, case when last_day(o.o_orderdate) = cast(o.o_orderdate as date) then m.codmes
else {_prior('m.codmes', 1)} end as process_month from orders o join orders_m m using (o_orderkey)""",
)
def per_process_month_eom(spark, sf):
    day = P.process_month_end_col(F.col("o_orderdate"))
    return A.table(spark, sf, "orders").select("o_orderkey", day.alias("process_month"))


@query(
    "per_process_month_cutoff",
    f"""with {S.ORDERS} select o.o_orderkey, case when day(o.o_orderdate) >= 15 then m.codmes
else {_prior('m.codmes', 1)} end as process_month from orders o join orders_m m using (o_orderkey)""",
)
def per_process_month_cutoff(spark, sf):
    day = P.process_month_cutoff_col(F.col("o_orderdate"), 15)
    return A.table(spark, sf, "orders").select("o_orderkey", day.alias("process_month"))


@query(
    "per_month_ordinal",
    f"with {S.window()} select codunicocli, codmes, cast(ord as int) as month_ordinal from w",
)
def per_month_ordinal(spark, sf):
    ordinal = P.month_ordinal_col(F.col("codmesanalisis"), F.col("codmes"))
    return A.window_panel(spark, sf).select("codunicocli", "codmes", ordinal.alias("month_ordinal"))


@query(
    "per_audit_cols",
    f"""with {S.panel()} select codunicocli, codmes, date '2001-01-05' as fecrutina,
timestamp '2001-01-05 10:20:30' as fecactualizacionregistro from panel""",
)
def per_audit_cols(spark, sf):
    from datetime import datetime

    rows = A.orders_panel(spark, sf).select("codunicocli", "codmes")
    audited = P.audit_cols(rows, RUN_DATE, datetime(2001, 1, 5, 10, 20, 30))
    return C.cast_cols(audited, {"fecactualizacionregistro": "timestamp_ntz"})


# Projections and filters


@query(
    "prj_rename",
    f"with {S.panel()} select codmes as month, codunicocli as client, mto_tot as amount_tot, mto_p1 as amount_p1 from panel",
)
def prj_rename(spark, sf):
    rows = A.orders_panel(spark, sf).select("codmes", "codunicocli", "mto_tot", "mto_p1")
    renamed = C.rename_columns(rows, {"codmes": "month", "codunicocli": "client"})
    return C.rename_replace(renamed, ["mto_tot", "mto_p1"], "mto", "amount")


@query(
    "prj_suffix_select",
    f"with {S.panel()} select codmes as CODMES, codunicocli as CODUNICOCLI, mto_p1 as MTO_P1, ctd_p1 as CTD_P1, tkt_p1 as TKT_P1, c_flg_p1 as C_FLG_P1, c_flg_tot as C_FLG_TOT from panel",
)
def prj_suffix_select(spark, sf):
    rows = A.orders_panel(spark, sf)
    picked = dict.fromkeys([*C.cols_with_suffix(rows, "_p1"), *C.cols_containing(rows, "flg_tot")])
    return C.upper_columns(rows.select("codmes", "codunicocli", *picked))


@query(
    "prj_cast_all",
    f"with {S.panel()} select cast(codmes as varchar) as codmes, codunicocli, mto_tot, ctd_tot, cast(c_flg_tot as bigint) as c_flg_tot, cast(c_flg_p1 as bigint) as c_flg_p1, 'orders' as origin from panel",
)
def prj_cast_all(spark, sf):
    rows = A.orders_panel(spark, sf).select("codmes", "codunicocli", "mto_tot", "ctd_tot", "c_flg_tot", "c_flg_p1")
    cast = C.cast_all(rows, ["codmes", "codunicocli"], "double", {"_flg_": "bigint"})
    return C.with_literals(cast, {"origin": "orders"})


@query("fil_at_analysis_month", f"with {S.window()} select codunicocli, codmes, mto_tot from w where codmes = codmesanalisis")
def fil_at_analysis_month(spark, sf):
    rows = A.window_panel(spark, sf)
    assert_has_month(rows, MONTH)
    return at_analysis_month(rows).select("codunicocli", "codmes", "mto_tot")


# Joins


MEASURES = ["mto_tot", "ctd_tot", "tkt_p1", "c_flg_p2"]


def _identity_oracle(trim: str) -> str:
    client, party = S.resolved_ids(trim)
    return f"""with {S.panel(sentinels=True)}, {S.resolved("panel", MEASURES, trim)}
select codmes, {client} as codunicocli, {party} as codinternocomputacional, mto_tot, ctd_tot, tkt_p1, c_flg_p2 from s2"""


def _identity_panel(spark, sf):
    panel = read_months(A.orders_panel(spark, sf, True, (S.FIRST, MONTH)), S.FIRST, MONTH)
    return panel.select("codmes", "codunicocli", "codinternocomputacional", *MEASURES)


@query("joi_identity", _identity_oracle("group"))
def joi_identity(spark, sf):
    return resolve_identity(_identity_panel(spark, sf), A.identity_map(spark, sf), "group")


@query("joi_identity_broadcast", _identity_oracle("join"))
def joi_identity_broadcast(spark, sf):
    return resolve_identity(_identity_panel(spark, sf), A.identity_map(spark, sf), "join", broadcast_rows=100_000)


DENSE_SQL = f"""{S.window()},
grid as (select c.codunicocli, m.codmes from (select distinct codunicocli from w) c, (select distinct codmes from w) m),
dense as (select g.codunicocli, g.codmes, coalesce(w.mto_tot, 0) as mto_tot, coalesce(w.mto_p1, 0) as mto_p1,
    coalesce(w.ctd_tot, 0) as ctd_tot, coalesce(w.ctd_p1, 0) as ctd_p1, coalesce(w.c_flg_tot, 0) as c_flg_tot,
    coalesce(w.c_flg_p1, 0) as c_flg_p1
  from grid g left join w on w.codunicocli = g.codunicocli and w.codmes = g.codmes)"""


@query("joi_densify", f"with {DENSE_SQL} select codunicocli, codmes, mto_tot, mto_p1, ctd_tot from dense")
def joi_densify(spark, sf):
    rows = A.window_panel(spark, sf).select("codunicocli", "codmes", "mto_tot", "mto_p1", "ctd_tot")
    return densify(rows, ["codunicocli"])


def _blocks(spark, sf):
    """Two feature blocks from different halves of the panel: recent months and earlier months."""
    rows = A.window_panel(spark, sf)
    recent = rows.where("codmes > 200006").groupBy("codunicocli").agg(F.sum("mto_tot").alias("mto_recent"))
    earlier = rows.where("codmes <= 200006").groupBy("codunicocli").agg(F.sum("ctd_tot").alias("ctd_earlier"))
    return [recent, earlier]


BLOCKS_SQL = f"""{S.window()}, a as (select codunicocli, sum(mto_tot) as mto_recent from w where codmes > 200006 group by 1),
b as (select codunicocli, sum(ctd_tot) as ctd_earlier from w where codmes <= 200006 group by 1)"""


@query("joi_combine_blocks", f"with {BLOCKS_SQL} select * from a join b using (codunicocli)")
def joi_combine_blocks(spark, sf):
    return combine_blocks(_blocks(spark, sf), ["codunicocli"])


@query("joi_full_merge", f"with {BLOCKS_SQL} select * from a full join b using (codunicocli)")
def joi_full_merge(spark, sf):
    return combine_blocks(_blocks(spark, sf), ["codunicocli"], "full")


# Aggregates


@query(
    "agg_base_client",
    f"with {S.identity()} select codmes, codunicocli, max(codinternocomputacionalconcepto) as party_last from ident group by all",
)
def agg_base_client(spark, sf):
    return base_client(A.identity_map(spark, sf), ["codmes"])


@query(
    "agg_consolidate",
    f"with {S.panel(sentinels=True)}, {S.consolidated('panel', MEASURES, 'group')} select codmes, cuc as codunicocli, cic as codinternocomputacional, mto_tot, ctd_tot, tkt_p1, c_flg_p2 from cons",
)
def agg_consolidate(spark, sf):
    return consolidate(joi_identity(spark, sf), MEASURES)


def library_query(name: str, specs: list[L.AggSpec], oracle: str) -> None:
    @query(name, S.library(oracle))
    def run(spark, sf):
        return L.trailing_agg(A.window_panel(spark, sf), specs)


def _each(columns, horizons, template) -> str:
    return ", ".join(template(c, n) for n in horizons for c in columns)


def _u(n: int) -> str:
    return "U12" if n == 12 else f"U{n}M"


AMOUNTS, COUNTS = ["mto_tot", "mto_p1"], ["ctd_tot", "ctd_p2"]

library_query(
    "agg_frequency", L.frequency(COUNTS, (-2, -5, -8, -11)),
    _each(COUNTS, H, lambda c, n: f"count(*) filter (where {c} > 0 and ord <= {n}) as {c}_FRQ_{_u(n)}"),
)
library_query(
    "agg_recency", L.recency(COUNTS),
    ", ".join(f"cast(coalesce(min(ord) filter (where {c} > 0), 0) as double) as {c}_REC" for c in COUNTS),
)
library_query(
    "agg_seniority_mean", L.seniority_mean(AMOUNTS, (0, 2, 11)),
    _each(AMOUNTS, (1, 3, 12), lambda c, n: f"avg({c}) {S.within(n)} as {c}_{'U1M' if n == 1 else 'PRM_' + _u(n)}"),
)
library_query(
    "agg_type_minmax", L.type_extremes(AMOUNTS, (0, 5, 11)),
    _each(AMOUNTS, (1, 6, 12), lambda c, n: f"max({c}) {S.within(n)} as {c}_{'U1M' if n == 1 else 'MAX_' + _u(n)}")
    + ", " + _each(AMOUNTS, (6, 12), lambda c, n: f"min({c}) {S.within(n)} as {c}_MIN_{_u(n)}"),
)
PREV = {1: 2, 3: 4, 6: 7}


def _last_sql(fn: str, label: str) -> str:
    return _each(
        AMOUNTS, (1, 3, 6, 12), lambda c, n: f"{fn}({c}) {S.within(n)} as {c}{'' if n == 1 else '_' + label}_{_u(n)}"
    )


def _prev_sql(fn: str, label: str) -> str:
    last = {1: 2, 3: 6, 6: 12}
    return _each(
        AMOUNTS, (1, 3, 6),
        lambda c, n: f"{fn}({c}) {S.within(last[n], PREV[n])} as {c}{'' if n == 1 else '_' + label}_P{n}M",
    )


for _kind, _builder, _fn, _label in (
    ("mean", L.mean, "avg", "PRM"), ("sum", L.total, "sum", "SUM"), ("max", L.maximum, "max", "MAX"),
):
    library_query(f"agg_{_kind}_last", _builder(AMOUNTS, ("1", "3", "6", "12")), _last_sql(_fn, _label))
    library_query(f"agg_{_kind}_prev", _builder(AMOUNTS, ("1", "3", "6"), previous=True), _prev_sql(_fn, _label))

library_query(
    "agg_min_last", L.minimum(AMOUNTS, ("3", "12")),
    _each(AMOUNTS, (3, 12), lambda c, n: f"min({c}) {S.within(n)} as {c}_MIN_U{n}M"),
)


def _four_edges(builder, *args) -> list[L.AggSpec]:
    return [s for first in (True, False) for o in (False, True) for s in builder(AMOUNTS, (6, 12), *args, first=first, ordinal=o)]


def _edges_sql(test, tags: tuple[str, str, str, str], tail: str) -> str:
    """First month, its ordinal, last month, its ordinal."""
    values = (("min", "codmes"), ("max", "cast(ord as double)"), ("max", "codmes"), ("min", "cast(ord as double)"))
    return ", ".join(
        f"{fn}({v}) filter (where ord <= {n} and {test(c)}) as {c}_{tag}_{tail}U{n}M"
        for (fn, v), tag in zip(values, tags) for n in (6, 12) for c in AMOUNTS
    )


library_query(
    "agg_first_last_month", _four_edges(L.month_above, 20000000),
    _edges_sql(lambda c: f"{c} > 20000000", ("PRI", "DS_PRI", "U", "DS_U"), "20000000_"),
)
library_query(
    "agg_first_last_vs_col", _four_edges(L.month_above_column, "mto_p2"),
    _edges_sql(lambda c: f"{c} > mto_p2", ("PRI3", "DS_PRI", "U3", "DS_U"), ""),
)
library_query(
    "agg_first_last_two", _four_edges(L.month_both_above, "ctd_tot", 1000000, 1),
    _edges_sql(
        lambda c: f"coalesce({c}, 0) > 1000000 and coalesce(ctd_tot, 0) > 1",
        ("PRI1", "DS_PRI1", "U1", "DS_U1"), "1000000_1_",
    ),
)


def _indicator_sql(test, known, fn: str, name) -> str:
    return _each(
        AMOUNTS, (3, 12),
        lambda c, n: f"{fn}(case when {test(c)} then 1 when {known(c)} then 0 end) {S.within(n)} as {name(c, n)}",
    )


def _indicator_query(name: str, builder, tag: str, args: tuple, test, known, tail: str) -> None:
    specs, parts = [], []
    for fn in ("count", "max", "avg"):
        specs += builder(AMOUNTS, (3, 12), fn, f"_{fn.upper()}{tag}", *args)
        parts.append(_indicator_sql(test, known, fn, lambda c, n: f"{c}_{fn.upper()}{tag}{tail}U{n}M"))  # noqa: B023
    library_query(name, specs, ", ".join(parts))


_indicator_query(
    "agg_ind_threshold", L.indicator, "_", (20000000,),
    lambda c: f"coalesce({c}, 0) > 20000000", lambda c: f"{c} is not null", "20000000_",
)
_indicator_query(
    "agg_ind_vs_col", L.indicator_vs_column, "_VS_", ("mto_p2",),
    lambda c: f"coalesce({c}, 0) > coalesce(mto_p2, 0)", lambda c: f"{c} is not null and mto_p2 is not null", "",
)
_indicator_query(
    "agg_ind_two", L.indicator_both, "_", ("mto_p2", 1000000, 2000000),
    lambda c: f"coalesce({c}, 0) > 1000000 and coalesce(mto_p2, 0) > 2000000",
    lambda c: f"{c} is not null and mto_p2 is not null", "1000000_2000000_",
)
library_query(
    "agg_min_opening", L.earliest_opening("mto_p1", 6, 100000),
    "min(case when ord between 1 and 6 and mto_p1 > 100000 then mto_p1 else 300001 end) as FATC_FEC_CODMES_AP_TC",
)


# Trailing matrix

KEYS1 = ["codmesanalisis", "codunicocli"]


def _trailing_query(name: str, measures, fn, starts, end, style="all_of_n", windowed=False):
    specs = [s for s in expand_specs(measures, (fn,), starts, (end,), style)]
    over = lambda a: f"partition by codunicocli order by codmes rows between {-a} preceding and {-end} preceding"
    cols = ", ".join(f"cast({fn}({s.measure}) over ({over(s.start)}) as double) as {s.name}" for s in specs)
    names = ", ".join(s.name for s in specs)
    oracle = f"""with {DENSE_SQL}, r as (select codunicocli, codmes, {cols} from dense)
select {MONTH} as codmesanalisis, codunicocli, {names} from r where codmes = {MONTH}"""

    @query(name, oracle)
    def run(spark, sf):
        rows = A.window_panel(spark, sf)
        if windowed:
            return C.cast_cols(trailing_by_window(rows, specs, KEYS1), {s.name: "double" for s in specs})
        return trailing_matrix(rows, specs, MONTH, KEYS1)


_trailing_query("win_trailing_avg", AMOUNTS + ["ctd_tot"], "avg", OFFSETS, 0)
_trailing_query("win_trailing_avg_window_form", AMOUNTS + ["ctd_tot"], "avg", OFFSETS, 0, windowed=True)
_trailing_query("win_trailing_max", AMOUNTS + ["ctd_tot"], "max", OFFSETS[1:], 0)
_trailing_query("win_trailing_min", AMOUNTS + ["ctd_tot"], "min", OFFSETS[1:], 0)
_trailing_query("win_flag_sum", ["c_flg_tot", "c_flg_p1"], "sum", OFFSETS[1:], 0)
_trailing_query("win_sum_general", AMOUNTS, "sum", OFFSETS[1:], 0, style="general")

_PREV_SPECS = [s for a, e in ((-11, -6), (-5, -3), (-1, -1)) for s in expand_specs(AMOUNTS, ("avg",), (a,), (e,))]


@query(
    "win_trailing_prev_blocks",
    f"""with {DENSE_SQL}, r as (select codunicocli, codmes, {", ".join(
        f"avg({s.measure}) over (partition by codunicocli order by codmes rows between {-s.start} preceding and {-s.end} preceding) as {s.name}"
        for s in _PREV_SPECS)} from dense)
select {MONTH} as codmesanalisis, codunicocli, {", ".join(s.name for s in _PREV_SPECS)} from r where codmes = {MONTH}""",
)
def win_trailing_prev_blocks(spark, sf):
    return trailing_matrix(A.window_panel(spark, sf), _PREV_SPECS, MONTH, KEYS1)


# Derived features


def _features(spark, sf, specs):
    return trailing_matrix(A.window_panel(spark, sf), specs, MONTH, KEYS1)


def _over(fn: str, m: str, a: int, b: int = 0) -> str:
    return f"{fn}({m}) over (partition by codunicocli order by codmes rows between {a} preceding and {b} preceding)"


@query(
    "der_growth",
    f"""with {DENSE_SQL}, r as (select codunicocli, codmes, {", ".join(
        f"{_over('avg', m, 5)} as {m}_u6, {_over('avg', m, 11, 6)} as {m}_p6, {_over('avg', m, 2)} as {m}_u3, {_over('avg', m, 5, 3)} as {m}_p3, {m} as {m}_u1, {_over('avg', m, 1, 1)} as {m}_p1"
        for m in AMOUNTS)} from dense)
select {MONTH} as codmesanalisis, codunicocli, {", ".join(
        f"round({m}_u{n} / nullif({m}_p{n}, 0), 8) as {m}_G{n}M" for n in (6, 3, 1) for m in AMOUNTS)} from r where codmes = {MONTH}""",
)
def der_growth(spark, sf):
    frames = ((0, 0), (-2, 0), (-5, 0), (-11, -6), (-5, -3), (-1, -1))
    specs = [s for a, e in frames for s in expand_specs(AMOUNTS, ("avg",), (a,), (e,))]
    names = [f"{m}_G{n}M" for n in (6, 3, 1) for m in AMOUNTS]
    return growth(_features(spark, sf, specs), AMOUNTS).select(*KEYS1, *names)


@query(
    "der_min_gate",
    f"""with {DENSE_SQL}, r as (select codunicocli, codmes, {", ".join(
        f"{_over('min', 'ctd_tot', n - 1)} as mn{n}" for n in H)} from dense),
f as (select codunicocli, {", ".join(f"count(*) filter (where ctd_tot > 0 and ord <= {n}) as f{n}" for n in H)} from w group by 1)
select {MONTH} as codmesanalisis, codunicocli, {", ".join(
        f"case when f{n} < {n} then 0 else mn{n} end as ctd_tot_MIN_{_u(n)}, f{n} as ctd_tot_FRQ_{_u(n)}" for n in H)}
from r join f using (codunicocli) where codmes = {MONTH}""",
)
def der_min_gate(spark, sf):
    rows = A.window_panel(spark, sf)
    minima = trailing_matrix(rows, expand_specs(["ctd_tot"], ("min",), OFFSETS[1:], (0,)), MONTH, KEYS1)
    active = L.trailing_agg(rows, L.frequency(["ctd_tot"], OFFSETS[1:]), KEYS1)
    both = combine_blocks([minima, active], KEYS1)
    return min_gate(both, [(f"ctd_tot_MIN_{_u(n)}", f"ctd_tot_FRQ_{_u(n)}", n) for n in H])


_FLAGS = ["c_flg_tot", "c_flg_p1"]


@query(
    "der_all_of_n",
    f"""with {DENSE_SQL}, r as (select codunicocli, codmes, {", ".join(
        f"{_over('sum', m, n - 1)} as {m}_{n}" for m in _FLAGS for n in H)} from dense)
select {MONTH} as codmesanalisis, codunicocli, {", ".join(
        f"case when {m}_{n} = {n} then 1 else 0 end as {m}_{'X12_U12' if n == 12 else f'X{n}M_U{n}M'}" for m in _FLAGS for n in H)}
from r where codmes = {MONTH}""",
)
def der_all_of_n(spark, sf):
    specs = expand_specs(_FLAGS, ("sum",), OFFSETS[1:], (0,))
    return exactly_n(_features(spark, sf, specs), {s.name: 1 - s.start for s in specs})


@query(
    "der_flag_u1m",
    f"with {DENSE_SQL} select {MONTH} as codmesanalisis, codunicocli, case when c_flg_p1 = 1 then 1 else 0 end as c_flg_p1_U1M from dense where codmes = {MONTH}",
)
def der_flag_u1m(spark, sf):
    specs = expand_specs(["c_flg_p1"], ("avg",), (0,), (0,))
    return exactly_n(_features(spark, sf, specs), {"c_flg_p1_U1M": 1})


@query(
    "der_party_key",
    f"""with {S.panel(sentinels=True)} select codmes, codunicocli, trim(codinternocomputacional) as party, 128 as key_length,
true as same_key from panel""",
)
def der_party_key(spark, sf):
    """The oracle engine has no SHA-512, so every key is compared whole with that of another library."""
    rows = A.orders_panel(spark, sf, sentinels=True)
    keyed = rows.select("codmes", "codunicocli", F.trim("codinternocomputacional").alias("party"), party_key(F.col("codinternocomputacional")).alias("key"))

    def again(batches):
        for batch in batches:
            own = [hashlib.sha512(f"0001{party}".encode()).hexdigest() for party in batch["party"]]
            yield batch.assign(same_key=batch["key"].eq(own), key_length=batch["key"].str.len()).drop(columns="key")

    return keyed.mapInPandas(again, "codmes int, codunicocli string, party string, same_key boolean, key_length int")


@query(
    "src_measure_list",
    f"with {GROUPS_SQL} select distinct upper(trim(nomconcepto)) as measure from g where upper(nomgrupo) = 'P2' and upper(trim(nomtablaconcepto)) = 'HM_CONCEPTO_ECONOMY'",
)
def src_measure_list(spark, sf):
    """The list that a run checks its layout against; a group without measures is an error."""
    groups = A.measure_groups(spark, sf).withColumn("nomconcepto", F.concat(F.lit(" "), "nomconcepto"))
    try:
        measures_for(groups, "P2", "no such table")
    except ValueError:
        return spark.createDataFrame([(m,) for m in measures_for(groups, " p2", "hm_concepto_economy ")], "measure string")
    raise AssertionError("a group without measures must raise")


# Metadata


@query(
    "meta_groups",
    f"with {GROUPS_SQL} select nomgrupo, nomtablaconcepto, count(*) as num_columnas from g where nomgrupo in ('P1', 'P2') group by all",
)
def q_meta_groups(spark, sf):
    return meta_groups(A.measure_groups(spark, sf), ["P1", "P2"])


@query("meta_pairs", f"with {GROUPS_SQL} select distinct nomgrupo, nomtablaconcepto from g where nomgrupo = 'P2'")
def q_meta_pairs(spark, sf):
    return meta_pairs(A.measure_groups(spark, sf), "P2")


@query(
    "meta_find",
    f"with {GROUPS_SQL} select nomgrupo, nomtablaconcepto, nomconcepto from g where upper(nomtablaconcepto) like '%CONCEPTO_PROMO%'",
)
def q_meta_find(spark, sf):
    return meta_find(A.measure_groups(spark, sf), "concepto_promo")


@query(
    "meta_lengths",
    f"""with {GROUPS_SQL} select nomgrupo, nomtablaconcepto, cast(length(nomgrupo) as int) as len_grupo,
cast(length(nomtablaconcepto) as int) as len_tabla, nomconcepto from g where nomgrupo = 'P2'
order by nomtablaconcepto, nomconcepto limit 20""",
)
def q_meta_lengths(spark, sf):
    return meta_lengths(A.measure_groups(spark, sf), "P2")


# Parity: the panel against a changed copy of itself

PARITY_KEYS = ["codmes", "codunicocli"]
PARITY_COLUMNS = ["codmes", "codunicocli", "mto_tot", "ctd_tot", "ctd_p1", "label"]


def _versions(spark, sf):
    """The copy misses some customers and changes an amount, a count and a text of others."""
    base = A.orders_panel(spark, sf).withColumn("label", F.concat(F.lit("m"), F.col("codmes").cast("string")))
    a = base.select(*PARITY_COLUMNS)
    n = F.substring("codunicocli", 2, 20).cast("bigint")
    b = a.where(n % 9 != 0).withColumns(
        {
            "mto_tot": F.when(n % 5 == 0, F.col("mto_tot") + n % 3).otherwise(F.col("mto_tot")),
            "ctd_p1": F.when(n % 4 == 0, F.col("ctd_p1") + 1).otherwise(F.col("ctd_p1")),
            "label": F.when(n % 6 == 0, F.upper("label")).otherwise(F.concat("label", F.lit("  "))),
        }
    )
    extra = a.where(n % 9 == 1).withColumn("codunicocli", F.concat("codunicocli", F.lit("x")))
    return a, b.unionByName(extra)


VERSIONS_SQL = f"""{S.panel()},
a as (select codmes, codunicocli, mto_tot, ctd_tot, ctd_p1, 'm' || codmes as label, cast(substr(codunicocli, 2) as bigint) as n from panel),
b as (select codmes, codunicocli, case when n % 5 = 0 then mto_tot + n % 3 else mto_tot end as mto_tot, ctd_tot,
    case when n % 4 = 0 then ctd_p1 + 1 else ctd_p1 end as ctd_p1,
    case when n % 6 = 0 then upper(label) else label || '  ' end as label
  from a where n % 9 <> 0
  union all select codmes, codunicocli || 'x', mto_tot, ctd_tot, ctd_p1, label from a where n % 9 = 1)"""
CELLS_SQL = f"""{VERSIONS_SQL}, both_sides as (select a.codmes, a.codunicocli, a.mto_tot am, b.mto_tot bm, a.ctd_p1 ac, b.ctd_p1 bc, a.label al, b.label bl
  from a join b on a.codmes = b.codmes and a.codunicocli = b.codunicocli),
cells as (
  select codmes, codunicocli, 'mto_tot' as column_name, abs(am - bm) as abs_diff from both_sides where abs(am - bm) > 1
  union all select codmes, codunicocli, 'ctd_p1', abs(ac - bc) from both_sides where abs(ac - bc) > 0
  union all select codmes, codunicocli, 'label', null from both_sides where trim(al) <> trim(bl))"""


def _cells(spark, sf):
    a, b = _versions(spark, sf)
    return PAR.cell_diff(a, b, PARITY_KEYS, eps_by_column={"mto_tot": 1.0})


SQL_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}


@query(
    "par_schema",
    f"""with types(t, s) as (values {", ".join(f"('{t}', '{s}')" for t, s in SQL_TYPES.items())}),
c as (select table_name, column_name, column_index - (select min(column_index) from duckdb_columns() d where d.table_name = k.table_name) as i, s
  from duckdb_columns() k join types on data_type = t where not internal and table_name in ('documents', 'conversations', 'labels')),
x as (select * from c where table_name = 'documents'), y as (select * from c where table_name = 'conversations')
select coalesce(x.column_name, y.column_name) as column_name, cast(x.i as int) as position_a, cast(y.i as int) as position_b, x.s as type_a, y.s as type_b
from x full join y on x.column_name = y.column_name where x.i is distinct from y.i or x.s is distinct from y.s""",
)
def par_schema(spark, sf):
    return PAR.schema_diff(A.table(spark, sf, "documents"), A.table(spark, sf, "conversations"))


@query(
    "par_counts",
    f"""with {VERSIONS_SQL}, x as (select codmes, count(*) ra from a group by 1), y as (select codmes, count(*) rb from b group by 1)
select codmes, coalesce(ra, 0) as rows_a, coalesce(rb, 0) as rows_b, coalesce(ra, 0) - coalesce(rb, 0) as rows_diff from x full join y using (codmes)""",
)
def par_counts(spark, sf):
    return PAR.count_diff(*_versions(spark, sf))


@query(
    "par_keys",
    f"""with {VERSIONS_SQL} select codmes, codunicocli, 'only_a' as side from a anti join b using (codmes, codunicocli)
union all select codmes, codunicocli, 'only_b' from b anti join a using (codmes, codunicocli)""",
)
def par_keys(spark, sf):
    return PAR.key_diff(*_versions(spark, sf), PARITY_KEYS)


NULL_KEYS = """orders_n as (select o_orderkey, nullif(o_custkey % 40, 7) as k,
    cast(round(o_totalprice * 100) as bigint) as x from orders),
a as (select k, sum(x) as v from orders_n group by k), b as (select k, v + case when k is null or k % 5 = 0 then 1 else 0 end as v from a)"""


@query(
    "par_cells_null_keys",
    f"""with {NULL_KEYS} select a.k, 'V' as column_name, a.v::varchar as value_a, b.v::varchar as value_b,
    abs(a.v - b.v)::double as abs_diff from a join b on a.k is not distinct from b.k where a.v <> b.v""",
)
def par_cells_null_keys(spark, sf):
    """One key is NULL, and the column's name differs in case."""
    key = F.nullif(F.col("o_custkey") % 40, F.lit(7)).alias("k")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").alias("x")
    a = A.table(spark, sf, "orders").select(key, cents).groupBy("k").agg(F.sum("x").alias("V"))
    changed = F.col("V") + F.when(F.col("k").isNull() | (F.col("k") % 5 == 0), 1).otherwise(0)
    return PAR.cell_diff(a, a.select("k", changed.alias("v")), ["k"])


@query("par_cells", f"with {CELLS_SQL} select * from cells")
def par_cells(spark, sf):
    return _cells(spark, sf).select(*PARITY_KEYS, "column_name", "abs_diff")


@query("par_cells_tree", f"with {CELLS_SQL} select * from cells")
def par_cells_tree(spark, sf):
    """The same cells, from the buckets whose digests differ."""
    a, b = _versions(spark, sf)
    cells = tree_cell_diff(a, b, PARITY_KEYS, eps_by_column={"mto_tot": 1.0})
    return cells.select(*PARITY_KEYS, "column_name", "abs_diff")


@query(
    "par_tree_nodes",
    f"""with {VERSIONS_SQL}, t as (select count(*) as n from a), u as (select count(*) as n from b)
select 0 as level, 1::bigint as nodes, t.n as rows_a, u.n as rows_b from t, u""",
)
def par_tree_nodes(spark, sf):
    """How much of the tree differs: the root, over all rows; a copy of a table has no differing node at all."""
    a, b = _versions(spark, sf)
    same = differing_nodes(*trees(a, a.repartition(3), PARITY_KEYS))
    nodes = differing_nodes(*trees(a, b, PARITY_KEYS)).unionByName(same).where("level = 0")
    sums = (F.sum(c).alias(c) for c in ("rows_a", "rows_b"))
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), *sums)


FRACTIONS = (0.1, 0.5, 0.9, 0.99)


@query(
    "par_error_quantiles",
    f"""with {CELLS_SQL}, f(fraction) as (values {", ".join(f"({f}::double)" for f in FRACTIONS)})
select column_name, fraction, count(*) as n_cells, max(abs_diff) as max_diff, avg(abs_diff) as mean_diff, case when count(abs_diff) > 0 then true end as within
from cells, f group by column_name, fraction""",
)
def par_error_quantiles(spark, sf):
    """Sketches per month, merged; every quantile is held against the exact ranks of its column."""
    cells = _cells(spark, sf)
    merged = merge_difference_sketches(difference_sketches(cells, ["codmes", "column_name"]))
    found = error_distribution(merged, FRACTIONS)
    ranks = cells.join(F.broadcast(found.select("column_name", "fraction", "quantile", "rank_error")), "column_name").groupBy("column_name", "fraction").agg(
        (F.try_divide(F.count_if(F.col("abs_diff") < F.col("quantile")), F.count("abs_diff")) - F.max("rank_error")).alias("low"),
        (F.try_divide(F.count_if(F.col("abs_diff") <= F.col("quantile")), F.count("abs_diff")) + F.max("rank_error")).alias("high"),
    )
    within = F.col("fraction").between(F.col("low"), F.col("high")).alias("within")
    return found.join(ranks, ["column_name", "fraction"]).select("column_name", "fraction", "n_cells", "max_diff", "mean_diff", within)


@query(
    "par_key_counts",
    f"""with {S.panel()}, each as (select 'month' as part, codmes, count(*) as row_count, count(distinct codunicocli) as exact from panel group by codmes)
select *, true as within from each union all
select 'all', null, count(*), count(distinct codunicocli), true from panel""",
)
def par_key_counts(spark, sf):
    """Distinct customers per month and over all months, by merged sketches, next to the exact counts."""
    panel = A.orders_panel(spark, sf)
    parts = key_sketches(panel, ["codunicocli"], ["codmes"], "month")
    whole = merge_key_sketches(parts.withColumns({"stage": F.lit("all"), "codmes": F.lit(None).cast("int")}), ["stage", "codmes"])
    counted = key_counts(parts.unionByName(whole)).withColumnRenamed("stage", "part")
    by_month = panel.groupBy("codmes").agg(F.countDistinct("codunicocli").alias("exact"))
    exact = by_month.unionByName(panel.agg(F.lit(None).cast("int").alias("codmes"), F.countDistinct("codunicocli").alias("exact")))
    met = counted.join(exact.withColumnRenamed("codmes", "_m"), F.col("codmes").eqNullSafe(F.col("_m")))
    near = F.abs(F.col("key_count") - F.col("exact")) <= F.greatest(3 * F.col("relative_error") * F.col("exact"), F.lit(1))
    return met.select("part", "codmes", "row_count", "exact", near.alias("within"))


@query(
    "par_top_diffs",
    f"""with {CELLS_SQL} select * from (select cells.*, cast(row_number() over (partition by column_name
order by abs_diff desc nulls last, codmes, codunicocli) as int) as diff_rank from cells) where diff_rank <= 10""",
)
def par_top_diffs(spark, sf):
    return PAR.top_diffs(_cells(spark, sf).select(*PARITY_KEYS, "column_name", "abs_diff"), 10, PARITY_KEYS)


@query(
    "par_summary",
    f"""with {CELLS_SQL} select column_name, count(*) as n_cells, max(abs_diff) as max_diff, avg(abs_diff) as mean_diff,
quantile_disc(abs_diff, 0.5) as median_diff from cells group by 1""",
)
def par_summary(spark, sf):
    return PAR.diff_summary(_cells(spark, sf))


@query(
    "par_control_totals",
    f"""with {S.panel()} select count(*) as total_rows, count(distinct codunicocli) as distinct_clients, min(codmes) as min_month,
max(codmes) as max_month, sum(mto_tot) as measure_sum from panel where codmes = {MONTH}""",
)
def par_control_totals(spark, sf):
    return PAR.control_totals(A.orders_panel(spark, sf), MONTH, "mto_tot", analysis="codmes")


@query(
    "par_metric_sums",
    f"with {S.window()} select codmesanalisis, codunicocli, sum(mto_tot) as sum_mto_tot, sum(tkt_tot) as sum_tkt_tot, sum(ctd_tot) as sum_ctd_tot from w group by 1, 2",
)
def par_metric_sums(spark, sf):
    return PAR.metric_sums(A.window_panel(spark, sf), ["mto_tot", "tkt_tot", "ctd_tot"], KEYS1)


HASHED = ["mto_tot", "ctd_tot", "c_flg_p1", "mto_p1"]


def _digest_sql(values: list[str]) -> str:
    """SHA-256 over length-prefixed values, NULL as a mark of its own."""
    texts = [f"cast({v} as varchar)" for v in values]
    return "sha256(concat_ws('|', " + ", ".join(f"coalesce(length({t}) || ':' || {t}, 'n')" for t in texts) + "))"


@query(
    "par_row_hash",
    f"""with {S.panel()} select codmes, codunicocli,
{_digest_sql([f"cast({c} as bigint)" for c in HASHED])} as row_hash from panel""",
)
def par_row_hash(spark, sf):
    # whole numbers, because the engines write doubles as text in different ways
    rows = C.cast_cols(A.orders_panel(spark, sf), {c: "bigint" for c in HASHED})
    return PAR.row_hash(rows, HASHED, PARITY_KEYS)


TABLE_HASHED = ["codmes", "codunicocli", *HASHED]


@query(
    "par_table_hash",
    f"""with {S.panel()} select count(*) as row_count,
sum(cast('0x' || substr({_digest_sql(["codmes", "codunicocli", *(f"cast({c} as bigint)" for c in HASHED)])}, 1, 15) as bigint)::hugeint)::decimal(38,0)
as table_hash from panel""",
)
def par_table_hash(spark, sf):
    rows = C.cast_cols(A.orders_panel(spark, sf), {c: "bigint" for c in HASHED})
    return PAR.table_hash(rows, TABLE_HASHED)


@query(
    "par_sample",
    f"""with {CELLS_SQL.replace("abs(am - bm) > 1", "abs(am - bm) > 0")},
sampled as (select codmes, codunicocli from (select codmes, codunicocli from a union select codmes, codunicocli from b)
  order by {_digest_sql(["codmes", "codunicocli", "7"])}, codmes, codunicocli limit 1000)
select codmes, codunicocli, column_name, abs_diff from cells join sampled using (codmes, codunicocli)
union all select codmes, codunicocli, '(row)', null from sampled anti join a using (codmes, codunicocli)
union all select codmes, codunicocli, '(row)', null from sampled anti join b using (codmes, codunicocli)""",
)
def par_sample(spark, sf):
    cells = PAR.sample_diff(*_versions(spark, sf), PARITY_KEYS, n=1000, seed=7)
    return cells.select(*PARITY_KEYS, "column_name", "abs_diff")


def _profile_sql() -> str:
    columns = ("mto_tot", "mto_p1", "ctd_tot", "tkt_p1")
    return f"with {S.panel()} " + " union all ".join(
        f"select count(*) as row_count, count(distinct (codmes, codunicocli)) as key_count, '{c}' as column_name, "
        f"count(*) filter (where {c} is null) as null_count, sum({c}) as total from panel"
        for c in columns
    )


@query("par_profile", _profile_sql())
def par_profile(spark, sf):
    rows = A.orders_panel(spark, sf).select(*PARITY_KEYS, "mto_tot", "mto_p1", "ctd_tot", "tkt_p1")
    return PAR.profile(rows, PARITY_KEYS)


# Whole matrices; only the party key (SHA-512) has no counterpart in the oracle engine

NOT_IN_ORACLE = ("codclavepartycli",)
RUN_TIME = datetime(2001, 1, 5, 10, 20, 30)


def whole_matrix(spark, sf, source, channel, months=(MONTH,), without=()) -> DataFrame:
    """All columns of the matrix, with a pinned record timestamp."""
    span = int(P.shift_month(min(months), -11)), max(months)
    concept, identity = source(spark, sf, months=span), A.identity_map(spark, sf, months)
    if without:
        concept = concept.where(~F.col("codmes").isin(*without))
    matrix = build_matrix(concept, identity, channel, months, RUN_DATE, RUN_TIME)
    return C.cast_cols(matrix, {"fecactualizacionregistro": "timestamp_ntz"})


def matrix_query(name: str, source, channel, oracle: str, months=(MONTH,), without=()) -> None:
    @query(name, oracle)
    def run(spark, sf):
        return whole_matrix(spark, sf, source, channel, months, without).drop(*NOT_IN_ORACLE)


matrix_query("pip_pos", A.pos_panel, pos_channel(), S.matrix("pos"))
matrix_query("pip_agent", A.agent_panel, agent_channel(), S.matrix("agent"))
matrix_query("pip_atm", A.atm_panel, atm_channel(), S.matrix("atm"))
matrix_query("pip_backfill", A.agent_panel, agent_channel(), S.matrix("agent", BACKFILL), BACKFILL)
matrix_query(
    "pip_agent_gaps", A.agent_panel, agent_channel(), S.matrix("agent", (200011, 200012), without=(199912, 200006, 200009)),
    (200011, 200012), (199912, 200006, 200009),
)


# Runs that write


def _agent_run(spark, sf, months, concept=None) -> RunConfig:
    """Catalog tables for a run of the agent channel: the whole panel, every snapshot of the analysis months, the run parameters."""
    names = {t: _fresh(t) for t in ("concept", "identity", "params", "matrix")}
    panel = A.agent_panel(spark, sf) if concept is None else concept
    sinks.write_matrix(sinks.spread_by_month(panel), names["concept"])
    A.identity_map(spark, sf, months).write.saveAsTable(names["identity"])
    spark.createDataFrame([(float(min(months)), float(max(months)))], "codmesinicio double, codmesfin double").write.saveAsTable(names["params"])
    return RunConfig(
        Namespace(spark.catalog.currentDatabase()), agent_channel(), names["concept"], RUN_DATE, names["identity"], names["params"],
        target_table=names["matrix"], ts=RUN_TIME,
    )


@contextmanager
def _options_kept(spark):
    """Runs set options of their session; the other queries go on with theirs."""
    before = {option: spark.conf.get(option, None) for option in SESSION_OPTIONS}
    try:
        yield
    finally:
        for option, value in before.items():
            spark.conf.unset(option) if value is None else spark.conf.set(option, value)


def _written(spark, cfg: RunConfig) -> DataFrame:
    matrix = spark.table(cfg.target).drop(*NOT_IN_ORACLE)
    return C.cast_cols(matrix, {"fecactualizacionregistro": "timestamp_ntz"})


@query("pip_run_backfill", S.matrix("agent", BACKFILL))
def pip_run_backfill(spark, sf):
    """All months of the run parameters in one job, written to the target and read back."""
    cfg = _agent_run(spark, sf, BACKFILL)
    with _options_kept(spark):
        run_backfill(spark, cfg, one_job=True)
    return _written(spark, cfg)


@query("pip_run_month", S.matrix("agent", (200011,)))
def pip_run_month(spark, sf):
    """Equal run parameters: the month closed on the run date, which is the one before, written by itself."""
    cfg = replace(_agent_run(spark, sf, (200011,)), run_date="2000-12-05")
    with _options_kept(spark):
        run_backfill(spark, cfg)
    return _written(spark, cfg).withColumn("fecrutina", F.lit(RUN_DATE).cast("date"))


@query("pip_late_data", S.matrix("agent"))
def pip_late_data(spark, sf):
    """A month computed before some customers' rows arrived, others' were corrected and some withdrawn; then brought up to date."""
    panel = A.agent_panel(spark, sf)
    n = F.crc32(F.col("codunicocli").cast("binary")) % 40
    early = panel.where(~((n == 1) & (F.col("codmes") == 200009))).withColumn(
        "CAN_MTO_TMO_AGT", F.when(n == 2, F.col("CAN_MTO_TMO_AGT") + 100).otherwise(F.col("CAN_MTO_TMO_AGT"))
    )
    withdrawn = panel.where(n == 3).withColumn("codmes", F.lit(200011)).dropDuplicates(["codunicocli"])
    cfg = _agent_run(spark, sf, (MONTH,), early.unionByName(withdrawn))
    late = replace(cfg, concept_table=_fresh("concept"))
    sinks.write_matrix(sinks.spread_by_month(panel), late.concept_table)
    with _options_kept(spark):
        refresh_month(spark, cfg, MONTH)
        refresh_month(spark, late, MONTH)
    return _written(spark, late)


@query("joi_stored_lookup", _identity_oracle("group"))
def joi_stored_lookup(spark, sf):
    """The panel is stored by its lookup key, and looked up where it lies."""
    stored = sinks.stage_table(with_lookup_key(_identity_panel(spark, sf)), _fresh("keyed"), None, bucket_by=[LOOKUP_KEY])
    return resolve_identity(stored, A.identity_map(spark, sf), "group")


@query(
    "pip_stored_states",
    S.matrix("agent", BACKFILL).replace("date '2001-01-05' as fecrutina", "null as a").split(", null as a")[0].replace(
        "select rolled.cuc as codunicocli, rolled.cuc as codclaveunicocli,", "select rolled.cuc as codunicocli,"
    ) + " from rolled join activity using (am, cuc, cic) where rolled.codmes = rolled.am",
)
def pip_stored_states(spark, sf):
    """Month states are stored by customer once; every analysis month is then a scan of them."""
    channel, span = agent_channel(), int(P.shift_month(min(BACKFILL), -11))
    concept = A.agent_panel(spark, sf, months=(span, max(BACKFILL)))
    states = month_states(concept, A.identity_map(spark, sf, BACKFILL), channel, BACKFILL)
    named = states.where("codunicocli is not null and codinternocomputacional is not null")
    stored = sinks.stage_table(named, _fresh("states"), "codmes", bucket_by=channel.keys.ids)
    present = distinct_periods(concept, "codmes")
    months = [features_of_states(stored, channel, [m], BACKFILL, present, stored=True) for m in BACKFILL]
    return months[0].unionByName(months[1]).unionByName(months[2])


@query("src_listed_months", f"with {S.panel()} select distinct codmes from panel")
def src_listed_months(spark, sf):
    """Months of a stored table from the catalog; one that is not laid out by month has to be read."""
    table, flat = _fresh("listed"), _fresh("flat")
    sinks.write_matrix(_stored_panel(spark, sf), table)
    sinks.stage_table(spark.table(table), flat, None)
    assert listed_periods(spark, flat) is None
    return spark.createDataFrame([(m,) for m in listed_periods(spark, table)], "codmes int")


# Windows of other months, several at once, and with months missing

SPREAD = expand_specs(["mto_tot", "ctd_tot"], ("avg", "max", "min", "sum"), (-11, -2, 0), (0,))
SPREAD += expand_specs(["mto_tot"], ("avg",), (-5,), (-3,))


def _spread_sql(source: str, by: str = "codmesanalisis") -> str:
    """Windows over the grid of customers and months present, by analysis month."""
    frame = lambda s: f"{s.fn}({s.measure}) over (partition by am, c order by m rows between {-s.start} preceding and {-s.end} preceding)"
    return f"""{source}, months as (select distinct codmes as m from w),
ids as (select distinct codmesanalisis as am, codunicocli as c from w),
grid as (select am, c, m, coalesce(mto_tot, 0) as mto_tot, coalesce(ctd_tot, 0) as ctd_tot
  from ids join months on m <= am left join w on w.codmesanalisis = am and w.codunicocli = c and w.codmes = m),
rolled as (select am, c, m, {", ".join(f"{frame(s)} as {s.name}" for s in SPREAD)} from grid)
select am as codmesanalisis, c as codunicocli, {", ".join(s.name for s in SPREAD)} from rolled where m = am"""


def _several_sql(months: tuple[int, ...], without: tuple[int, ...] = ()) -> str:
    values = ", ".join(f"({m})" for m in months)
    skipped = f"and codmes not in ({', '.join(map(str, without))})" if without else ""
    return f"""with {S.panel()}, w as (select t.a as codmesanalisis, panel.* from panel, (values {values}) t(a)
  where (t.a // 100 * 12 + t.a % 100) - (codmes // 100 * 12 + codmes % 100) between 0 and 11 {skipped})"""


def _several(spark, sf, months, without=()):
    panel = A.window_panel(spark, sf, months[0])
    for m in months[1:]:
        panel = panel.unionByName(A.window_panel(spark, sf, m))
    return panel.where(~F.col("codmes").isin(*without)) if without else panel


@query("win_trailing_several_months", _spread_sql(_several_sql((200012, 200011, 200004))))
def win_trailing_several_months(spark, sf):
    return trailing_matrix(_several(spark, sf, (200012, 200011, 200004)), SPREAD, None, KEYS1)


@query("win_trailing_gaps", _spread_sql(_several_sql((200004,), (199908, 200001, 200003))))
def win_trailing_gaps(spark, sf):
    return trailing_matrix(_several(spark, sf, (200004,), (199908, 200001, 200003)), SPREAD, 200004, KEYS1)


@query("agg_frequency_april", S.library("count(*) filter (where ctd_tot > 0) as months_active", 200004).replace("group by all", "group by 1, 2, 3"))
def agg_frequency_april(spark, sf):
    window = A.window_panel(spark, sf, 200004)
    return window.groupBy("codmesanalisis", "codunicocli", "codinternocomputacional").agg(
        F.count_if(F.col("ctd_tot") > 0).alias("months_active")
    )


# Sources and sinks: written through the session's catalog, read back


def _fresh(name: str) -> str:
    """A table name that no earlier session has used: a warehouse outlives the catalog of a session."""
    return f"conformance_{name}_{uuid.uuid4().hex[:12]}"


STORED = ["codmes", "codunicocli", "mto_tot", "ctd_tot"]


def _stored_panel(spark, sf, month: int | None = None):
    """All months of the panel, or one to run again."""
    if month is None:
        return A.orders_panel(spark, sf).select(*STORED)
    return read_months(A.orders_panel(spark, sf, months=(month, month)), month, month, STORED)


def _stored_sql(where: str, value: str = "mto_tot") -> str:
    return f"with {S.panel()} select codmes, codunicocli, {value} as mto_tot, ctd_tot from panel where {where}"


def stored_query(name: str, whole: str, part: str, value: str = "mto_tot"):
    """Two queries of one function, which stores the whole panel: all its rows read back, and those of a few months."""

    def register(fn: Query) -> Query:
        @query(f"{name}_all_months", _stored_sql(whole, value))
        def everything(spark, sf):
            return fn(spark, sf).select(*STORED)

        @query(name, _stored_sql(part, value))
        def some(spark, sf):
            return everything(spark, sf).where(part)

        return fn

    return register


@stored_query("snk_write_matrix", "true", "codmes between 200010 and 200012")
def snk_write_matrix(spark, sf):
    table = _fresh("write")
    sinks.write_matrix(sinks.repartition_for_write(_stored_panel(spark, sf), single_partition=False), table)
    return spark.table(table)


@stored_query("snk_rerun_month", "true", "codmes between 200010 and 200012", "case when codmes = 200011 then -mto_tot else mto_tot end")
def snk_rerun_month(spark, sf):
    table = _fresh("rerun")
    sinks.write_matrix(_stored_panel(spark, sf), table)
    again = _stored_panel(spark, sf, 200011).withColumn("mto_tot", -F.col("mto_tot"))
    sinks.write_matrix(again, table)
    return spark.table(table)


@stored_query("snk_listed_months", "codmes <> 200012", "codmes in (200010, 200011)", "case when codmes = 200011 then mto_tot + 1 else mto_tot end")
def snk_listed_months(spark, sf):
    """Two listed months: one gets new rows, the other has none any more and is cleared."""
    table = _fresh("listed")
    sinks.write_matrix(_stored_panel(spark, sf), table)
    again = _stored_panel(spark, sf, 200011).withColumn("mto_tot", F.col("mto_tot") + 1)
    sinks.write_matrix(again, table, months=[200011, 200012])
    return spark.table(table)


@stored_query("snk_swap_months", "codmes <> 200012", "codmes in (200010, 200011)", "case when codmes = 200011 then mto_tot + 1 else mto_tot end")
def snk_swap_months(spark, sf):
    """The same replacement in two steps, computed from the months that it replaces."""
    table = _fresh("swap")
    sinks.write_matrix(_stored_panel(spark, sf), table)
    again = spark.table(table).where("codmes = 200011").withColumn("mto_tot", F.col("mto_tot") + 1)
    sinks.swap_months(again, table, [200011, 200012])
    return spark.table(table)


@query("snk_stage_path", _stored_sql("true"))
def snk_stage_path(spark, sf):
    """Staged to a folder beside the catalog's tables, and checkpointed where the session has a folder for that."""
    table = _fresh("path")
    staged = sinks.stage_path(_stored_panel(spark, sf), f"{spark.conf.get('spark.sql.warehouse.dir')}/{table}")
    durable = spark.sparkContext.getCheckpointDir() is not None
    return sinks.materialise(staged, durable)


@stored_query("snk_stage", "true", "codmes between 200010 and 200012")
def snk_stage(spark, sf):
    """A stage table, dropped again after its rows were staged once more, and materialised at the end."""
    name = _fresh("stage_a")
    first = sinks.stage_table(_stored_panel(spark, sf), name)
    second = sinks.stage_table(first, _fresh("stage_b"), None)
    sinks.drop_stage(spark, name)
    return sinks.materialise(second)


@stored_query("src_catalog", "ctd_tot > 1", "codmes between 200010 and 200012 and ctd_tot > 1")
def src_catalog(spark, sf):
    name = _fresh("catalog")
    sinks.write_matrix(_stored_panel(spark, sf), name)
    namespace = Namespace(spark.catalog.currentDatabase())
    return read_table(spark, namespace, name).where("ctd_tot > 1")


@query("src_partition", _stored_sql("codmes = 200011"))
def src_partition(spark, sf):
    table = _fresh("partition")
    sinks.write_matrix(_stored_panel(spark, sf), table)
    path = spark.sql(f"describe formatted {table}").where("col_name = 'Location'").first()["data_type"]
    return read_partition(spark, path, 200011).select(*STORED)


@query(
    "prj_feature_columns",
    f"with {S.panel()} select codmes, codunicocli, mto_tot * 2 as doubled, ctd_tot + 1 as one_more from panel",
)
def prj_feature_columns(spark, sf):
    before = A.orders_panel(spark, sf)
    after = before.withColumns({"doubled": F.col("mto_tot") * 2, "one_more": F.col("ctd_tot") + 1})
    return after.select(*C.feature_columns(before.columns, after.columns, ["codmes", "codunicocli"]))


@query(
    "prj_classify",
    f"""with {S.panel()} select 'MTO' as class, count(mto_p1) as n, sum(mto_p1) as total from panel union all
select 'TKT', count(tkt_p1), sum(tkt_p1) from panel union all select 'CTD', count(ctd_p1), sum(ctd_p1) from panel union all
select 'FLG', count(c_flg_p1), sum(c_flg_p1) from panel""",
)
def prj_classify(spark, sf):
    panel = A.orders_panel(spark, sf)
    found = [m for m in C.classify(panel.columns, "_p1")]
    cells = F.array(*(F.struct(F.lit(m.cls).alias("class"), F.col(m.name).cast("double").alias("v")) for m in found))
    rows = panel.select(F.inline(cells))
    return rows.groupBy("class").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@query(
    "per_month_list",
    f"""with {S.ORDERS}, span as (select min(codmes) as a, max(codmes) as b from orders_m),
m as (select unnest(range(a // 100 * 12 + a % 100 - 1, b // 100 * 12 + b % 100)) as i from span),
l as (select i // 12 * 100 + i % 12 + 1 as codmes from m)
select cast(l.codmes as int) as codmes, count(o_orderkey) as n_orders from l left join orders_m using (codmes) group by 1""",
)
def per_month_list(spark, sf):
    first, last = read_run_params(A.run_params(spark, sf))
    months = spark.createDataFrame([(int(m),) for m in P.month_list(first, last)], "codmes int")
    return months.join(A.monthly_orders(spark, sf), "codmes", "left").groupBy("codmes").agg(F.count("o_orderkey").alias("n_orders"))
