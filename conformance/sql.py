"""DuckDB SQL for the oracles, written from the definitions: joins, dense grids and window frames."""

from __future__ import annotations

from conformance.adapter import MONTH, OTHER_SQL, PRIORITIES, operation_sql
from featmatrix.config import UNKNOWN_CLIENT
from featmatrix.plans.channels import AGENT_MONETARY, ATM_MONETARY, OTHER_OPERATIONS, POS_GROUPS

HORIZONS = (3, 6, 9, 12)
FIRST = 200001

ORDERS = """orders_m as (
  select o_orderkey, o_custkey, cast(strftime(o_orderdate, '%Y%m') as int) as codmes,
         cast(substr(o_orderpriority, 1, 1) as int) as prio, o_orderstatus as st,
         cast(round(o_totalprice * 100) as bigint) as cents
  from orders)"""


def ids(sentinels: bool, padded: bool = False) -> str:
    code = "lpad(cast(o_custkey as varchar), 12, '0')"
    if padded:
        code = f"case when o_custkey % 3 = 0 then {code} || '  ' else {code} end"
    client = "'U' || o_custkey"
    if sentinels:
        client = f"case when o_custkey % 13 = 0 then '{UNKNOWN_CLIENT}' else {client} end"
        code = f"case when o_custkey % 13 = 0 or o_custkey % 11 = 0 then '.' else {code} end"
    return f"codmes, {client} as codunicocli, {code} as codinternocomputacional"


def panel(sentinels: bool = False, name: str = "panel") -> str:
    groups = [("tot", "true"), *((f"p{p}", f"prio = {p}") for p in PRIORITIES)]
    sums = ", ".join(
        f"cast(sum(cents) filter (where {t}) as double) as mto_{g}, "
        f"cast(count(*) filter (where {t}) as double) as ctd_{g}"
        for g, t in groups
    )
    cells = ", ".join(
        [f"mto_{g}" for g, _ in groups]
        + [f"ctd_{g}" for g, _ in groups]
        + [f"round(mto_{g} / nullif(ctd_{g}, 0)) as tkt_{g}" for g, _ in groups]
        + [f"cast(ctd_{g} > 0 as int) as c_flg_{g}" for g, _ in groups]
    )
    return f"""{ORDERS},
{name} as (select {ids(sentinels)}, {cells}
  from (select codmes, o_custkey, {sums} from orders_m group by codmes, o_custkey))"""


def window(month: int = MONTH) -> str:
    """CTE ``w``: window rows with analysis month and ordinal."""
    y, m = divmod(month, 100)
    return f"""{panel()},
w as (select {month} as codmesanalisis, panel.*,
        ({y} * 12 + {m}) - (codmes // 100 * 12 + codmes % 100) + 1 as ord
  from panel where ({y} * 12 + {m}) - (codmes // 100 * 12 + codmes % 100) between 0 and 11)"""


def library(select: str, month: int = MONTH) -> str:
    return f"with {window(month)} select codmesanalisis, codunicocli, codinternocomputacional, {select} from w group by all"


def within(n: int, lo: int = 1) -> str:
    return f"filter (where ord between {lo} and {n})"


def identity(months: tuple[int, ...] = (MONTH,)) -> str:
    values = ", ".join(f"({m})" for m in months)
    return f"""ident as (
  select codmes, case when k % 17 = 0 then '{UNKNOWN_CLIENT}' else 'U' || cur end as codunicocli,
         lpad(cast(k as varchar), 12, '0') as codinternocomputacional,
         lpad(cast(cur as varchar), 12, '0') as codinternocomputacionalconcepto
  from (select c_custkey as k, case when c_custkey % 10 = 0 and c_custkey > 0 then c_custkey - 1 else c_custkey end as cur,
               m.codmes from customer, (values {values}) m(codmes))
  where (k + codmes) % 7 <> 0)"""


def resolved(source: str, columns: list[str], trim: str, months: tuple[int, ...] = (MONTH,)) -> str:
    """CTE ``s2``: the two left joins of identity resolution, per analysis month."""
    at_join = "trim(codinternocomputacional)" if trim == "join" else "codinternocomputacional"
    values = ", ".join(f"({m})" for m in months)
    cols = ", ".join(columns)
    return f"""{identity(months)},
snap as (select codmes as am, {at_join} as cic, codunicocli as snap_cuc, codinternocomputacionalconcepto as snap_cic from ident),
base as (select codmes as am, codunicocli as base_cuc, max(codinternocomputacionalconcepto) as base_cic from ident group by all),
p0 as (select t.am, codmes, codunicocli as cuc, {at_join} as cic, {cols} from {source}, (values {values}) t(am)
  where (t.am // 100 * 12 + t.am % 100) - (codmes // 100 * 12 + codmes % 100) between 0 and 11),
s1 as (select p0.*, case when trim(p0.cic) <> '.' then snap_cuc else cuc end as cuc1,
         case when trim(p0.cic) <> '.' then snap_cic else p0.cic end as cic1
  from p0 left join snap on p0.am = snap.am and p0.cic = snap.cic),
s2 as (select s1.*, base_cic from s1 left join base on s1.am = base.am and s1.cuc1 = base.base_cuc)"""


def resolved_ids(trim: str) -> tuple[str, str]:
    t = (lambda c: f"trim({c})") if trim == "group" else (lambda c: c)
    party = (
        f"case when trim(cuc1) <> '{UNKNOWN_CLIENT}' then coalesce({t('base_cic')}, rpad('.', 12, ' ')) "
        f"else {t('cic1')} end"
    )
    return t("cuc1"), party


def consolidated(source: str, columns: list[str], trim: str, months: tuple[int, ...] = (MONTH,)) -> str:
    client, party = resolved_ids(trim)
    rule = lambda c: f"max({c})" if "_FLG_" in c.upper() else f"sum({c})"
    return f"""{resolved(source, columns, trim, months)},
cons as (select am, codmes, {client} as cuc, {party} as cic, {", ".join(f"{rule(c)} as {c}" for c in columns)}
  from s2 group by 1, 2, 3, 4)"""


def pos_source() -> str:
    sums, cells = [], []
    for i, g in enumerate(POS_GROUPS, 1):
        hit = f"filter (where brand = {i})"
        sums.append(f"coalesce(sum(cents) {hit}, 0) as m{i}, count(*) {hit} as n{i}")
        cells += [
            f"cast(m{i} as double) as POS_MTO_TRX_{g}",
            f"coalesce(round(m{i} / nullif(cast(n{i} as double), 0)), 0) as POS_TKT_TRX_{g}",
            f"cast(n{i} as double) as POS_CTD_TRX_{g}",
            f"cast(n{i} > 0 as int) as POS_FLG_TRX_{g}",
        ]
    return f"""{ORDERS},
panel as (select {ids(True)}, {", ".join(cells)} from (
  select codmes, o_custkey, {", ".join(sums)}
  from (select codmes, o_custkey, cast(regexp_extract(p_brand, '(\\d+)$', 1) as int) as brand,
               cast(round(l_extendedprice * 100) as bigint) as cents
        from lineitem join part on l_partkey = p_partkey join orders_m on l_orderkey = o_orderkey)
  group by codmes, o_custkey))"""


def can_source(device: str, monetary: tuple[str, ...]) -> str:
    cells = []
    for o in monetary:
        n = "_".join(x for x in (device, o) if x)
        test = operation_sql(o)
        mto, ctd = f"coalesce(sum(cents) filter (where {test}), 0)", f"count(*) filter (where {test})"
        cells += [
            f"cast({mto} as double) as CAN_MTO_TMO_{n}",
            f"coalesce(round({mto} / nullif(cast({ctd} as double), 0)), 0) as CAN_TKT_TMO_{n}",
            f"cast({ctd} as double) as CAN_CTD_TMO_{n}",
            f"cast({ctd} > 0 as int) as CAN_FLG_TMO_{n}",
        ]
    for o in OTHER_OPERATIONS:
        n = "_".join(x for x in (device, o) if x)
        ctd = f"count(*) filter (where {OTHER_SQL[o]})"
        cells += [f"cast({ctd} as double) as CAN_CTD_TNM_{n}", f"cast({ctd} > 0 as int) as CAN_FLG_TNM_{n}"]
    return f"""{ORDERS},
panel as (select {ids(True, padded=True)}, cells.* exclude (codmes, o_custkey) from (
  select codmes, o_custkey, {", ".join(cells)} from orders_m group by codmes, o_custkey) cells)"""


def measure_names(channel: str) -> dict[str, list[str]]:
    """Measures per class."""
    if channel == "pos":
        return {c: [f"POS_{c}_TRX_{g}" for g in POS_GROUPS] for c in ("MTO", "TKT", "CTD", "FLG")}
    device, monetary = ("AGT", AGENT_MONETARY) if channel == "agent" else ("ATM", ATM_MONETARY)
    tmo = [("TMO", "_".join(x for x in (device, o) if x)) for o in monetary]
    tnm = [("TNM", "_".join(x for x in (device, o) if x)) for o in OTHER_OPERATIONS]
    out = {c: [f"CAN_{c}_{f}_{n}" for f, n in tmo] for c in ("MTO", "TKT")}
    out.update({c: [f"CAN_{c}_{f}_{n}" for f, n in tmo + tnm] for c in ("CTD", "FLG")})
    return out


def matrix(
    channel: str, months: tuple[int, ...] = (MONTH,), keep=lambda measure: True, without: tuple[int, ...] = ()
) -> str:
    """Whole matrix by row windows over the dense customer x month grid; ``keep`` selects measures."""
    source = pos_source() if channel == "pos" else can_source(
        *(("AGT", AGENT_MONETARY) if channel == "agent" else ("ATM", ATM_MONETARY))
    )
    trim = "group" if channel == "pos" else "join"
    by_class = {c: [m for m in ms if keep(m)] for c, ms in measure_names(channel).items()}
    measures = [m for ms in by_class.values() for m in ms]
    with_previous = ("MTO", "TKT", "CTD") if channel == "pos" else ("MTO", "TKT")
    freq_type = "double" if channel == "pos" else "bigint"

    def over(fn: str, m: str, a: int, b: int) -> str:
        return f"{fn}({m}) over (partition by am, cuc, cic order by codmes rows between {a} preceding and {b} preceding)"

    raw, final = [], []
    suffix = lambda n: f"U{n}" if n == 12 else f"U{n}M"
    for cls, names in by_class.items():
        for m in names:
            raw.append(f"{m} as {m}_v0")
            if cls == "FLG":
                u1m = f"cast({m}_v0 as int)"
                final.append(f"{f'case when {u1m} = 1 then 1 else 0 end' if channel == 'pos' else u1m} as {m}_U1M")
            else:
                final.append(f"cast({m}_v0 as double) as {m}_U1M")
            for n in HORIZONS:
                s = suffix(n)
                raw.append(f"{over('max', m, n - 1, 0)} as {m}_mx{n}")
                if cls == "FLG":
                    raw.append(f"{over('sum', m, n - 1, 0)} as {m}_s{n}")
                    x = f"X{n}_{s}" if n == 12 else f"X{n}M_{s}"
                    final.append(f"case when {m}_s{n} = {n} then 1 else 0 end as {m}_{x}")
                    final.append(f"cast({m}_mx{n} as int) as {m}_MAX_{s}")
                    continue
                raw.append(f"{over('avg', m, n - 1, 0)} as {m}_a{n}, {over('min', m, n - 1, 0)} as {m}_mn{n}")
                final += [f"{m}_a{n} as {m}_PRM_{s}", f"{m}_mx{n} as {m}_MAX_{s}"]
                if cls == "CTD":
                    final.append(f"case when {m}_f{n} < {n} then 0 else {m}_mn{n} end as {m}_MIN_{s}")
                    final.append(f"cast({m}_f{n} as {freq_type}) as {m}_FRQ_{s}")
                else:
                    final.append(f"{m}_mn{n} as {m}_MIN_{s}")
            if cls == "CTD":
                final.append(f"cast({m}_rec as double) as {m}_REC")
            if cls in with_previous:
                raw.append(
                    f"{over('avg', m, 11, 6)} as {m}_p6, {over('avg', m, 5, 3)} as {m}_p3, {over('avg', m, 1, 1)} as {m}_p1"
                )
                final += [f"{m}_p6 as {m}_PRM_P6M", f"{m}_p3 as {m}_PRM_P3M", f"{m}_p1 as {m}_P1M"]
                final += [
                    f"round({m}_a6 / nullif({m}_p6, 0), 8) as {m}_G6M",
                    f"round({m}_a3 / nullif({m}_p3, 0), 8) as {m}_G3M",
                    f"round({m}_v0 / nullif({m}_p1, 0), 8) as {m}_G1M",
                ]
    ordinal = "(am // 100 * 12 + am % 100) - (codmes // 100 * 12 + codmes % 100) + 1"
    activity = ", ".join(
        [f"count(*) filter (where {m} > 0 and {ordinal} <= {n}) as {m}_f{n}" for m in by_class["CTD"] for n in HORIZONS]
        + [f"coalesce(min({ordinal}) filter (where {m} > 0), 0) as {m}_rec" for m in by_class["CTD"]]
    )
    party = "trim(cic)" if channel == "pos" else "cic"
    filled = ", ".join(f"coalesce(cons.{m}, 0) as {m}" for m in measures)
    final = [f.rsplit(" as ", 1)[0] + " as " + f.rsplit(" as ", 1)[1].lower() for f in final]
    rows = "panel"
    if without:
        source += f", kept_months as (select * from panel where codmes not in {tuple(without)})"
        rows = "kept_months"
    return f"""with {source},
{consolidated(rows, measures, trim, months)},
customers as (select distinct am, cuc, cic from cons where cuc is not null and cic is not null),
present as (select distinct am, codmes from cons),
dense as (select c.am, c.cuc, c.cic, p.codmes, {filled}
  from customers c join present p on c.am = p.am
  left join cons on cons.am = c.am and cons.cuc = c.cuc and cons.cic = c.cic and cons.codmes = p.codmes),
rolled as (select am, cuc, cic, codmes, {", ".join(raw)} from dense),
activity as (select am, cuc, cic, {activity} from cons group by am, cuc, cic)
select rolled.cuc as codunicocli, rolled.cuc as codclaveunicocli, {party.replace("cic", "rolled.cic")} as codinternocomputacional,
       rolled.am as codmesanalisis, {", ".join(final)}, date '2001-01-05' as fecrutina,
       timestamp '2001-01-05 10:20:30' as fecactualizacionregistro, rolled.am as codmes
from rolled join activity using (am, cuc, cic) where rolled.codmes = rolled.am"""
