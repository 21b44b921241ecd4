"""Concept panels, identity maps and metadata derived from the sample tables.

Amounts are whole cents, so sums are exact in any order. Some customers are anonymous (party "."), some
are unknown clients, some re-keyed and some missing from the identity map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmatrix.config import ANONYMOUS_ID, UNKNOWN_CLIENT
from featmatrix.functions.periods import month_of_col, shift_month
from featmatrix.plans.channels import AGENT_MONETARY, ATM_MONETARY, OTHER_OPERATIONS, POS_GROUPS

MONTH = 200012
BACKFILL = (200010, 200011, 200012)
PRIORITIES = (1, 2, 3, 4, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def _first_day(month: int) -> Column:
    return F.lit(f"{month // 100}-{month % 100:02d}-01 00:00:00").cast("timestamp_ntz")


def monthly_orders(spark: SparkSession, sf_dir: str, months: tuple[int, int] | None = None) -> DataFrame:
    """Orders with their month. ``months`` (first, last) filters the raw date, so that the scan is pruned."""
    orders = table(spark, sf_dir, "orders")
    if months is not None:
        day = F.col("o_orderdate")
        orders = orders.where((day >= _first_day(months[0])) & (day < _first_day(int(shift_month(months[1], 1)))))
    return orders.select(
        "o_orderkey",
        "o_custkey",
        month_of_col(F.col("o_orderdate")).alias("codmes"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"),
        F.col("o_orderstatus").alias("st"),
        _cents("o_totalprice").alias("cents"),
    )


def _client(sentinels: bool) -> Column:
    named = F.concat(F.lit("U"), F.col("o_custkey").cast("string"))
    return F.when(F.col("o_custkey") % 13 == 0, F.lit(UNKNOWN_CLIENT)).otherwise(named) if sentinels else named


def _party(sentinels: bool, padded: bool = False) -> Column:
    code = F.lpad(F.col("o_custkey").cast("string"), 12, "0")
    if padded:
        code = F.when(F.col("o_custkey") % 3 == 0, F.concat(code, F.lit("  "))).otherwise(code)
    anonymous = (F.col("o_custkey") % 13 == 0) | (F.col("o_custkey") % 11 == 0)
    return F.when(anonymous, F.lit(ANONYMOUS_ID)).otherwise(code) if sentinels else code


def _ids(sentinels: bool, padded: bool = False) -> list[Column]:
    return [
        F.col("codmes"),
        _client(sentinels).alias("codunicocli"),
        _party(sentinels, padded).alias("codinternocomputacional"),
    ]


def _ticket(amount: Column, count: Column) -> Column:
    return F.round(amount / F.nullif(count, F.lit(0)))


def orders_panel(
    spark: SparkSession, sf_dir: str, sentinels: bool = False, months: tuple[int, int] | None = None
) -> DataFrame:
    """Total and five order priorities. Measures of a priority without orders are NULL, counts are zero."""
    aggs = [F.sum("cents").cast("double").alias("mto_tot"), F.count(F.lit(1)).cast("double").alias("ctd_tot")]
    for p in PRIORITIES:
        hit = F.col("prio") == p
        aggs.append(F.sum(F.when(hit, F.col("cents"))).cast("double").alias(f"mto_p{p}"))
        aggs.append(F.count_if(hit).cast("double").alias(f"ctd_p{p}"))
    rows = monthly_orders(spark, sf_dir, months).groupBy("codmes", "o_custkey").agg(*aggs)
    groups = ["tot", *(f"p{p}" for p in PRIORITIES)]
    return rows.select(
        *_ids(sentinels),
        *(f"mto_{g}" for g in groups),
        *(f"ctd_{g}" for g in groups),
        *(_ticket(F.col(f"mto_{g}"), F.col(f"ctd_{g}")).alias(f"tkt_{g}") for g in groups),
        *((F.col(f"ctd_{g}") > 0).cast("int").alias(f"c_flg_{g}") for g in groups),
    )


def window_panel(spark: SparkSession, sf_dir: str, month: int = MONTH) -> DataFrame:
    """The twelve months up to the analysis month, which is added as a column."""
    first = int(shift_month(month, -11))
    panel = orders_panel(spark, sf_dir, months=(first, month)).where(F.col("codmes").between(first, month))
    return panel.select(F.lit(month).alias("codmesanalisis"), "*")


def identity_map(spark: SparkSession, sf_dir: str, months: Sequence[int] = (MONTH,)) -> DataFrame:
    key = F.col("c_custkey")
    current = F.when((key % 10 == 0) & (key > 0), key - 1).otherwise(key)
    party = F.lpad(key.cast("string"), 12, "0")
    named = F.concat(F.lit("U"), current.cast("string"))
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", F.explode(F.array(*(F.lit(m) for m in months))).alias("codmes"))
        .where((key + F.col("codmes")) % 7 != 0)
        .select(
            "codmes",
            F.when(key % 17 == 0, F.lit(UNKNOWN_CLIENT)).otherwise(named).alias("codunicocli"),
            party.alias("codinternocomputacional"),
            F.lpad(current.cast("string"), 12, "0").alias("codinternocomputacionalconcepto"),
        )
    )


def pos_panel(spark: SparkSession, sf_dir: str, months: tuple[int, int] | None = None) -> DataFrame:
    """Twenty-five merchant groups, one per part brand."""
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", _cents("l_extendedprice").alias("cents"))
        .join(table(spark, sf_dir, "part").select("p_partkey", brand.alias("brand")), F.expr("l_partkey = p_partkey"))
        .join(monthly_orders(spark, sf_dir, months).drop("cents"), F.expr("l_orderkey = o_orderkey"))
    )
    wide = (
        lines.groupBy("codmes", "o_custkey")
        .pivot("brand", list(range(1, len(POS_GROUPS) + 1)))
        .agg(F.sum("cents").alias("mto"), F.count(F.lit(1)).alias("ctd"))
    )
    cells = []
    for i, g in enumerate(POS_GROUPS, 1):
        mto, ctd = F.coalesce(F.col(f"{i}_mto"), F.lit(0)).cast("double"), F.coalesce(F.col(f"{i}_ctd"), F.lit(0))
        cells += [
            mto.alias(f"POS_MTO_TRX_{g}"),
            F.coalesce(_ticket(mto, ctd), F.lit(0.0)).alias(f"POS_TKT_TRX_{g}"),
            ctd.cast("double").alias(f"POS_CTD_TRX_{g}"),
            (ctd > 0).cast("int").alias(f"POS_FLG_TRX_{g}"),
        ]
    return wide.select(*_ids(True), *cells)


# Which orders count for an operation; shared by the agent and cash-machine panels and by their oracles.
OPERATION_SQL = {
    "": "true",
    "SOL": "st <> 'F'",
    "DOL": "st = 'F'",
    "RET": "prio = 1",
    "DEP": "prio = 2",
    "TRF": "prio = 3",
    "ADS": "prio = 4",
    "DIS": "prio = 5",
    "PAG_TCR": "cents >= 40000000",
    "PAG_BCP": "cents >= 30000000 and cents < 40000000",
    "PAG_SRV": "cents >= 20000000 and cents < 30000000",
    "EMIS": "cents >= 10000000 and cents < 20000000",
    "DGIR": "cents < 10000000",
}
OTHER_SQL = {"": "st = 'P'", "CSLT": "st = 'P' and prio <= 2", "ADMN": "st = 'P' and prio > 2"}


def operation_sql(operation: str) -> str:
    if operation in OPERATION_SQL:
        return OPERATION_SQL[operation]
    kind, currency = operation.split("_")
    return f"{OPERATION_SQL[kind]} and {OPERATION_SQL[currency]}"


def _can_panel(
    spark: SparkSession, sf_dir: str, device: str, monetary: Sequence[str], months: tuple[int, int] | None
) -> DataFrame:
    aggs, cells = [], []
    name = lambda cls, family, o: "_".join(x for x in ("CAN", cls, family, device, o) if x)
    for family, operations in (("TMO", monetary), ("TNM", OTHER_OPERATIONS)):
        for o in operations:
            test = operation_sql(o) if family == "TMO" else OTHER_SQL[o]
            ctd = name("CTD", family, o)
            aggs.append(F.expr(f"cast(count_if({test}) as double)").alias(ctd))
            cells += [F.col(ctd), (F.col(ctd) > 0).cast("int").alias(name("FLG", family, o))]
            if family == "TMO":
                mto = name("MTO", family, o)
                aggs.append(F.expr(f"cast(coalesce(sum(case when {test} then cents end), 0) as double)").alias(mto))
                ticket = F.coalesce(_ticket(F.col(mto), F.col(ctd)), F.lit(0.0))
                cells += [F.col(mto), ticket.alias(name("TKT", family, o))]
    rows = monthly_orders(spark, sf_dir, months).groupBy("codmes", "o_custkey").agg(*aggs)
    return rows.select(*_ids(True, padded=True), *cells)


def agent_panel(spark: SparkSession, sf_dir: str, months: tuple[int, int] | None = None) -> DataFrame:
    return _can_panel(spark, sf_dir, "AGT", AGENT_MONETARY, months)


def atm_panel(spark: SparkSession, sf_dir: str, months: tuple[int, int] | None = None) -> DataFrame:
    return _can_panel(spark, sf_dir, "ATM", ATM_MONETARY, months)


def run_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last month of the orders, as numbers with decimals like the parameter table holds them."""
    months = monthly_orders(spark, sf_dir)
    return months.agg(
        F.min("codmes").cast("double").alias("codmesinicio"), F.max("codmes").cast("double").alias("codmesfin")
    )


def measure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept-group table with stray blanks, one row per part."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), (F.col("p_size") % 3 + 1).cast("string")).alias("nomgrupo"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("hm_concepto_"), F.lower("p_type"), F.lit(" ")))
        .otherwise(F.concat(F.lit("HM_CONCEPTO_"), F.col("p_type")))
        .alias("nomtablaconcepto"),
        F.concat(F.lit("c_"), F.col("p_partkey").cast("string")).alias("nomconcepto"),
    )
