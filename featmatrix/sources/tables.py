"""Reading tables, month ranges, identity snapshots, run parameters and measure lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmatrix.config import KEYS, KeyColumns, Namespace


def read_table(spark: SparkSession, ns: Namespace, name: str) -> DataFrame:
    return spark.table(ns.source(name))


def read_partition(
    spark: SparkSession, path: str, month: int | str, period: str = KEYS.period, fmt: str = "parquet"
) -> DataFrame:
    """One month of a table partitioned by ``period``; the filter prunes to a single folder."""
    return spark.read.format(fmt).load(path).where(F.col(period) == int(month))


def read_months(
    df: DataFrame, first: int | str, last: int | str, cols: Sequence[str] | None = None, period: str = KEYS.period
) -> DataFrame:
    """Rows of months ``first..last``. The raw column is compared with integers so that it prunes."""
    rows = df.where(F.col(period).between(int(first), int(last)))
    return rows if cols is None else rows.select(*cols)


def listed_periods(spark: SparkSession, table: str, period: str = KEYS.period) -> list[int] | None:
    """Months of a table from the catalog's list of partitions, newest first; None if the table is not laid out by month.

    No data is read. A month whose partition has no rows is listed too, as is one that is stored under several
    further partition columns.
    """
    described = spark.sql(f"DESCRIBE TABLE {table}").collect()
    names = [r.col_name for r in described]
    if "# Partition Information" not in names or period.lower() not in {
        n.lower() for n in names[names.index("# Partition Information") + 1 :]
    }:
        return None
    found = set()
    for (spec,) in spark.sql(f"SHOW PARTITIONS {table}").collect():
        values = dict(part.split("=", 1) for part in spec.split("/"))
        value = {k.lower(): v for k, v in values.items()}[period.lower()]
        if value.lstrip("-").isdigit():
            found.add(int(value))
    return sorted(found, reverse=True)


def read_identity(df: DataFrame, month: int | str, trim_party: bool = False, keys: KeyColumns = KEYS) -> DataFrame:
    """Identity snapshot of one month."""
    party = F.trim(keys.party) if trim_party else F.col(keys.party)
    return df.where(F.col(keys.period) == int(month)).select(
        keys.period, keys.client, party.alias(keys.party), keys.concept
    )


def read_run_params(df: DataFrame, start: str = "codmesinicio", end: str = "codmesfin") -> tuple[str, str]:
    """First and last analysis month from the run-parameter table."""
    row = df.select(*(F.col(c).cast("int").cast("string") for c in (start, end))).first()
    if row is None:
        raise ValueError("the run-parameter table is empty")
    return row[0], row[1]


def _same_text(column: str, value: str):
    return F.upper(F.trim(column)) == value.strip().upper()


def measure_rows(df_meta: DataFrame, group: str, table: str) -> DataFrame:
    """Measure names registered for (group, table), ignoring case and stray blanks."""
    return df_meta.where(_same_text("nomgrupo", group) & _same_text("nomtablaconcepto", table)).select(
        F.upper(F.trim("nomconcepto")).alias("nomconcepto")
    )


def measures_for(df_meta: DataFrame, group: str, table: str) -> list[str]:
    """Sorted measure names: one entry per column of the concept table, so small by nature."""
    names = sorted(r[0] for r in measure_rows(df_meta, group, table).collect())
    if not names:
        raise ValueError(f"no columns registered for group {group!r} and table {table!r}")
    return names
