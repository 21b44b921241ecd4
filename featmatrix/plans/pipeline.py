"""Runs: one month, or a backfill over the months of the run parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from featmatrix.config import KEYS, Channel, Measure, Namespace
from featmatrix.functions.periods import month_list, process_month_end, shift_month
from featmatrix.operators.columns import classify
from featmatrix.operators.densify import distinct_periods
from featmatrix.plans.matrix import LOOK_BACK, build_matrix
from featmatrix.sources.sinks import repartition_for_write, write_matrix
from featmatrix.sources.tables import listed_periods, measures_for, read_months, read_run_params, read_table

# Session options a run relies on; months are overwritten one partition at a time.
SESSION_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    # one task of a several-month matrix writes each month without sorting its wide rows by month first
    "spark.sql.maxConcurrentOutputFileWriters": "24",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


@dataclass(frozen=True)
class RunConfig:
    namespace: Namespace
    channel: Channel
    concept_table: str
    run_date: date | str
    identity_table: str = "hm_detconceptocliente"
    params_table: str = "mm_parametromatrizvariables"
    groups_table: str = "mm_parametrogrupoconcepto"
    target_table: str | None = None
    ts: datetime | None = None
    periods: str = "present"
    registered_layout: bool = False
    partitions: int | None = None  # tasks of the expansion; the session's shuffle partitions by default
    duplicates: str = "raise"
    drop_null_keys: bool = True

    @property
    def target(self) -> str:
        return self.namespace.target(self.target_table or self.channel.target)


def configure_session(spark: SparkSession) -> None:
    for option, value in SESSION_OPTIONS.items():
        spark.conf.set(option, value)


def with_registered_measures(spark: SparkSession, cfg: RunConfig) -> RunConfig:
    """Check the layout against the concept-group table where the channel is registered there.

    The output layout is fixed, so every measure of the channel must be registered. With
    ``registered_layout`` the matrix instead gets the registered measures, sorted by name.
    """
    if cfg.channel.concept_group is None:
        return cfg
    groups = read_table(spark, cfg.namespace, cfg.groups_table)
    names = measures_for(groups, cfg.channel.concept_group, cfg.concept_table)
    if cfg.registered_layout:
        measures: tuple[Measure, ...] = classify(names, cfg.channel.prefix)
        unknown = sorted(set(names) - {m.name for m in measures})
        if unknown:
            raise ValueError(f"registered measures without a known class or prefix: {', '.join(unknown)}")
        return replace(cfg, channel=replace(cfg.channel, measures=measures))
    missing = sorted({m.name.upper() for m in cfg.channel.measures} - set(names))
    if missing:
        raise ValueError(f"measures not registered for group {cfg.channel.concept_group!r}: {', '.join(missing)}")
    return cfg


def months_to_run(spark: SparkSession, cfg: RunConfig) -> list[str]:
    """Analysis months, newest first. Equal start and end mean: the month closed on the run date."""
    start, end = read_run_params(read_table(spark, cfg.namespace, cfg.params_table))
    if start == end:
        start = end = process_month_end(cfg.run_date)
    return month_list(start, end)


def present_months(spark: SparkSession, cfg: RunConfig, months: Sequence[int | str]) -> list[int] | None:
    """Months in the windows of the analysis months, found once for a whole run.

    They come from the catalog's partitions if the concept table is laid out by month, else from its rows.
    """
    if cfg.periods != "present":
        return None
    codes = sorted(int(m) for m in months)
    first, period = int(shift_month(codes[0], -LOOK_BACK)), cfg.channel.keys.period
    listed = listed_periods(spark, cfg.namespace.source(cfg.concept_table), period)
    if listed is not None:
        return [m for m in listed if first <= m <= codes[-1]]
    concept = read_table(spark, cfg.namespace, cfg.concept_table)
    return distinct_periods(read_months(concept, first, codes[-1], [period], period), period)


def matrix_for(
    spark: SparkSession, cfg: RunConfig, months: Sequence[int | str], present: Sequence[int] | None = None
) -> DataFrame:
    return build_matrix(
        read_table(spark, cfg.namespace, cfg.concept_table),
        read_table(spark, cfg.namespace, cfg.identity_table),
        cfg.channel,
        months,
        cfg.run_date,
        cfg.ts,
        periods=cfg.periods,
        present=present,
        partitions=cfg.partitions,
        duplicates=cfg.duplicates,
        drop_null_keys=cfg.drop_null_keys,
    )


def run_month(spark: SparkSession, cfg: RunConfig, month: int | str, present: Sequence[int] | None = None) -> None:
    """Compute one analysis month and overwrite its partition."""
    matrix = repartition_for_write(matrix_for(spark, cfg, [month], present), KEYS.period)
    write_matrix(matrix, cfg.target, KEYS.period, [month])


def run_backfill(spark: SparkSession, cfg: RunConfig, one_job: bool = False) -> list[str]:
    """Run every month of the run parameters; returns the months written, newest first.

    ``one_job`` reads the concept table once for all months at the price of copying each row to its
    (up to twelve) windows; it suits short ranges.
    """
    configure_session(spark)
    cfg = with_registered_measures(spark, cfg)
    months = months_to_run(spark, cfg)
    present = present_months(spark, cfg, months)
    if one_job:
        # no exchange by month before the write: the matrix is many times wider than its input
        write_matrix(matrix_for(spark, cfg, months, present), cfg.target, KEYS.period, months)
    else:
        for month in months:
            run_month(spark, cfg, month, present)
    return months
