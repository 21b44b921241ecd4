from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from featmatrix.config import CTD, FLG, MTO, Channel, Measure, Namespace
from featmatrix.operators.parity import table_hash
from featmatrix.plans.pipeline import RunConfig, months_to_run, run_backfill, run_month, with_registered_measures

SCHEMA = "codmes int, codunicocli string, codinternocomputacional string, x_mto_t double, x_ctd_t double, x_flg_t int"


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    spark.sql("CREATE DATABASE IF NOT EXISTS dst")
    rows = [
        (m, f"U{c}", f"{c:012d}", float(m % 7 * c), float((m + c) % 3), int((m + c) % 3 > 0))
        for m in (*range(202301, 202313), *range(202401, 202405))
        for c in range(1, 9)
        if (m + c) % 4
    ]
    months = sorted({r[0] for r in rows})
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("codmes").mode("overwrite").saveAsTable("src.concept")
    ids = [(m, f"U{c}", f"{c:012d}", f"{c:012d}") for m in months for c in range(1, 9)]
    spark.createDataFrame(
        ids, "codmes int, codunicocli string, codinternocomputacional string, codinternocomputacionalconcepto string"
    ).write.mode("overwrite").saveAsTable("src.hm_detconceptocliente")
    groups = [("P2", "concept ", n) for n in ("x_mto_t", " x_ctd_t", "X_FLG_T")]
    spark.createDataFrame(groups, "nomgrupo string, nomtablaconcepto string, nomconcepto string").write.mode(
        "overwrite"
    ).saveAsTable("src.mm_parametrogrupoconcepto")
    return spark


def params(spark, start: int, end: int) -> None:
    spark.createDataFrame([(float(start), float(end))], "codmesinicio double, codmesfin double").write.mode(
        "overwrite"
    ).saveAsTable("src.mm_parametromatrizvariables")


@pytest.fixture()
def cfg():
    channel = Channel(
        "tiny", "tiny_matrix", "X", (Measure("X_MTO_T", MTO), Measure("X_CTD_T", CTD), Measure("X_FLG_T", FLG)),
        ((MTO,), (CTD,)), frozenset((MTO, CTD)), "group", "double", True, True, "P2",
    )
    return RunConfig(Namespace("src", "dst"), channel, "concept", "2024-05-10", ts=datetime(2024, 5, 10))


def contents(spark, table: str, month: int | None = None):
    df = spark.table(table)
    df = df if month is None else df.where(F.col("codmes") == month)
    return tuple(table_hash(df).first())


def test_backfill_loop_equals_one_job(database, cfg):
    spark = database
    params(spark, 202312, 202404)
    loop, single = replace(cfg, target_table="loop"), replace(cfg, target_table="single")
    assert run_backfill(spark, loop) == ["202404", "202403", "202402", "202401", "202312"]
    assert run_backfill(spark, single, one_job=True) == ["202404", "202403", "202402", "202401", "202312"]
    assert contents(spark, "dst.loop") == contents(spark, "dst.single")
    assert contents(spark, "dst.loop")[0] > 30
    assert not spark.catalog.tableExists("src.loop")


def test_rerun_changes_nothing_and_leaves_other_months(database, cfg):
    spark = database
    one = replace(cfg, target_table="rerun")
    run_month(spark, one, 202403)
    run_month(spark, one, 202404)
    before = contents(spark, "dst.rerun", 202403), contents(spark, "dst.rerun", 202404)
    run_month(spark, one, 202404)
    assert before == (contents(spark, "dst.rerun", 202403), contents(spark, "dst.rerun", 202404))
    run_month(spark, replace(one, run_date="2024-06-01"), 202404)
    assert contents(spark, "dst.rerun", 202403) == before[0]
    assert contents(spark, "dst.rerun", 202404) != before[1]


def test_equal_params_mean_the_closed_month(database, cfg):
    params(database, 202301, 202301)
    assert months_to_run(database, cfg) == ["202404"]
    assert months_to_run(database, replace(cfg, run_date="2024-03-31")) == ["202403"]


def test_reversed_params_raise(database, cfg):
    params(database, 202404, 202301)
    with pytest.raises(ValueError, match="after"):
        run_backfill(database, cfg)


def test_registered_measures(database, cfg):
    assert with_registered_measures(database, cfg) == cfg
    registered = with_registered_measures(database, replace(cfg, registered_layout=True))
    assert [m.name for m in registered.channel.measures] == ["X_CTD_T", "X_FLG_T", "X_MTO_T"]
    wider = replace(cfg, channel=replace(cfg.channel, measures=(*cfg.channel.measures, Measure("X_MTO_U", MTO))))
    with pytest.raises(ValueError, match="X_MTO_U"):
        with_registered_measures(database, wider)
    with pytest.raises(ValueError, match="no columns registered"):
        with_registered_measures(database, replace(cfg, concept_table="other"))


def test_only_needed_partitions_and_columns_are_read(database, cfg, plan_of):
    from featmatrix.plans.pipeline import matrix_for

    plan = plan_of(matrix_for(database, cfg, [202404]), "formatted")
    assert "PartitionFilters: [isnotnull(codmes" in plan and "(codmes#" in plan and "<= 202404" in plan
    assert "PushedFilters" in plan


def test_run_options_reach_the_plan(database, cfg, plan_of):
    from featmatrix.plans.pipeline import matrix_for

    plan = plan_of(matrix_for(database, replace(cfg, partitions=7), [202404]), "simple")
    assert ", 7), REPARTITION_BY_NUM" in plan


def test_unknown_registered_measures_raise(database, cfg):
    database.createDataFrame(
        [("P2", "concept", n) for n in ("X_MTO_T", "X_WEIGHT")], "nomgrupo string, nomtablaconcepto string, nomconcepto string"
    ).write.mode("overwrite").saveAsTable("src.odd_groups")
    with pytest.raises(ValueError, match="X_WEIGHT"):
        with_registered_measures(database, replace(cfg, groups_table="odd_groups", registered_layout=True))
