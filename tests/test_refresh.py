from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from featmatrix.config import Namespace
from featmatrix.plans.pipeline import RunConfig, run_month
from featmatrix.plans.refresh import Refreshed, digest_table, refresh_month
from featmatrix.sources import sinks
from tests.test_matrix import RULED, moving_panel, tiny_channel


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS late")
    concept, identity = moving_panel(spark)
    identity.write.mode("overwrite").saveAsTable("late.identity")
    return concept, identity


def config(name, concept="concept", **changes):
    channel = tiny_channel(measures=RULED, trim_output_party=True)
    return RunConfig(
        Namespace("late"), channel, concept, "2024-01-05", "identity", target_table=name, ts=datetime(2024, 1, 5), **changes
    )


def store(spark, df, name):
    spark.sql(f"DROP TABLE IF EXISTS late.{name}")
    sinks.write_matrix(df, f"late.{name}")


def rows(spark, cfg):
    return sorted((tuple(r) for r in spark.table(cfg.target).collect()), key=repr)


def refreshed_and_whole(spark, name, before, after):
    """Refresh over changed input, and a full run of it: the report, and whether the matrices are equal."""
    cfg = config(f"{name}_a", f"{name}_concept")
    spark.sql(f"DROP TABLE IF EXISTS {cfg.target}")
    spark.sql(f"DROP TABLE IF EXISTS {digest_table(cfg)}")
    store(spark, before, f"{name}_concept")
    first = refresh_month(spark, cfg, 202312)
    assert first.whole and first.changed == first.customers == spark.table(cfg.target).count()
    store(spark, after, f"{name}_concept")
    report = refresh_month(spark, cfg, 202312)
    full = replace(cfg, target_table=f"{name}_b")
    spark.sql(f"DROP TABLE IF EXISTS {full.target}")
    run_month(spark, full, 202312)
    assert rows(spark, cfg) == rows(spark, full)
    return report


def test_only_customers_with_changed_rows_are_computed_again(spark, database):
    concept, _ = database
    some = F.col("codinternocomputacional").isin("P3", "P17")
    changed = concept.withColumn("X_MTO_T", F.when(some & (F.col("codmes") == 202309), F.lit(77.0)).otherwise(F.col("X_MTO_T")))
    report = refreshed_and_whole(spark, "cell", concept, changed)
    assert not report.whole and 1 <= report.changed <= 2 and report.gone == 0 and report.customers > 20


def test_rows_that_arrive_late_repeat_or_go(spark, database):
    concept, _ = database
    party = F.col("codinternocomputacional")
    early = concept.where(~((party == "P5") & (F.col("codmes") >= 202310))).where(party != "P9")
    late = concept.where(party != "P20").unionByName(concept.where("codinternocomputacional = 'P21' and codmes = 202311"))
    report = refreshed_and_whole(spark, "rows", early, late)
    assert not report.whole and 0 < report.changed < report.customers / 2


def test_a_customer_without_rows_is_gone(spark, database):
    concept, identity = database
    alone = spark.createDataFrame([(202306, "UX", ".", 1.0, 1.0, 1.0, 1.0, 1.0, 1)], concept.schema)
    report = refreshed_and_whole(spark, "gone", concept.unionByName(alone), concept)
    assert (report.changed, report.gone, report.whole) == (0, 1, False)


def test_unchanged_input_writes_nothing(spark, database):
    concept, _ = database
    store(spark, concept, "same_concept")
    cfg = config("same", "same_concept")
    spark.sql(f"DROP TABLE IF EXISTS {cfg.target}")
    spark.sql(f"DROP TABLE IF EXISTS {digest_table(cfg)}")
    refresh_month(spark, cfg, 202312)
    where = sinks.partition_location(spark, cfg.target, 202312)
    report = refresh_month(spark, replace(cfg, run_date="2024-02-01"), 202312)
    assert report == Refreshed(0, 0, report.customers, False)
    assert sinks.partition_location(spark, cfg.target, 202312) == where


def test_a_new_snapshot_changes_the_customers_that_it_rekeys(spark, database):
    concept, identity = database
    store(spark, concept, "ids_concept")
    spark.sql("DROP TABLE IF EXISTS late.ids")
    identity.write.saveAsTable("late.ids")
    cfg = replace(config("ids_a", "ids_concept"), identity_table="ids")
    for t in (cfg.target, digest_table(cfg), "late.ids_b"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    refresh_month(spark, cfg, 202312)
    moved = F.when((F.col("codinternocomputacional") == "P4") & (F.col("codmes") == 202312), F.lit("U900")).otherwise(F.col("codunicocli"))
    again = replace(cfg, identity_table="ids_2")
    spark.sql("DROP TABLE IF EXISTS late.ids_2")
    identity.withColumn("codunicocli", moved).write.saveAsTable("late.ids_2")
    report = refresh_month(spark, again, 202312)
    full = replace(again, target_table="ids_b")
    run_month(spark, full, 202312)
    assert rows(spark, again) == rows(spark, full) and 0 < report.changed + report.gone < 8


def test_months_that_come_to_be_present_change_everybody(spark, database):
    concept, _ = database
    report = refreshed_and_whole(spark, "present", concept.where("codmes <> 202308"), concept)
    assert not report.whole and report.changed == report.customers


def test_null_customers_cannot_be_refreshed(spark, database):
    store(spark, database[0], "null_concept")
    with pytest.raises(ValueError, match="identity"):
        refresh_month(spark, config("nulls", "null_concept", drop_null_keys=False), 202312)
