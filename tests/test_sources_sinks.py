from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from featmatrix.config import Namespace
from featmatrix.sources import sinks, tables


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(
        [(202400 + m, f"U{c}", f"{c:012d}", float(m * c)) for m in range(1, 13) for c in range(5)],
        "codmes int, codunicocli string, codinternocomputacional string, v double",
    )


def test_namespaces():
    assert Namespace("a.b").target("t") == "a.b.t"
    assert (Namespace("a.b", "c.d").source("t"), Namespace("a.b", "c.d").target("t")) == ("a.b.t", "c.d.t")


def test_partition_by_path_is_pruned(spark, panel, tmp_path, plan_of):
    path = str(tmp_path / "panel")
    panel.write.partitionBy("codmes").parquet(path)
    one = tables.read_partition(spark, path, "202403")
    assert one.count() == 5 and {r.codmes for r in one.collect()} == {202403}
    assert "PartitionFilters: [isnotnull(codmes" in plan_of(one)


def test_month_range(panel):
    rows = tables.read_months(panel, "202402", "202404", ["codmes", "v"])
    assert rows.columns == ["codmes", "v"] and rows.count() == 15


def test_identity_snapshot(spark):
    df = spark.createDataFrame(
        [(202412, "U", " 1 ", "2"), (202411, "U", "1", "2")],
        "codmes int, codunicocli string, codinternocomputacional string, codinternocomputacionalconcepto string",
    )
    assert tables.read_identity(df, 202412).first().codinternocomputacional == " 1 "
    assert tables.read_identity(df, 202412, trim_party=True).first().codinternocomputacional == "1"


def test_run_params(spark):
    df = spark.createDataFrame([(202401.0, 202403.0)], "codmesinicio double, codmesfin double")
    assert tables.read_run_params(df) == ("202401", "202403")
    with pytest.raises(ValueError, match="empty"):
        tables.read_run_params(df.limit(0))


def test_measure_list_ignores_case_and_blanks_and_fails_when_empty(spark):
    df = spark.createDataFrame(
        [("P2", " Concept_POS", "pos_mto "), ("p2 ", "CONCEPT_POS", "POS_CTD"), ("P1", "CONCEPT_POS", "POS_X")],
        "nomgrupo string, nomtablaconcepto string, nomconcepto string",
    )
    assert sorted(tables.measures_for(df, "P2", "concept_pos")) == ["POS_CTD", "POS_MTO"]
    with pytest.raises(ValueError, match="P3"):
        tables.measures_for(df, "P3", "concept_pos")


def test_write_overwrites_only_touched_months(spark, panel):
    spark.sql("DROP TABLE IF EXISTS sink_a")
    sinks.write_matrix(panel, "sink_a")
    sinks.write_matrix(panel.where("codmes = 202403").withColumn("v", F.lit(-1.0)), "sink_a")
    got = {r.codmes: r.s for r in spark.table("sink_a").groupBy("codmes").agg(F.sum("v").alias("s")).collect()}
    assert got[202403] == -5.0 and got[202402] == 20.0 and len(got) == 12
    with pytest.raises(Exception, match="not listed"):
        sinks.write_matrix(panel.withColumn("v", F.lit(0.0)), "sink_a", months=["202401"])
    sinks.write_matrix(panel.where("codmes = 202401").withColumn("v", F.lit(0.0)), "sink_a", months=["202401", 202405])
    got = {r.codmes: r.s for r in spark.table("sink_a").groupBy("codmes").agg(F.sum("v").alias("s")).collect()}
    assert got[202401] == 0.0 and got[202402] == 20.0 and 202405 not in got and len(got) == 11
    sinks.write_matrix(panel.limit(0), "sink_a", months=[202402])
    assert spark.table("sink_a").where("codmes = 202402").count() == 0
    with pytest.raises(ValueError, match="differ"):
        sinks.write_matrix(panel.withColumnRenamed("v", "w"), "sink_a")


def test_write_distribution(panel, plan_of):
    assert sinks.repartition_for_write(panel) is panel
    assert sinks.repartition_for_write(panel, files=3).rdd.getNumPartitions() == 3
    assert "REBALANCE" in plan_of(sinks.repartition_for_write(panel, single_partition=False)).upper()


def test_stages(spark, panel, tmp_path):
    staged = sinks.stage_path(panel, str(tmp_path / "stage"))
    assert staged.count() == 60 and staged.columns == panel.columns
    managed = sinks.stage_table(panel, "stage_m")
    external = sinks.stage_table(panel, "stage_e", path=str(tmp_path / "external"))
    assert managed.count() == external.count() == 60
    sinks.drop_stage(spark, "stage_m", "stage_e", "stage_never_there")
    assert not spark.catalog.tableExists("stage_m") and not spark.catalog.tableExists("stage_e")


def test_materialise(panel):
    cached = sinks.materialise(panel)
    assert cached.is_cached and cached.count() == 60
    cached.unpersist()
    durable = sinks.materialise(panel, durable=True)
    assert durable.count() == 60 and not durable.is_cached


def months_of(spark, table):
    return {r.codmes: (r.n, r.v) for r in spark.table(table).groupBy("codmes").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}


def test_swap_replaces_clears_and_adds_months(spark, panel):
    spark.sql("DROP TABLE IF EXISTS swap_a")
    sinks.write_matrix(panel.where("codmes < 202405"), "swap_a")
    before = months_of(spark, "swap_a")
    old = sinks.partition_location(spark, "swap_a", 202402)
    again = spark.table("swap_a").where("codmes = 202402").withColumn("v", F.col("v") + 1)  # reads what it replaces
    new = panel.where("codmes = 202407")
    moved = sinks.swap_months(again.unionByName(new), "swap_a", [202402, 202403, "202407"])
    after = months_of(spark, "swap_a")
    assert set(moved) == {202402, 202407} and set(after) == {202401, 202402, 202404, 202407}
    assert after[202402] == (5, before[202402][1] + 5) and after[202401] == before[202401]
    where = sinks.partition_location(spark, "swap_a", 202402)
    assert where != old and spark.read.parquet(where).count() == 5
    assert sinks.partition_location(spark, "swap_a", 202403) is None
    system, path = sinks._folder(spark, old)
    assert not system.exists(path)
    # a swapped month is an ordinary partition to later writes
    sinks.write_matrix(panel.where("codmes = 202402"), "swap_a")
    assert months_of(spark, "swap_a") == {**after, 202402: before[202402]}


@pytest.mark.parametrize("failing", [0, 1, 2])
def test_a_failure_between_the_steps_leaves_the_old_months_whole(spark, panel, monkeypatch, failing):
    """Before the catalog is asked, and after it has moved one or two of three months."""
    spark.sql("DROP TABLE IF EXISTS swap_b")
    sinks.write_matrix(panel.where("codmes < 202405"), "swap_b")
    before = months_of(spark, "swap_b")
    point, calls = sinks._point, []

    def broken(spark, table, partition, month, folder, exists):
        calls.append(month)
        if len(calls) == failing + 1:
            raise OSError("catalog is gone")
        point(spark, table, partition, month, folder, exists)

    monkeypatch.setattr(sinks, "_point", broken)
    changed = panel.where("codmes in (202401, 202402)").withColumn("v", -F.col("v"))
    with pytest.raises(OSError, match="gone"):
        sinks.swap_months(changed, "swap_b", [202401, 202402, 202403])
    monkeypatch.undo()
    assert months_of(spark, "swap_b") == before
    sinks.swap_months(changed, "swap_b", [202401, 202402, 202403])
    after = months_of(spark, "swap_b")
    assert after[202401] == (5, -before[202401][1]) and 202403 not in after and after[202404] == before[202404]


def test_swap_refuses_other_months_and_columns(spark, panel):
    from pyspark.errors import PySparkException

    spark.sql("DROP TABLE IF EXISTS swap_c")
    sinks.write_matrix(panel, "swap_c")
    before = months_of(spark, "swap_c")
    with pytest.raises(PySparkException, match="not listed"):
        sinks.swap_months(panel.where("codmes <= 202402"), "swap_c", [202401])
    with pytest.raises(ValueError, match="columns"):
        sinks.swap_months(panel.drop("v"), "swap_c", [202401])
    assert months_of(spark, "swap_c") == before


def test_drop_stage_takes_folders_that_the_catalog_has_forgotten(spark, panel, tmp_path):
    path = str(tmp_path / "left_over")
    sinks.stage_table(panel, "stage_x", path=path)
    sinks.drop_stage(spark, "stage_x", folders=[path])
    sinks.drop_stage(spark, "stage_x")
    assert not (tmp_path / "left_over").exists()


def test_months_from_the_partition_listing(spark, panel):
    for table in ("list_a", "list_b"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    sinks.write_matrix(panel.where("codmes in (202403, 202401)"), "list_a")
    assert tables.listed_periods(spark, "list_a") == [202403, 202401]
    panel.withColumn("part", F.lit("x/y")).write.partitionBy("part", "codmes").saveAsTable("list_b")
    assert tables.listed_periods(spark, "list_b") == list(range(202412, 202400, -1))
    spark.sql("DROP TABLE list_b")
    sinks.stage_table(panel, "list_b", None)
    assert tables.listed_periods(spark, "list_b") is None


def without_broadcasts(spark):
    from contextlib import contextmanager

    @contextmanager
    def off():
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            yield
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    return off()


def exchanged_scans(plan):
    """Tables whose scan has an exchange above it on its own branch, from the indented plan."""
    lines, open_exchanges, found = plan.splitlines(), [], set()
    for line in lines:
        depth = next((i for i, c in enumerate(line) if c.isalpha() or c == "*"), None)
        if depth is None:
            continue
        open_exchanges = [d for d in open_exchanges if d < depth]
        if "Exchange " in line:
            open_exchanges.append(depth)
        if "Scan parquet" in line and open_exchanges:
            found.add(line.split("default.")[1].split("[")[0].strip())
    return found


def test_a_panel_stored_by_its_lookup_key_is_not_shuffled(spark, plan_of):
    from featmatrix.operators.identity import resolve_identity, with_lookup_key
    from featmatrix.operators.joins import LOOKUP_KEY
    from tests.test_matrix import moving_panel

    concept, identity = moving_panel(spark)
    for table in ("keyed_panel", "plain_panel", "keyed_ids"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    keyed = sinks.stage_table(with_lookup_key(concept, "join"), "keyed_panel", "codmes", bucket_by=[LOOKUP_KEY], buckets=8)
    plain = sinks.stage_table(concept, "plain_panel", "codmes")
    ids = sinks.stage_table(identity, "keyed_ids", "codmes")
    results = []
    with without_broadcasts(spark):
        for panel, name in ((keyed, "keyed_panel"), (plain, "plain_panel")):
            rows = []
            for month in (202311, 202312):
                found = resolve_identity(tables.read_months(panel, 202301, month), ids.where(f"codmes = {month}"), "join")
                assert (name in exchanged_scans(plan_of(found, "simple"))) == (name == "plain_panel")
                rows += [tuple(r[c] for c in concept.columns) for r in found.collect()]
            results.append(sorted(rows, key=repr))
    assert results[0] == results[1]


def test_states_stored_by_customer_are_not_shuffled(spark, plan_of):
    from featmatrix.plans.matrix import build_features, features_of_states
    from featmatrix.plans.sliding import month_states
    from tests.test_matrix import RULED, moving_panel, tiny_channel

    concept, identity = moving_panel(spark)
    channel, span = tiny_channel(measures=RULED), [202310, 202311, 202312]
    named = "codunicocli is not null and codinternocomputacional is not null"
    spark.sql("DROP TABLE IF EXISTS stored_states")
    stored = sinks.stage_table(month_states(concept, identity, channel, span).where(named), "stored_states", "codmes", bucket_by=channel.keys.ids, buckets=8)
    ordered = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for month in span:
        found = features_of_states(stored, channel, [month], span, range(202301, 202313), stored=True)
        with without_broadcasts(spark):
            assert "Exchange" not in plan_of(found, "simple")
        assert ordered(found) == ordered(build_features(concept, identity, channel, [month]))


def test_months_are_brought_together_for_a_write(spark, tmp_path):
    rows = spark.range(0, 480, 1, 8).selectExpr("id", "cast(200001 + id % 12 as int) as codmes", "if(id % 3 = 0, null, 'u') as who")
    rows = rows.unionByName(rows.where("id < 24"))  # repeated rows stay
    sinks.spread_by_month(rows).write.partitionBy("codmes").parquet(str(tmp_path / "months"))
    files = [len(list(m.glob("*.parquet"))) for m in (tmp_path / "months").glob("codmes=*")]
    assert files == [1] * 12
    stored = spark.read.parquet(str(tmp_path / "months")).select(*rows.columns)
    assert stored.exceptAll(rows).count() == rows.exceptAll(stored).count() == 0
    sinks.spread_by_month(rows, files=3).write.partitionBy("codmes").parquet(str(tmp_path / "more"))
    assert all(1 < len(list(m.glob("*.parquet"))) <= 3 for m in (tmp_path / "more").glob("codmes=*"))
