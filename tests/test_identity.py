from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from featmatrix.config import UNKNOWN_CLIENT
from featmatrix.operators.identity import base_client, consolidate, consolidation_rule, resolve_identity

IDENTITY = "codmes int, codunicocli string, codinternocomputacional string, codinternocomputacionalconcepto string"
PANEL = "codmes int, codunicocli string, codinternocomputacional string, v double"
PADDED = ".".ljust(12)


@pytest.fixture()
def identity(spark):
    return spark.createDataFrame(
        [
            (202412, "U1", "000000000001", "000000000009"),
            (202412, "U2", "000000000002", "000000000002"),
            (202412, UNKNOWN_CLIENT, "000000000003", "000000000033"),
        ],
        IDENTITY,
    )


CASES = [
    ("Uold", "000000000001", "U1", "000000000009"),  # known party, then its base party
    ("U2", ".", "U2", "000000000002"),  # anonymous party, base party found
    (UNKNOWN_CLIENT, ".", UNKNOWN_CLIENT, "."),  # unknown client keeps its party
    ("U7", ".", "U7", PADDED),  # client without a base party
    ("U8", "000000000077", None, None),  # party not in the snapshot
    ("U9", None, "U9", PADDED),  # NULL party counts as anonymous
    (None, ".", None, "."),
    (UNKNOWN_CLIENT, None, UNKNOWN_CLIENT, None),
    ("Uold3", "000000000003", UNKNOWN_CLIENT, "000000000033"),  # re-keyed to the unknown client
]


@pytest.mark.parametrize("trim", ["group", "join", "none"])
@pytest.mark.parametrize("broadcast_rows", [None, 1000])
def test_rules(spark, identity, trim, broadcast_rows):
    panel = spark.createDataFrame([(202411, c, p, float(i)) for i, (c, p, _, _) in enumerate(CASES)], PANEL)
    got = resolve_identity(panel, identity, trim, broadcast_rows=broadcast_rows).orderBy("v").collect()
    assert [(r.codunicocli, r.codinternocomputacional) for r in got] == [(c, p) for _, _, c, p in CASES]


def test_padding_by_trim_mode(spark, identity):
    panel = spark.createDataFrame([(202411, "Uold", "000000000001  ", 1.0), (202411, "U2 ", ".   ", 2.0)], PANEL)
    pick = lambda trim: [tuple(r)[2:] for r in resolve_identity(panel, identity, trim).orderBy("v").collect()]
    # the join sees untrimmed ids, so neither row finds anything; grouped ids are trimmed
    assert pick("group") == [(None, None), ("U2", PADDED)]
    assert pick("join") == [("U1", "000000000009"), ("U2 ", PADDED)]
    assert pick("none") == [(None, None), ("U2 ", PADDED)]


def test_base_party_is_the_greatest_concept(spark):
    rows = [(202412, "U1", "1", "000000000005"), (202412, "U1", "2", "000000000007")]
    base = base_client(spark.createDataFrame(rows, IDENTITY), ["codmes"]).collect()
    assert [tuple(r) for r in base] == [(202412, "U1", "000000000007")]


def test_repeated_party_fails_or_multiplies(spark, identity):
    panel = spark.createDataFrame([(202411, "U", "000000000001", 1.0)], PANEL)
    twice = identity.unionByName(identity.where("codunicocli = 'U1'").withColumn("codunicocli", F.lit("U5")))
    with pytest.raises(Exception, match="repeated in the identity snapshot"):
        resolve_identity(panel, twice, "group").collect()
    rows = resolve_identity(panel, twice, "group", duplicates="multiply").collect()
    assert sorted(r.codunicocli for r in rows) == ["U1", "U5"]
    with pytest.raises(ValueError):
        resolve_identity(panel, identity, duplicates="ignore")


def test_consolidation_rules(spark):
    assert [consolidation_rule(c) for c in ("A_FLG_B", "a_antmax_b", "A_TIP_B", "A_CTDDIA_B", "A_ANTMIN_B", "A_TKT_B")] == [
        "max", "max", "max", "max", "min", "sum",
    ]
    df = spark.createDataFrame(
        [(202411, "U", "1", 1.0, 0, 5), (202411, "U", "1", 2.0, 1, 3), (202410, "U", "1", 4.0, 1, 9)],
        "codmes int, codunicocli string, codinternocomputacional string, A_MTO_B double, A_FLG_B int, A_ANTMIN_B int",
    )
    got = consolidate(df, ["A_MTO_B", "A_FLG_B", "A_ANTMIN_B"]).orderBy("codmes").collect()
    assert [tuple(r)[3:] for r in got] == [(4.0, 1, 9), (3.0, 1, 3)]


def test_one_panel_exchange_and_spread_null_keys(spark, identity, plan_of):
    """Anonymous unknown rows, even identical ones, must not meet in one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(0, 4000, 1, 40).select(
            F.lit(202411).alias("codmes"), F.lit(UNKNOWN_CLIENT).alias("codunicocli"),
            F.lit(".").alias("codinternocomputacional"), F.lit(1.0).alias("v"),
        )
        joined = resolve_identity(rows, identity, "group")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1600
