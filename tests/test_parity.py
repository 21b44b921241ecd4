from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from featmatrix.operators import parity as P

KEYS = ["m", "k"]
SCHEMA = "m int, k string, v double, w int, t string"


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame([(1, "x", 1.0, 5, "A "), (1, "y", 2.0, 6, "b"), (2, "z", None, 7, None), (2, None, 1.0, 1, "n")], SCHEMA)


@pytest.fixture(scope="module")
def b(spark):
    return spark.createDataFrame([(1, "x", 1.5, 5, "a"), (1, "y", 2.0, 8, "b"), (3, "z", None, 7, None), (2, None, 1.0, 1, "n")], SCHEMA)


def test_a_table_equals_itself(a):
    assert P.schema_diff(a, a).count() == 0
    assert P.key_diff(a, a, KEYS).count() == 0
    assert P.cell_diff(a, a, KEYS).count() == 0
    assert P.count_diff(a, a, ["m"]).where("rows_diff <> 0").count() == 0
    assert P.table_hash(a).first() == P.table_hash(a.orderBy(F.desc("w")).repartition(3)).first()


def test_schema(a):
    other = a.select("m", "k", F.col("v").cast("float"), "t", "w").withColumnRenamed("t", "u")
    got = {r.column_name: (r.position_a, r.position_b, r.type_a, r.type_b) for r in P.schema_diff(a, other).collect()}
    assert got == {
        "v": (2, 2, "double", "float"), "w": (3, 4, "int", "int"), "t": (4, None, "string", None), "u": (None, 3, None, "string"),
    }


def test_counts_and_keys(a, b):
    assert {tuple(r) for r in P.count_diff(a, b, ["m"]).collect()} == {(1, 2, 2, 0), (2, 2, 1, 1), (3, 0, 1, -1)}
    assert {tuple(r) for r in P.key_diff(a, b, KEYS).collect()} == {(2, "z", "only_a"), (3, "z", "only_b")}


def cells(df):
    return {(r.k, r.column_name): r.abs_diff for r in df.collect()}


def test_cells(a, b):
    assert cells(P.cell_diff(a, b, KEYS)) == {("x", "v"): 0.5, ("x", "t"): None, ("y", "w"): 2.0}
    assert cells(P.cell_diff(a, b, KEYS, ignore_case=True, eps=1.0)) == {("y", "w"): 2.0}
    assert cells(P.cell_diff(a, b, KEYS, eps_by_column={"w": 2.0}, columns=["w", "t"])) == {("x", "t"): None}
    with pytest.raises(ValueError, match="no columns"):
        P.cell_diff(a, b.select(*KEYS), KEYS)


def test_missing_against_value_is_a_difference(spark):
    one = spark.createDataFrame([(1, "x", None)], "m int, k string, v double")
    two = spark.createDataFrame([(1, "x", 0.0)], "m int, k string, v double")
    assert cells(P.cell_diff(one, two, KEYS, eps=10.0)) == {("x", "v"): None}


def test_null_keys_are_compared(spark):
    one = spark.createDataFrame([(1, None, 1.0)], "m int, k string, v double")
    two = spark.createDataFrame([(1, None, 99.0)], "m int, k string, v double")
    assert cells(P.cell_diff(one, two, KEYS)) == {(None, "v"): 98.0}


def test_names_match_without_case(spark):
    one = spark.createDataFrame([(1, "x", 1.0)], "m int, k string, V double")
    two = spark.createDataFrame([(1, "x", 2.0)], "m int, k string, v double")
    assert cells(P.cell_diff(one, two, KEYS)) == {("x", "V"): 1.0}


def test_large_integers_and_decimals_are_compared_as_they_are(spark):
    one = spark.sql("select 1 m, 'x' k, 9007199254740993L v, cast('12345678901234567890.01' as decimal(30,2)) d")
    two = spark.sql("select 1 m, 'x' k, 9007199254740992L v, cast('12345678901234567890.02' as decimal(30,2)) d")
    assert cells(P.cell_diff(one, two, KEYS)) == {("x", "v"): 1.0, ("x", "d"): 0.01}
    assert cells(P.cell_diff(one, two, KEYS, eps=2.0)) == {}


def test_repeated_keys_raise(spark):
    one = spark.createDataFrame([(1, "x", 1.0), (1, "x", 2.0)], "m int, k string, v double")
    with pytest.raises(Exception, match="more than once"):
        P.cell_diff(one, one, KEYS).collect()


def test_hashes_keep_values_and_nulls_apart(spark):
    df = spark.createDataFrame(
        [(1, "a", "p|q", "r"), (2, "b", "p", "q|r"), (3, "c", None, "5"), (4, "d", "5", None), (5, "e", "n", "5")],
        "m int, k string, s string, t string",
    )
    assert len({r.row_hash for r in P.row_hash(df, keys=KEYS).collect()}) == 5
    one, two = (df.where(f"m = {i}").select("s", "t") for i in (3, 4))
    assert P.table_hash(one).first() != P.table_hash(two).first()


def test_sample_reports_keys_of_either_side(spark):
    one = spark.createDataFrame([(1, "x", 1.0), (1, None, 1.0)], "m int, k string, v double")
    two = spark.createDataFrame([(1, "y", 1.0), (1, None, 3.0)], "m int, k string, v double")
    got = {(r.k, r.column_name, r.value_a, r.value_b) for r in P.sample_diff(one, two, KEYS, 10).collect()}
    assert got == {("x", "(row)", "present", None), ("y", "(row)", None, "present"), (None, "v", "1.0", "3.0")}


def test_summary_and_top(spark):
    rows = [("c", float(i), f"k{i:03d}") for i in range(300)] + [("d", 1.0, "k1")]
    df = spark.createDataFrame(rows, "column_name string, abs_diff double, k string")
    top = P.top_diffs(df, 3, ["k"]).where("column_name = 'c'").orderBy("diff_rank").collect()
    assert [(r.abs_diff, r.diff_rank) for r in top] == [(299.0, 1), (298.0, 2), (297.0, 3)]
    got = {r.column_name: (r.n_cells, r.max_diff) for r in P.diff_summary(df).collect()}
    assert got == {"c": (300, 299.0), "d": (1, 1.0)}


def test_hashes(a, b):
    ha = {(r.m, r.k): r.row_hash for r in P.row_hash(a, keys=KEYS).collect()}
    hb = {(r.m, r.k): r.row_hash for r in P.row_hash(b, keys=KEYS).collect()}
    assert ha[(2, None)] == hb[(2, None)] and ha[(1, "x")] != hb[(1, "x")]
    assert P.table_hash(a).first().table_hash != P.table_hash(b).first().table_hash


def test_null_and_empty_text_hash_differently(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "")], "m int, k string, t string")
    assert len({r.row_hash for r in P.row_hash(df, keys=KEYS).collect()}) == 2


def test_totals_sums_profile(a):
    total = P.control_totals(a, 1, "v", period="m", client="k", analysis="m").first()
    assert tuple(total) == (2, 2, 1, 1, 3.0)
    assert {r.k: r.sum_v for r in P.metric_sums(a, ["v"], KEYS).collect()}["y"] == 2.0
    got = {r.column_name: (r.row_count, r.key_count, r.null_count, r.total) for r in P.profile(a, KEYS).collect()}
    assert got["v"] == (4, 4, 1, 4.0) and got["w"] == (4, 4, 0, 19.0) and got["t"][2:] == (1, None)


def test_sample_is_stable(spark):
    df = spark.range(1000).select(F.lit(1).alias("m"), F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    first = {r.k for r in P.sample_keys(df, KEYS, 50, 7).collect()}
    assert first == {r.k for r in P.sample_keys(df.repartition(5), KEYS, 50, 7).collect()} and len(first) == 50
    changed = df.withColumn("v", F.col("v") + 1)
    assert P.sample_diff(df, changed, KEYS, 50, 7).count() == 50
