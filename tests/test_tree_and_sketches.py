from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from featmatrix.operators import digest_tree as T
from featmatrix.operators import parity as P
from featmatrix.operators import sketches as S

KEYS = ["m", "k"]
SCHEMA = "m int, k string, v double, w long, t string"


@pytest.fixture(scope="module")
def versions(spark):
    """Two versions of 20 000 rows; 30 differ, some only within an epsilon, by case, or in a key."""
    rnd = random.Random(9)
    rows = [(i % 12, None if i == 77 else f"k{i}", rnd.choice([None, rnd.random()]), i, rnd.choice([None, "t ", "u"])) for i in range(20_000)]
    other = list(rows)
    for n, i in enumerate(rnd.sample(range(20_000), 30)):
        m, k, v, w, t = rows[i]
        other[i] = [(m, k, (v or 0.0) + 1, w, t), (m, k, v, w + 1, t), (m, k, v, w, "other"), (m, f"{k}x", v, w, t), (m, k, v and v + 1e-9, w, "T")][n % 5]
    a, b = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(other, SCHEMA).repartition(3)
    return a, b.select("k", "m", F.col("t").alias("T"), F.col("w").cast("decimal(20,2)").alias("w"), "v")


@pytest.mark.parametrize("options", [{}, {"eps": 1e-6}, {"ignore_case": True, "columns": ["t", "v"]}, {"eps_by_column": {"w": 1.0}}])
@pytest.mark.parametrize("depth", [1, 4])
def test_cells_are_those_of_the_whole_comparison(versions, options, depth):
    whole = sorted(map(tuple, P.cell_diff(*versions, KEYS, **options).collect()), key=repr)
    assert sorted(map(tuple, T.tree_cell_diff(*versions, KEYS, depth=depth, **options).collect()), key=repr) == whole
    assert whole


def test_shuffled_rows_follow_the_differing_buckets(versions):
    a, b = versions
    nodes = T.differing_nodes(*T.trees(a, b, KEYS))
    levels = {r.level: r.n for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels[0] == 1 and 20 <= levels[4] <= 36 and levels[1] <= 16
    few = T.in_differing_buckets(a, nodes, KEYS, 4)
    assert few.count() < 60  # of 20 000
    leaves = nodes.where("level = 4").agg(F.sum("rows_a")).first()[0]
    assert few.count() == leaves


def test_equal_tables_have_no_differing_node(versions, plan_of):
    a, _ = versions
    again = a.orderBy(F.desc("w")).select("t", "w", "k", "m", "v")
    assert T.differing_nodes(T.digest_tree(a, KEYS), T.digest_tree(again, KEYS, ["v", "w", "t"])).count() == 0
    plan = plan_of(T.in_differing_buckets(a, T.differing_nodes(*T.trees(a, again, KEYS)), KEYS, 4), "simple")
    assert "BroadcastHashJoin" in plan
    with pytest.raises(ValueError, match="depth"):
        T.tree_cell_diff(a, a, KEYS, depth=9)


def test_a_stored_tree_finds_the_same_nodes(spark, versions):
    a, b = versions
    one, two = T.trees(a, b, KEYS)
    spark.sql("DROP TABLE IF EXISTS stored_tree")
    one.write.saveAsTable("stored_tree")
    live = {tuple(r) for r in T.differing_nodes(one, two).collect()}
    assert {tuple(r) for r in T.differing_nodes(spark.table("stored_tree"), two).collect()} == live


def test_tree_nodes_are_sums_of_their_children(versions):
    rows = T.digest_tree(versions[0], KEYS, depth=3).collect()
    by = {(r.level, r.bucket): (r.n_rows, r.digest_1, r.digest_2) for r in rows}
    for level in range(3):
        for (at, bucket), sums in by.items():
            if at == level:
                below = [s for (lv, bk), s in by.items() if lv == level + 1 and bk >> 4 == bucket]
                assert sums == tuple(map(sum, zip(*below)))
    assert by[0, 0][0] == 20_000


def test_quantiles_keep_their_rank_error(spark):
    rnd = random.Random(3)
    values = [round(rnd.expovariate(1), 4) for _ in range(120_000)]
    cells = spark.createDataFrame([(i % 7, "c", v) for i, v in enumerate(values)] + [(0, "text", None)], "m int, column_name string, abs_diff double")
    parts = S.difference_sketches(cells, ["m", "column_name"], k=1000)
    found = S.error_distribution(S.merge_difference_sketches(parts, k=1000), (0.01, 0.5, 0.9, 0.999), k=1000).collect()
    ordered = sorted(values)
    for r in found:
        if r.column_name == "text":
            assert (r.quantile, r.n_cells, r.n_numeric, r.mean_diff) == (None, 1, 0, None)
            continue
        low = sum(v < r.quantile for v in ordered) / len(ordered)
        high = sum(v <= r.quantile for v in ordered) / len(ordered)
        assert low - r.rank_error <= r.fraction <= high + r.rank_error and r.rank_error < 0.004
        assert r.n_cells == 120_000 and r.mean_diff == pytest.approx(sum(values) / len(values)) and r.max_diff == max(values)
    assert len(found) == 8 and S.rank_error(200) == pytest.approx(0.0133, abs=2e-4)


def test_key_counts_merge_over_months_and_stages(spark):
    df = spark.range(30_000).select((F.col("id") % 3).cast("int").alias("codmes"), (F.col("id") % 9000).cast("string").alias("k"))
    one, two = S.key_sketches(df, ["k"], stage="one"), S.key_sketches(df.where("k < 4500"), ["k"], stage="two")
    per_month = S.key_counts(one).collect()
    assert len(per_month) == 3 and all(abs(r.key_count - 3000) <= 3 * r.relative_error * 3000 and r.row_count == 10_000 for r in per_month)
    both = S.key_counts(S.merge_key_sketches(one.unionByName(two), ["stage"]))
    got = {r.stage: r.key_count for r in both.collect()}
    assert abs(got["one"] - 9000) <= 3 * S.key_error() * 9000 and got["two"] < got["one"]


def test_profile_counts_keys_in_the_same_pass(spark, plan_of):
    df = spark.range(5000).select((F.col("id") % 2).cast("int").alias("m"), (F.col("id") % 1000).cast("string").alias("k"), F.col("id").cast("double").alias("v"), F.lit(None).cast("string").alias("t"))
    exact = {r.column_name: r for r in P.profile(df, KEYS).collect()}
    sketch = {r.column_name: r for r in P.profile(df, KEYS, "sketch").collect()}
    assert set(exact) == set(sketch) == {"v", "t"}
    for name in exact:
        assert exact[name].key_count == 1000 and abs(sketch[name].key_count - 1000) <= 30
        assert exact[name][0] == sketch[name][0] == 5000 and exact[name][2:] == sketch[name][2:]
    assert plan_of(P.profile(df, KEYS, "sketch"), "simple").count("Range") == 1
    with pytest.raises(ValueError, match="exact or sketch"):
        P.profile(df, KEYS, "none")


def test_sample_is_a_bottom_k(spark, plan_of):
    """A key with most of the rows; tasks keep their own smallest hashes, and no exchange carries all keys."""
    df = spark.range(40_000).select(F.lit(1).alias("m"), F.when(F.col("id") < 25_000, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = [tuple(r) for r in P.sample_keys(df, KEYS, 40, 3).collect()]
    digest = P._digest(["m", "k", "s"])
    want = df.distinct().withColumn("s", F.lit(3)).orderBy(digest).limit(40).select(*KEYS)
    assert got == [tuple(r) for r in want.collect()]
    lines = plan_of(P.sample_keys(df, KEYS, 40, 3), "simple").splitlines()
    first = max(i for i, x in enumerate(lines) if "Exchange" in x)
    assert any("WindowGroupLimit" in x for x in lines[first:])
    assert P.sample_keys(df.limit(0), KEYS, 5).count() == 0
