from __future__ import annotations

import pytest

from featmatrix.operators import library as L

KEYS = ["codmesanalisis", "c"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [
            (202412, "x", 202412, 5.0, 1.0),
            (202412, "x", 202411, None, 2.0),
            (202412, "x", 202409, 20.0, 30.0),
            (202412, "x", 202404, 8.0, None),
            (202412, "y", 202407, -4.0, 0.0),
        ],
        "codmesanalisis int, c string, codmes int, a double, b double",
    )


def run(df, specs):
    return {r.c: r.asDict() for r in L.trailing_agg(df, specs, KEYS).collect()}


def test_frequency_and_recency(df):
    got = run(df, L.frequency(["a"], (0, -2, -11)) + L.recency(["a"]))
    assert [got["x"][n] for n in ("a_FRQ_U1M", "a_FRQ_U3M", "a_FRQ_U12", "a_REC")] == [1, 1, 3, 1.0]
    assert [got["y"][n] for n in ("a_FRQ_U12", "a_REC")] == [0, 0.0]


def test_means_skip_missing_months(df):
    got = run(df, L.seniority_mean(["a"], (0, 11)) + L.mean(["a"], ("3", "12"), "PRMX") + L.mean(["a"], ("3", "6", "1"), previous=True))
    x = got["x"]
    assert (x["a_U1M"], x["a_PRM_U12"], x["a_PRMX_U3M"], x["a_PRMX_U12"]) == (5.0, 11.0, 5.0, 11.0)
    assert (x["a_PRM_P3M"], x["a_PRM_P6M"], x["a_P1M"]) == (20.0, 8.0, None)


def test_extremes_and_sums(df):
    got = run(df, L.type_extremes(["a"], (0, 11)) + L.minimum(["a"], [12]) + L.maximum(["a"], [12], "TOP", plain_twelve=False) + L.total(["a"], [6]))
    x = got["x"]
    assert (x["a_U1M"], x["a_MAX_U12"], x["a_MIN_U12"], x["a_MIN_U12M"], x["a_TOP_U12M"], x["a_SUM_U6M"]) == (5.0, 20.0, 5.0, 5.0, 20.0, 25.0)
    assert not any(n.startswith("a_MIN_U1M") for n in x)


@pytest.mark.parametrize("months", ["12", "9"])
def test_previous_block_of_other_lengths_raises(months):
    with pytest.raises(ValueError, match="previous block"):
        L.mean(["a"], [months], previous=True)


def test_edges(df):
    specs = [s for f in (True, False) for o in (True, False) for s in L.month_above(["a"], [12], 6, first=f, ordinal=o)]
    x = run(df, specs)["x"]
    assert (x["a_PRI_6_U12M"], x["a_U_6_U12M"], x["a_DS_PRI_6_U12M"], x["a_DS_U_6_U12M"]) == (202404, 202409, 9.0, 4.0)
    x = run(df, L.month_above_column(["a"], [12], "b") + L.month_both_above(["a"], [12], "b", 1, 2))["x"]
    assert (x["a_PRI3_U12M"], x["a_PRI1_1_2_U12M"]) == (202412, 202409)


def test_indicators(df):
    specs = L.indicator(["a"], [12], "sum", "_N_", 6) + L.indicator(["a"], [12], "count", "_C_", 6)
    specs += L.indicator_vs_column(["a"], [12], "count", "_V_", "b") + L.indicator_both(["a"], [12], "sum", "_B_", "b", 1, 2)
    x = run(df, specs)["x"]
    assert (x["a_N_6_U12M"], x["a_C_6_U12M"], x["a_V_U12M"], x["a_B_1_2_U12M"]) == (2, 3, 3, 1)


def test_opening(df):
    got = run(df, L.earliest_opening("a", 6, 5))
    assert got["x"][L.OPENING_NAME] == 20.0 and got["y"][L.OPENING_NAME] == 300001.0


def test_same_name_twice_raises(df):
    with pytest.raises(ValueError, match="same output name"):
        L.trailing_agg(df, L.earliest_opening("a", 6) + L.earliest_opening("b", 6), KEYS)


def test_one_shuffle_with_map_side_combine(df, spark, plan_of):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(L.trailing_agg(df, L.mean(["a", "b"], (3, 6, 12)), KEYS), "simple")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2
