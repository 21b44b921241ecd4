from __future__ import annotations

import random

import pytest
from featmatrix.config import FeatureSpec
from featmatrix.operators.densify import assert_has_month, densify
from featmatrix.operators.trailing import expand_specs, present_ordinals, trailing_by_window, trailing_matrix

KEYS = ["codmesanalisis", "codunicocli"]
FRAMES = [(0, 0), (-2, 0), (-5, 0), (-8, 0), (-11, 0), (-11, -6), (-5, -3), (-1, -1)]


def months_back(n: int, from_month: int = 202412) -> list[int]:
    return [from_month - k for k in range(n)]


def random_panel(spark, seed: int, months: list[int], customers: int = 40):
    rng = random.Random(seed)
    rows = []
    for c in range(customers):
        for m in months:
            if rng.random() < 0.5 or (c == 0):
                value = None if rng.random() < 0.2 else float(rng.randint(-50, 50))
                rows.append((202412, f"c{c}", m, value, None if seed % 2 else float(rng.randint(0, 1))))
    return spark.createDataFrame(rows, "codmesanalisis int, codunicocli string, codmes int, a double, b double")


def all_specs(measures):
    specs = [s for a, e in FRAMES for s in expand_specs(measures, ("avg",), (a,), (e,))]
    specs += expand_specs(measures, ("max", "min"), (-2, -5, -8, -11), (0,))
    return specs + expand_specs(measures, ("sum",), (-2, -5, -11), (0,))


def as_dict(df, names):
    return {r.codunicocli: [None if r[n] is None else round(r[n], 9) for n in names] for r in df.collect()}


@pytest.mark.parametrize(
    ("seed", "months"),
    [
        (1, months_back(12)),
        (2, months_back(8)),
        (3, [202412, 202410, 202409, 202405, 202401]),
        (4, [202412]),
        (5, months_back(12)),
        (6, [202412, 202402]),
    ],
)
def test_slots_equal_windows(spark, seed, months):
    panel = random_panel(spark, seed, months)
    specs = all_specs(["a", "b"])
    names = [s.name for s in specs]
    fast = as_dict(trailing_matrix(panel, specs, 202412, KEYS), names)
    slow = as_dict(trailing_by_window(panel, specs, KEYS), names)
    assert fast == slow and len(fast) == panel.select("codunicocli").distinct().count()


def test_calendar_periods_count_absent_months(spark):
    panel = spark.createDataFrame(
        [(202412, "x", 202412, 12.0), (202412, "x", 202405, 24.0)],
        "codmesanalisis int, codunicocli string, codmes int, a double",
    )
    specs = expand_specs(["a"], ("avg",), (-11,), (0,))
    assert trailing_matrix(panel, specs, 202412, KEYS).first().a_PRM_U12 == 18.0
    assert trailing_matrix(panel, specs, 202412, KEYS, periods="calendar").first().a_PRM_U12 == 3.0


def test_empty_frame_is_null_and_alone(spark):
    panel = spark.createDataFrame(
        [(202412, "x", 202412, 12.0)], "codmesanalisis int, codunicocli string, codmes int, a double"
    )
    specs = [*expand_specs(["a"], ("avg",), (-11,), (-6,)), *expand_specs(["a"], ("avg",), (0,), (0,))]
    row = trailing_matrix(panel, specs, 202412, KEYS).first()
    assert row.a_PRM_P6M is None and row.a_U1M == 12.0


def test_repeated_months_raise(spark):
    panel = spark.createDataFrame(
        [(202412, "x", 202412, 10.0), (202412, "x", 202412, 30.0)],
        "codmesanalisis int, codunicocli string, codmes int, a double",
    )
    with pytest.raises(Exception, match="several rows"):
        trailing_matrix(panel, expand_specs(["a"], ("max",), (0,), (0,)), 202412, KEYS).collect()


def test_several_analysis_months(spark):
    panel = spark.createDataFrame(
        [(202411, "x", 202411, 10.0), (202412, "y", 202412, 30.0), (202412, "z", 202412, 1.0), (202412, "z", 202411, 5.0)],
        "codmesanalisis int, codunicocli string, codmes int, a double",
    )
    specs = expand_specs(["a"], ("max",), (-1,), (0,))
    name = specs[0].name
    got = {(r.codmesanalisis, r.codunicocli): r[name] for r in trailing_matrix(panel, specs, None, KEYS).collect()}
    assert got == {(202411, "x"): 10.0, (202412, "y"): 30.0, (202412, "z"): 5.0}
    one = trailing_matrix(panel, specs, 202411, KEYS).collect()
    assert [(r.codmesanalisis, r.codunicocli) for r in one] == [(202411, "x")]


def test_customers_outside_the_window_get_no_row(spark):
    panel = spark.createDataFrame(
        [(202412, "x", 202412, 10.0), (202412, "old", 202301, 30.0)],
        "codmesanalisis int, codunicocli string, codmes int, a double",
    )
    got = trailing_matrix(panel, expand_specs(["a"], ("max",), (0,), (0,)), 202412, KEYS).collect()
    assert [r.codunicocli for r in got] == ["x"]


def test_present_ordinals():
    assert present_ordinals([202412, 202410, 202311, 202501], 202412) == (1, 3)
    assert present_ordinals([], 202412, "calendar") == tuple(range(1, 13))
    with pytest.raises(ValueError, match="no rows"):
        present_ordinals([202411], 202412)
    with pytest.raises(ValueError, match="periods"):
        present_ordinals([202412], 202412, "other")


def test_plan_has_one_exchange_no_window_no_python(spark, plan_of):
    panel = random_panel(spark, 7, months_back(12))
    df = trailing_matrix(panel, all_specs(["a", "b"]), 202412, KEYS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(df, "simple")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1
    for bad in ("Window", "Join", "Cartesian", "NestedLoop", "Python", "Arrow"):
        assert bad not in plan


def test_densify(spark):
    df = spark.createDataFrame(
        [("x", 202412, 1.0, "t"), ("y", 202411, None, "u")], "codunicocli string, codmes int, a double, t string"
    )
    rows = densify(df, ["codunicocli"]).orderBy("codunicocli", "codmes").collect()
    assert [tuple(r) for r in rows] == [
        ("x", 202411, 0.0, None), ("x", 202412, 1.0, "t"), ("y", 202411, 0.0, "u"), ("y", 202412, 0.0, None),
    ]
    raw = densify(df, ["codunicocli"], fill=None).where("codunicocli = 'y' and codmes = 202412").first()
    assert raw.a is None


def test_missing_month_guard(spark):
    df = spark.createDataFrame([(202411,)], "codmes int")
    assert_has_month(df, 202411)
    with pytest.raises(ValueError, match="no rows"):
        assert_has_month(df, 202412)


def test_names_of_unknown_aggregate(spark):
    panel = random_panel(spark, 8, [202412], 2)
    bad = [FeatureSpec("x", "median", "a", 0, 0)]
    with pytest.raises(ValueError, match="median"):
        trailing_matrix(panel, bad, 202412, KEYS)
