from __future__ import annotations

import pytest

from featmatrix.functions.naming import feature_name


@pytest.mark.parametrize(
    ("fn", "start", "end", "general", "all_of_n"),
    [
        ("avg", 0, 0, "x_U1M", "x_U1M"),
        ("avg", -2, 0, "x_PRM_U3M", "x_PRM_U3M"),
        ("avg", -11, 0, "x_PRM_U12", "x_PRM_U12"),
        ("avg", -11, -6, "x_PRM_P6M", "x_PRM_P6M"),
        ("avg", -5, -3, "x_PRM_P3M", "x_PRM_P3M"),
        ("avg", -1, -1, "x_P1M", "x_P1M"),
        ("max", -8, 0, "x_MAX_U9M", "x_MAX_U9M"),
        ("max", -11, 0, "x_MAX_U12", "x_MAX_U12"),
        ("min", -5, 0, "x_MIN_U6M", "x_MIN_U6M"),
        ("sum", -2, 0, "x_SUM_U3M", "x_X3M_U3M"),
        ("sum", -11, 0, "x_SUM_U12", "x_X12_U12"),
        ("sum", -11, -6, "x_SUM_P6M", "x_X12_U12"),
        ("sum", -1, -1, "x_P1M", "x_X2M_U2M"),
    ],
)
def test_suffixes(fn, start, end, general, all_of_n):
    assert feature_name("x", fn, start, end, "general") == general
    assert feature_name("x", fn, start, end) == all_of_n


def test_unknown_things_raise():
    with pytest.raises(ValueError):
        feature_name("x", "median", 0, 0)
    with pytest.raises(ValueError):
        feature_name("x", "avg", 0, -1)
    with pytest.raises(ValueError):
        feature_name("x", "avg", 0, 0, "other")
