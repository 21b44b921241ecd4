from __future__ import annotations

import pytest

from featmatrix.operators import columns as C


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(1, "x", 2.5, 1)], "codmes int, id string, a_mto_u1m double, a_flg_u1m int")


def test_renames(df):
    assert C.rename_columns(df, {"id": "key", "absent": "y"}).columns == ["codmes", "key", "a_mto_u1m", "a_flg_u1m"]
    with pytest.raises(ValueError):
        C.rename_columns(df, ["id"])
    assert C.rename_replace(df, ["a_mto_u1m"], "u1m", "now").columns[2] == "a_mto_now"
    assert C.upper_columns(df).columns[0] == "CODMES"


def test_selection_by_name(df):
    assert C.cols_with_suffix(df, "_u1m") == ["a_mto_u1m", "a_flg_u1m"]
    assert C.cols_containing(df, "flg") == ["a_flg_u1m"]
    assert C.feature_columns(["ID", "V"], ["id", "v", "v_u1m"], ["id"]) == ["id", "v_u1m"]


def test_casts_and_constants(df):
    cast = C.cast_all(df, ["codmes", "id"], "double", {"_flg_": "int"})
    assert dict(cast.dtypes) == {"codmes": "string", "id": "string", "a_mto_u1m": "double", "a_flg_u1m": "int"}
    assert dict(C.cast_cols(df, {"codmes": "bigint"}).dtypes)["codmes"] == "bigint"
    assert C.with_literals(df, {"z": 5}).first().z == 5
