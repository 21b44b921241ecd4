from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from featmatrix.functions import periods as P


def test_shift_over_years():
    assert P.shift_month("202401", -1) == "202312"
    assert P.shift_month(202401, -11) == "202302"
    assert P.shift_month("202312", 1) == "202401"


def test_month_list_and_windows_are_newest_first():
    assert P.month_list("202311", "202402") == ["202402", "202401", "202312", "202311"]
    assert P.analysis_windows("202401", "202402") == [("202402", "202303"), ("202401", "202302")]
    assert P.analysis_windows("202401", "202401", back=23) == [("202401", "202202")]


def test_reversed_interval_and_bad_month_raise():
    with pytest.raises(ValueError, match="after"):
        P.month_list("202402", "202401")
    with pytest.raises(ValueError, match="YYYYMM"):
        P.shift_month("202413", 1)


@pytest.mark.parametrize(
    ("day", "month"),
    [("2024-07-06", "202406"), ("2024-07-31", "202407"), ("2024-01-15", "202312"), ("2024-02-29", "202402"), ("2023-02-28", "202302")],
)
def test_process_month_end(day, month):
    assert P.process_month_end(day) == month


@pytest.mark.parametrize(("day", "cutoff", "month"), [("2024-07-06", 5, 202407), ("2024-07-04", 5, 202406), ("2024-01-04", "5", 202312)])
def test_process_month_cutoff(day, cutoff, month):
    assert P.process_month_cutoff(day, cutoff) == month


def test_ordinal():
    assert P.month_ordinal("202407", "202407") == 1
    assert P.month_ordinal("202407", "202401") == 7


def test_columns_agree_with_python(spark):
    days = [date(2023, 12, 31), date(2024, 1, 4), date(2024, 2, 29), date(2024, 7, 15)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select(
        "d",
        P.process_month_end_col(F.col("d")).alias("e"),
        P.process_month_cutoff_col(F.col("d"), 5).alias("c"),
        P.shift_month_col(P.month_of_col(F.col("d")), -11).alias("s"),
        P.month_ordinal_col(F.lit(202407), P.month_of_col(F.col("d"))).alias("o"),
    ).collect()
    for r in got:
        month = r.d.year * 100 + r.d.month
        assert str(r.e) == P.process_month_end(r.d)
        assert r.c == P.process_month_cutoff(r.d, 5)
        assert str(r.s) == P.shift_month(month, -11)
        assert r.o == P.month_ordinal(202407, month)


def test_audit_columns(spark):
    row = P.audit_cols(spark.range(1), "2024-07-06", datetime(2024, 7, 6, 1, 2, 3)).first()
    assert row.fecrutina == date(2024, 7, 6)
    assert P.audit_cols(spark.range(1), "2024-07-06").schema["fecactualizacionregistro"].dataType.typeName() == "timestamp"


def test_run_timestamp_has_no_zone_and_whole_seconds():
    ts = P.run_timestamp()
    assert ts.tzinfo is None and ts.microsecond == 0


def test_reversed_windows_raise_for_columns_too(spark):
    import pytest

    from featmatrix.functions.periods import analysis_windows_df

    df = spark.createDataFrame([(202403, 202401)], "a int, b int")
    with pytest.raises(Exception, match="after the last month"):
        analysis_windows_df(df, "a", "b").collect()
