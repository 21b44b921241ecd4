from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from conformance.compare import compare, connect
from conformance.queries import QUERIES

SF_DIR = os.environ.get("CONFORMANCE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_oracle(spark, duck, name):
    assert compare(spark, duck, name, SF_DIR) == ""


def test_oracles_belong_to_queries():
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert len(df.columns) == 1783 and df.count() > 0


def test_scans_are_pruned_by_date(spark, plan_of):
    for name in ("src_months_scan", "agg_frequency", "pip_agent"):
        plan = plan_of(contract.queries()[name](spark, SF_DIR))
        assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan, name


def test_queries_that_store_run_twice_over_one_warehouse(tmp_path):
    """Two fresh sessions whose catalogs know nothing of each other, over the same folders."""
    code = (
        "import sys; from pyspark.sql import SparkSession; from conformance.compare import compare, connect\n"
        "warehouse, sf = sys.argv[1:]\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.sql.warehouse.dir', warehouse).config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '4').config('spark.sql.session.timeZone', 'UTC').getOrCreate()\n"
        "names = ('snk_rerun_month', 'snk_rerun_month_all_months', 'snk_stage', 'src_catalog', 'src_catalog_all_months')\n"
        "bad = [x for x in (compare(spark, connect(sf), n, sf) for n in names) if x]\n"
        "sys.exit(str(bad) if bad else 0)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "warehouse"), SF_DIR], cwd=root, capture_output=True, text=True, timeout=600)
        assert done.returncode == 0, done.stderr[-2000:]
