from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from conformance.compare import connect, rows_of
from featmatrix.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("CONFORMANCE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not here")


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_returns_every_row(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    own = {"op1": ("embeddings", "vec_id"), "op13": ("benchmark", "item_id")}
    table, key = own.get(name.split("_")[0], ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect()}
    rows = found.collect()
    assert {r[key] for r in rows} == ids
    if not name.startswith(("op6_", "op13_")):
        assert len(rows) == len(ids)
    if name in ORACLES:
        result = connect(SF_DIR).execute(ORACLES[name])
        assert rows_of([d[0] for d in result.description], result.fetchall()) == rows_of(found.columns, rows)
