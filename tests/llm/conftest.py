from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def import_on_workers():
    """Python workers of the test session import the package from the repository."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def documents(spark):
    """Tables from (doc_id, text) with the further columns of documents and one with a clashing name."""

    def make(rows, lang="en", partitions=3):
        full = [(i, t, lang, "s", len(t or ""), 7) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, n long"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
