from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF_DIR = os.environ.get("CONFORMANCE_SF_DIR", "/root/testdata/sf0.001")


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_runs", "near_duplicates", "personal_data", "packing"]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(1)
    say = lambda n: " ".join("".join(rnd.choice(["la", "ra", "ti", "mo"]) for _ in range(2)) for _ in range(n)) + "."
    base = say(80)
    passage = say(60)
    rows = [(i, say(40), "aa", "s", 1, "k") for i in range(50)]
    rows += [(100, base, "aa", "s", 1, None), (101, base.replace(".", " end."), "aa", "s", 1, "x"), (102, base, "aa", "s", 1, "x")]
    rows += [(110, say(30) + "\n" + passage, "aa", "s", 1, "y"), (111, say(30) + "\n" + passage, "aa", "s", 1, "y")]
    rows += [(120, None, "aa", "s", 1, "z"), (121, "", "aa", "s", None, "z"), (122, say(20) + " mail a@b.org.", None, None, 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def test_stages_take_effect(spark, table):
    docs = table
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == table.columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {120, 121} & set(seen["language"]) and len(seen["language"]) == table.count() - 2
    assert 102 not in seen["line_runs"] and "\n" not in seen["line_runs"][111] and "\n" in seen["line_runs"][110]
    assert 100 in seen["near_duplicates"] and 101 not in seen["near_duplicates"]
    assert seen["personal_data"][122].endswith("mail <EMAIL>.")
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == set(seen["personal_data"]) and all(r["n"] == r["all"] for r in pieces)


def test_rows_that_share_a_doc_id_or_repeat(spark, table):
    """Only what repeats goes: another text of the same doc_id stays, an exact repetition is the same document."""
    w, u = (" ".join(f"{x}{i}" for i in range(60)) for x in "wu")
    rows = [(0, w), (1, u), (1, w + " and more"), (3, u), (4, "x " * 200_000), (4, "x " * 200_000)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 1, None) for i, t in rows], table.schema)
    lines = corpus_pipeline.line_runs(spark, docs, "")
    assert sorted(r.doc_id for r in lines.collect()) == [0, 1, 1, 4, 4]
    kept = corpus_pipeline.near_duplicates(spark, lines, "")
    assert sorted((r.doc_id, r.text[:2]) for r in kept.collect()) == [(0, "w0"), (1, "u0"), (4, "x "), (4, "x ")]


def test_empty_table(spark, table):
    docs = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not here")
def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    sequences = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 100 and sequences.where("n > 2048").count() == 0
