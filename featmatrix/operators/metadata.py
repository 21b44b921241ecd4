"""Diagnostics on the concept-group table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meta_groups(df: DataFrame, groups: Iterable[str] | None = None) -> DataFrame:
    """Number of registered columns per group and concept table."""
    rows = df if groups is None else df.where(F.col("nomgrupo").isin(*groups))
    counts = rows.groupBy("nomgrupo", "nomtablaconcepto").agg(F.count(F.lit(1)).alias("num_columnas"))
    return counts.orderBy("nomgrupo", "nomtablaconcepto")


def meta_pairs(df: DataFrame, group: str | None = None) -> DataFrame:
    """Distinct (group, concept table) pairs."""
    rows = df if group is None else df.where(F.col("nomgrupo") == group)
    return rows.select("nomgrupo", "nomtablaconcepto").distinct().orderBy("nomtablaconcepto", "nomgrupo")


def meta_find(df: DataFrame, text: str) -> DataFrame:
    """Rows whose concept table contains ``text``, in any case."""
    match = F.upper("nomtablaconcepto").like(f"%{text.upper()}%")
    return df.where(match).select("nomgrupo", "nomtablaconcepto", "nomconcepto").orderBy("nomgrupo", "nomconcepto")


def meta_lengths(df: DataFrame, group: str, n: int = 20) -> DataFrame:
    """First ``n`` rows of a group with the lengths of their names, which shows stray blanks."""
    return (
        df.where(F.col("nomgrupo") == group)
        .select(
            "nomgrupo",
            "nomtablaconcepto",
            F.length("nomgrupo").alias("len_grupo"),
            F.length("nomtablaconcepto").alias("len_tabla"),
            "nomconcepto",
        )
        .orderBy("nomtablaconcepto", "nomconcepto")
        .limit(n)
    )
