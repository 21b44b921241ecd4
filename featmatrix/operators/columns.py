"""Renames, selections by name, casts and constants."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.config import CTD, FLG, MTO, TKT, Measure


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    if not isinstance(mapping, Mapping):
        raise ValueError("give the renames as {'old_name': 'new_name', ...}")
    return df.withColumnsRenamed(dict(mapping))


def rename_replace(df: DataFrame, cols: Iterable[str], old: str, new: str) -> DataFrame:
    """Replace ``old`` by ``new`` in the names of ``cols``."""
    return df.withColumnsRenamed({c: c.replace(old, new) for c in cols})


def upper_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.upper() for c in df.columns))


def cols_with_suffix(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def cols_containing(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if text in c]


def classify(columns: Iterable[str], prefix: str) -> tuple[Measure, ...]:
    """Measure class of every column of a channel, read from its name."""
    return tuple(
        Measure(c, cls)
        for c in columns
        if prefix.upper() in c.upper()
        for cls in (MTO, TKT, CTD, FLG)
        if cls in c.upper()
    )


def feature_columns(before: Sequence[str], after: Sequence[str], keys: Sequence[str]) -> list[str]:
    """Keys first, then the columns that the expansion added."""
    old = {c.upper() for c in before} | {k.upper() for k in keys}
    return [*keys, *(c for c in after if c.upper() not in old)]


def cast_all(df: DataFrame, keys: Sequence[str], dtype: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """Keys to string and every other column to ``dtype``, in one projection.

    ``overrides`` maps a text to the type of the columns whose name contains it, such as flags to int.
    """
    rules = overrides or {}
    kept = {k.upper() for k in keys}

    def target(column: str) -> str:
        return next((t for text, t in rules.items() if text.upper() in column.upper()), dtype)

    others = [c for c in df.columns if c.upper() not in kept]
    return df.select(
        *(F.col(k).cast("string").alias(k) for k in keys), *(F.col(c).cast(target(c)).alias(c) for c in others)
    )


def cast_cols(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def with_literals(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in values.items()})
