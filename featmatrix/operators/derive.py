"""Rules on top of aggregated features: growth, gated minimum, all-of-n flags, party key.

The rules are SQL expressions, used both on flat columns here and inside the matrix plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmatrix.config import PARTY_KEY_PREFIX

# growth horizon: (numerator suffix, denominator suffix); fixed by the output schema
GROWTH = {"G6M": ("PRM_U6M", "PRM_P6M"), "G3M": ("PRM_U3M", "PRM_P3M"), "G1M": ("U1M", "P1M")}


def growth_sql(numerator: str, denominator: str) -> str:
    return f"round(try_divide({numerator}, {denominator}), 8)"


def min_gate_sql(minimum: str, frequency: str, n: int) -> str:
    return f"if({frequency} < {n}, 0D, {minimum})"


def exactly_sql(value: str, n: int) -> str:
    return f"case when {value} = {n} then 1 else 0 end"


def growth(df: DataFrame, bases: Iterable[str]) -> DataFrame:
    """Ratio of the last block to the previous block; NULL when the previous block is zero."""
    return df.withColumns(
        {f"{b}_{g}": F.expr(growth_sql(f"`{b}_{u}`", f"`{b}_{p}`")) for b in bases for g, (u, p) in GROWTH.items()}
    )


def min_gate(df: DataFrame, triples: Iterable[tuple[str, str, int]]) -> DataFrame:
    """(minimum column, frequency column, n): the minimum is 0 unless active in all ``n`` months."""
    return df.withColumns({m: F.expr(min_gate_sql(f"`{m}`", f"`{f}`", n)) for m, f, n in triples})


def exactly_n(df: DataFrame, counts: Mapping[str, int]) -> DataFrame:
    """1 when the column equals its ``n``, else 0, also for NULL."""
    return df.withColumns({c: F.expr(exactly_sql(f"`{c}`", n)) for c, n in counts.items()})


def party_key(party: Column) -> Column:
    return F.sha2(F.concat(F.lit(PARTY_KEY_PREFIX), F.trim(party)), 512)
