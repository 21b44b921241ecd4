"""Mergeable summaries for parity over large tables: error quantiles and distinct keys.

Both are computed once per part (a month, a stage, a file), stored as binary columns, and merged later without
reading the rows again. Both combine map-side, and their size does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmatrix.config import KEYS

#: Size of the quantile sketches, and of the key sketches as a power of two.
QUANTILE_K = 4000
KEY_LG = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """Published bound of KLL sketches: the rank of an answer is off by at most this share, in 99 of 100 cases."""
    return 2.296 / k**0.9723


def key_error(lg_k: int = KEY_LG) -> float:
    """Relative standard error of a distinct count, also after merging."""
    return 1.04 / 2 ** (lg_k / 2)


# Distribution of differences


def difference_sketches(cells: DataFrame, by: Sequence[str] = ("column_name",), k: int = QUANTILE_K) -> DataFrame:
    """Per column: cells, cells with a numeric difference, their sum and maximum, and a quantile sketch of them."""
    return cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count("abs_diff").alias("n_numeric"),
        F.sum("abs_diff").alias("sum_diff"),
        F.max("abs_diff").alias("max_diff"),
        F.kll_sketch_agg_double("abs_diff", k).alias("sketch"),
    )


def merge_difference_sketches(parts: DataFrame, by: Sequence[str] = ("column_name",), k: int = QUANTILE_K) -> DataFrame:
    """Sketches of parts (months, runs, files) as one per column."""
    return parts.groupBy(*by).agg(
        F.sum("n_cells").alias("n_cells"),
        F.sum("n_numeric").alias("n_numeric"),
        F.sum("sum_diff").alias("sum_diff"),
        F.max("max_diff").alias("max_diff"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )


def error_distribution(sketches: DataFrame, fractions: Sequence[float] = (0.5, 0.9, 0.99), k: int = QUANTILE_K) -> DataFrame:
    """One row per column and fraction: the quantile, and how far its rank may be off.

    A column without numeric differences has NULL quantiles.
    """
    found = F.array(
        *(
            F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(f))).alias("quantile"))
            for f in fractions
        )
    )
    none = F.array(*(F.struct(F.lit(float(f)).alias("fraction"), F.lit(None).cast("double").alias("quantile")) for f in fractions))
    others = [c for c in sketches.columns if c != "sketch"]
    mean = F.col("sum_diff") / F.nullif("n_numeric", F.lit(0))
    each = sketches.select(*others, mean.alias("mean_diff"), F.inline(F.when(F.col("n_numeric") > 0, found).otherwise(none)))
    return each.withColumn("rank_error", F.lit(rank_error(k)))


# Distinct keys


def _key(keys: Sequence[str]) -> Column:
    """One number per key; NULLs count like any other value."""
    return F.xxhash64(*keys)


def key_sketches(
    df: DataFrame, keys: Sequence[str] = KEYS.matrix, by: Sequence[str] = (KEYS.period,), stage: str = "", lg_k: int = KEY_LG
) -> DataFrame:
    """Per stage and month: rows, and a sketch of the distinct keys, in one pass."""
    return df.groupBy(F.lit(stage).alias("stage"), *by).agg(
        F.count(F.lit(1)).alias("row_count"), F.hll_sketch_agg(_key(keys), lg_k).alias("sketch")
    )


def merge_key_sketches(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of months or stages as one: the distinct keys of all of them together."""
    return parts.groupBy(*by).agg(F.sum("row_count").alias("row_count"), F.hll_union_agg("sketch").alias("sketch"))


def key_counts(sketches: DataFrame, lg_k: int = KEY_LG) -> DataFrame:
    """The sketches' counts, and their relative standard error."""
    others = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*others, F.hll_sketch_estimate("sketch").alias("key_count"), F.lit(key_error(lg_k)).alias("relative_error"))
