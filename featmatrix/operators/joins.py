"""Join helpers: size-checked broadcast, skew-proof lookups and combining feature blocks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Starts the join key of rows that need no match; no id starts with it.
UNMATCHED = "\u0000"
LOOKUP_KEY = "_lookup_key"


def broadcast_if_small(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast hint only after counting that ``df`` has at most ``max_rows`` rows.

    Without the hint Spark still decides from file and shuffle sizes.
    """
    if max_rows is None or df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)


def keyed_for_lookup(left: DataFrame, left_key: Column) -> DataFrame:
    """``left`` with the key that ``lookup_join`` joins on; a table stored by it (``LOOKUP_KEY``) is looked up as it lies."""
    content = F.expr("xxhash64(spark_partition_id(), *)")
    spread = F.concat(F.lit(UNMATCHED), content.cast("string"))
    return left.select("*", F.coalesce(left_key, spread).alias(LOOKUP_KEY))


def lookup_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: str) -> DataFrame:
    """Left join on one nullable text key, where rows with a NULL key need no match.

    Those rows would all hash to one task, and they may be a large part of the data (anonymous
    parties). They get a key taken from their content and input partition instead, so that even copies
    spread, and a retried task sends every row to the same place again. Other hot keys are left to the
    skew-join splitting of adaptive execution. Columns of ``right`` other than its key are added.
    """
    keyed = left if LOOKUP_KEY in left.columns else keyed_for_lookup(left, left_key)
    return keyed.join(right.withColumnRenamed(right_key, LOOKUP_KEY), LOOKUP_KEY, "left").drop(LOOKUP_KEY)


def combine_blocks(blocks: Sequence[DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join feature blocks on their keys: ``inner`` to intersect, ``full`` for parallel subsets."""
    if how not in ("inner", "full"):
        raise ValueError(f"blocks combine by inner or full join, not {how!r}")
    return reduce(lambda a, b: a.join(b, list(keys), how), blocks)
