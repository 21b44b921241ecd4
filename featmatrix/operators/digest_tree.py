"""Cells of two large tables compared only where a tree of digests differs.

Rows fall into buckets, the leaves of a tree, by ranges of their key's hash. A leaf's digest is the sum of its rows'
hashes, so it is built map-side and does not depend on row order; an inner node is the sum of its children. Two tables
are compared by their trees, of at most `FAN` ** depth leaves, and only rows of differing leaves are shuffled. A tree
can be stored with its table, so that an unchanged version is never read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmatrix.config import KEYS
from featmatrix.operators.parity import PairedColumns, cell_diff

FAN_BITS = 4
FAN = 1 << FAN_BITS


def bucket_of(keys: Sequence[str], depth: int) -> Column:
    """Leaf of a row: the leading bits of its key's hash. NULL keys have one, like any other."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FAN_BITS * depth)


def _leaves(df: DataFrame, keys: Sequence[str], values: Sequence[Column], depth: int) -> DataFrame:
    hashed = [F.xxhash64(F.lit(salt), *keys, *values).cast("decimal(38,0)") for salt in (1, 2)]
    return df.groupBy(bucket_of(keys, depth).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(hashed[0]).alias("digest_1"), F.sum(hashed[1]).alias("digest_2")
    )


def digest_tree(df: DataFrame, keys: Sequence[str] = KEYS.matrix, columns: Sequence[str] | None = None, depth: int = 4) -> DataFrame:
    """(level, bucket, n_rows, digest_1, digest_2): every node that has rows; level 0 is the root.

    To compare tables of other types or names, give the column pairs to `trees` instead.
    """
    pairs = PairedColumns(df, df, keys, columns)
    return _tree(df, keys, pairs.normal(0), depth)


def _tree(df: DataFrame, keys: Sequence[str], values: Sequence[Column], depth: int) -> DataFrame:
    leaves = _leaves(df, keys, values, depth)
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    nodes = leaves.select(level, "bucket", "n_rows", "digest_1", "digest_2")
    up = F.expr(f"shiftrightunsigned(bucket, {FAN_BITS} * ({depth} - level))")
    return nodes.groupBy("level", up.alias("bucket")).agg(*(F.sum(c).alias(c) for c in ("n_rows", "digest_1", "digest_2")))


def trees(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS.matrix, columns: Sequence[str] | None = None, depth: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Trees of two tables over the columns that they share, in a common form of their values."""
    pairs = PairedColumns(a, b, keys, columns)
    return tuple(_tree(df, keys, pairs.normal(i), depth) for i, df in enumerate((a, b)))


def differing_nodes(tree_a: DataFrame, tree_b: DataFrame) -> DataFrame:
    """(level, bucket, rows_a, rows_b) of the nodes that differ. Equal tables have none, not even the root."""
    sums = ("n_rows", "digest_1", "digest_2")
    sides = [t.select("level", "bucket", F.struct(*sums).alias(n)) for t, n in ((tree_a, "_a"), (tree_b, "_b"))]
    met = sides[0].join(sides[1], ["level", "bucket"], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    rows = (F.coalesce(F.col(f"_{s}.n_rows"), F.lit(0)).alias(f"rows_{s}") for s in "ab")
    return met.select("level", "bucket", *rows)


def in_differing_buckets(df: DataFrame, nodes: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """Rows of the leaves that differ; these are at most `FAN` ** depth numbers, so they are broadcast."""
    leaves = nodes.where(F.col("level") == depth).select(F.col("bucket").alias("_bucket"))
    return df.join(F.broadcast(leaves), bucket_of(keys, depth) == F.col("_bucket"), "left_semi")


def tree_cell_diff(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS.matrix, eps: float = 0.0,
    eps_by_column: Mapping[str, float] | None = None, ignore_case: bool = False, columns: Sequence[str] | None = None,
    depth: int = 4, nodes: DataFrame | None = None,
) -> DataFrame:
    """What ``cell_diff`` finds, with a shuffle of differing buckets only.

    ``nodes`` are the differing nodes if the trees were compared before. A key that one side has twice is an error where
    its bucket differs; two tables that agree in it are equal there.
    """
    if not 1 <= depth <= 4:
        raise ValueError("depth must be 1 to 4, so that a list of all leaves stays small")
    if nodes is None:
        nodes = differing_nodes(*trees(a, b, keys, columns, depth))
    few = (in_differing_buckets(df, nodes, keys, depth) for df in (a, b))
    return cell_diff(*few, keys, eps, eps_by_column, ignore_case, columns)
