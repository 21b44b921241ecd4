"""Connected components over an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.llm.common import durable


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round links larger neighbours, then smaller ones, to the smallest neighbour, so path lengths shrink
    geometrically and no round grows the edge table. A hub is never collected: minima combine map-side and the
    join back is one that adaptive execution can split. The driver sees only two sums per round.
    Null ends and loops are ignored; an empty table gives an empty table.
    """
    now = durable(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    seen = None
    for _ in range(rounds):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        # larger neighbours go to the smallest neighbour or u itself; u keeps its own link to a smaller minimum
        large = (
            both.join(_minima(both), "u")
            .where((F.col("v") > F.col("u")) | (F.col("v") == F.col("m")))
            .select(F.greatest("u", "v").alias("u"), F.least("m", "u").alias("v"))
        )
        small = large.join(_minima(large), "u")
        now = durable(small.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest_roots(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for links (a, b) in which each `a` has one `b` below it; roots themselves are not listed.

    Pointers are doubled, so the rounds follow the logarithm of the depth; each is one join, which adaptive execution
    can split at a popular parent. The driver sees one sum per round.
    """
    now = durable(links.select(F.col("a").alias("node"), F.col("b").alias("component")))
    for _ in range(rounds):
        above = now.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = now.select("node", "component").join(above, "component", "left")
        now = durable(step.select("node", F.coalesce("up", "component").alias("component"), F.col("up").isNotNull().cast("int").alias("moved")))
        if not now.agg(F.sum("moved")).first()[0]:
            return now.drop("moved")
    raise RuntimeError("a chain of links is too deep or turns back")
