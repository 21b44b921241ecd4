"""Embedding near-duplicates by sorted projection passes.

Each pass hashes a vector by the signs of random projections, concatenates the bits, and orders the vectors of a
label lexicographically by them; every vector is compared with its next `window` neighbours in that order. Verified
pairs of all passes are united to components. The passes are only the cheap start: afterwards the classes of every
label that outgrows a window are compared block against block, and a pair of two components that reaches the
threshold joins them, so no link is missed whatever the size of a label. Equal vectors are one class with a weight
before the passes, and inside a component links are counted block against block, so a dense group that overflows the
window still gets exact counts. No pair of a group is ever a row.

The blocks of a label are salted by hash; its vectors are copied once per block, at most `spread` times until a block
holds `most` vectors. Products are taken in single precision, and those within its error bound again in double.

Vectors link only within one label and one number of dimensions. A vector that is null or zero or holds a null or
non-finite component, and a row with a null label or vec_id, links with nothing: no links, its own component, kept.
Ties in the order go to the smaller vec_id. Repeated rows are linked with each other and each is returned. An empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.llm.common import durable
from featmatrix.llm.components import connected_components


@dataclass(frozen=True)
class Passes:
    threshold: float = 0.93
    passes: int = 12
    bits: int = 48
    window: int = 32
    block: int = 1024
    chunk: int = 256
    side: int = 1024
    spread: int = 16
    most: int = 65_536
    seed: int = 17


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(classes: DataFrame, conf: Passes) -> DataFrame:
    """One row per class and pass with the concatenated bits as an integer."""
    places = np.int64(1) << np.arange(conf.bits - 1, -1, -1, dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            for size, part in frame.groupby("size"):
                if size not in planes:
                    draw = np.random.default_rng([conf.seed, size])
                    planes[size] = draw.standard_normal((size, conf.passes * conf.bits))
                signs = (_unit(part["embedding"]) @ planes[size] > 0).reshape(len(part), conf.passes, conf.bits)
                for turn in range(conf.passes):
                    yield part.assign(turn=turn, key=signs[:, turn] @ places)

    return classes.mapInPandas(run, classes.select("*").schema.simpleString()[7:-1].replace(":", " ") + ", turn int, key long")


def _ranked(keyed: DataFrame) -> DataFrame:
    """Add the global position in the order of pass, label and bits.

    Rows are dealt by range and sorted; a position is the sizes of the partitions before, plus the place within.
    """
    order = ["turn", "label", "size", "key", "rep"]
    schema = keyed.schema.simpleString()[7:-1].replace(":", " ") + ", part int, place long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            yield frame.assign(part=part, place=np.arange(at, at + len(frame)))
            at += len(frame)

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(run, schema))
    sizes = placed.groupBy("part").agg((F.max("place") + 1).alias("n")).orderBy("part").collect()  # one per partition
    offsets, total = [], 0
    for row in sizes:
        offsets += [F.lit(row["part"]), F.lit(total)]
        total += row["n"]
    if not offsets:
        return placed.withColumn("rank", F.col("place"))
    return placed.withColumn("rank", F.create_map(*offsets)[F.col("part")] + F.col("place"))


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the pairs, those that join two trees."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _window_edges(ranked: DataFrame, conf: Passes) -> DataFrame:
    """Verified pairs of neighbours, of each block a spanning forest."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable")
        pairs = []
        for _, part in frame.groupby(["turn", "label", "size"], sort=False):
            if len(part) < 2:
                continue
            x = _unit(part["embedding"])
            ranks = part["rank"].to_numpy()
            for step in range(1, min(conf.window, len(part) - 1) + 1):
                near = np.einsum("ij,ij->i", x[:-step], x[step:]) >= conf.threshold
                hit = np.flatnonzero(near & (ranks[step:] - ranks[:-step] == step))
                base = part["at"].to_numpy()
                pairs.append(np.stack([base[hit], base[hit + step]]))
        found = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
        rep = frame["rep"].to_numpy()
        edges = _forest(found[0], found[1], len(frame))
        return pd.DataFrame({"a": [rep[i] for i, _ in edges], "b": [rep[j] for _, j in edges]}, dtype="int64")

    block = F.floor(F.col("rank") / conf.block)
    late = F.col("rank") % conf.block >= conf.block - conf.window
    spread = ranked.withColumn("block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    columns = ["rank", "turn", "label", "size", "rep", "embedding"]

    def numbered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank", kind="stable").reset_index(drop=True)
        return compare(frame.assign(at=np.arange(len(frame))))

    return spread.select("block", *columns).groupBy("block").applyInPandas(numbered, "a long, b long").distinct()


def _cross_edges(placed: DataFrame, conf: Passes) -> DataFrame:
    """Pairs (a, b) of components to be joined: of each two blocks of a label, a spanning forest of what the passes missed.

    A label that fits into one window has been compared in full by every pass.
    """
    counts = placed.groupBy("label", "size").agg(F.count("*").alias("n")).where(F.col("n") > conf.window + 1)
    few = F.least(F.ceil(F.col("n") / conf.side), F.lit(conf.spread))
    salts = F.greatest(few, F.ceil(F.col("n") / conf.most)).cast("int")
    cells = (
        placed.join(counts, ["label", "size"])
        .withColumn("salts", salts)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, own = _unit(frame["embedding"]), frame["own"].to_numpy()
        names, of = np.unique(frame["component"].to_numpy(), return_inverse=True)
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
        single = x.astype(np.float32)
        least = conf.threshold - 1.2e-7 * (x.shape[1] + 4)  # the error of a product of unit vectors in single precision
        root = np.arange(len(names))
        edges = []
        for at in range(0, len(one), 512):
            for to in range(0, len(two), 4096):
                if low == high and to + 4096 <= at:
                    continue
                part, rest = one[at : at + 512], two[to : to + 4096]
                left, right = np.nonzero(single[part] @ single[rest].T >= least)
                for cut in range(0, len(left), 65_536):
                    i, j = part[left[cut : cut + 65_536]], rest[right[cut : cut + 65_536]]
                    apart = root[of[i]] != root[of[j]]
                    i, j = i[apart], j[apart]
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= conf.threshold
                    for a, b in _forest(root[of[i[near]]], root[of[j[near]]], len(root)):
                        edges.append((names[a], names[b]))
                        a, b = root[a], root[b]
                        root[root == max(a, b)] = min(a, b)
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return (
        cells.select("label", "size", "low", "high", "own", "component", "embedding")
        .groupBy("label", "size", "low", "high")
        .applyInPandas(compare, "a long, b long")
    )


def _count_links(members: DataFrame, conf: Passes) -> DataFrame:
    """(rep, links): the weight of the other classes of the component at or above the threshold.

    A component is cut into chunks by hash and every pair of chunks is compared in a task of its own.
    """
    chunks = F.ceil(F.col("n") / conf.chunk).cast("int")
    own = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    cells = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, weight, own = _unit(frame["embedding"]), frame["weight"].to_numpy(), frame["own"].to_numpy()
        links = np.zeros(len(frame), np.int64)
        low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
        one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
        for at in range(0, len(one), 2048):
            part = one[at : at + 2048]
            near = x[part] @ x[two].T >= conf.threshold
            if low == high:
                near &= part[:, None] != two[None, :]
            links[part] += near @ weight[two]
            if low != high:
                links[two] += weight[part] @ near
        return pd.DataFrame({"rep": frame["rep"], "links": links})

    return (
        cells.select("component", "low", "high", "own", "rep", "weight", "embedding")
        .groupBy("component", "low", "high")
        .applyInPandas(compare, "rep long, links long")
        .groupBy("rep")
        .agg(F.sum("links").alias("links"))
    )


def near_duplicate_vectors(vectors: DataFrame, conf: Passes = Passes()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.coalesce(~bad, F.lit(False)) & F.coalesce(length > 0, F.lit(False))
    )
    good = rows.where(usable)
    classes = durable(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        .select("rep", "label", F.size("embedding").alias("size"), "weight", "embedding")
    )
    edges = durable(_window_edges(_ranked(_keys(classes.drop("weight"), conf)), conf))
    found = connected_components(edges).withColumnRenamed("node", "rep")
    first = durable(classes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    joined = connected_components(_cross_edges(first, conf)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    placed = durable(first.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    links = _count_links(placed.join(sizes, "component"), conf)
    answer = (
        placed.join(links, "rep", "left")
        .select(
            "label", "embedding", F.col("component").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        )
    )
    out = good.join(answer, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
