"""Merkle manifest of a table of documents, stored in van Emde Boas order.

Every document is a leaf. The leaves of a source, by ascending doc_id, are the lowest level of a tree of 16 children a
node (the last node of a level may have fewer, even one), and the subroots of the sources, by ascending source, are the
lowest level of one more such tree, whose root stands for the whole table.

Layout. A tree of h levels is cut at half height into a top and its bottom subtrees, and each of these again in the
same way; `address` gives a node's place in that order, by arithmetic alone. The cutting stops at subtrees of at most
`BLOCK` levels: such an aligned subtree is one row, a block, whose nodes lie at consecutive addresses, so the place of a
node within its block is found by the same arithmetic. A block holds at most 16^(BLOCK-1) lowest nodes, whatever the
table. Absent nodes of incomplete trees leave gaps and take no space at the end of a block.

Construction goes up: the blocks at the bottom are made from leaves, and their roots are the leaves of the blocks above
them. Sibling retrieval goes down: the siblings above a block are found once for the block and handed to the blocks
below it, so a leaf reads nothing but its own block. Both are shuffles by block, streamed block by block. Leaves get
their number from a sort by range, so that a source with most of the rows is spread over tasks.

Nulls: a null field is hashed as `-`; null sources form a group of their own that comes first; a null doc_id sorts
first and is never tampered with. Rows that repeat a doc_id are separate leaves, ordered by digest, and equal rows are
neighbouring equal leaves. An empty text is `0:`. An empty table has no leaves, no blocks and no rows. Texts of any
length are hashed where they are read and never moved. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmatrix.llm.common import durable, map_rows

FAN = 16
#: Most levels of one block.
BLOCK = 3
#: Most levels of a tree: enough for 16^15 leaves.
LEVELS = 16
DIGEST = 32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# Address arithmetic


def tree_size(height: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FAN**height - 1) // (FAN - 1)


def tree_height(leaves: int) -> int:
    """Levels of a tree over so many leaves; a lone leaf is a tree of one level."""
    height = 1
    while leaves > 1:
        leaves = -(-leaves // FAN)
        height += 1
    return height


def address(height: int, depth: int, index: int) -> int:
    """Place of the node `index` of level `depth` (0 is the root) in a complete tree of `height` levels."""
    at = 0
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        below = FAN ** (depth - top)
        at += tree_size(top) + index // below * tree_size(height - top)
        index, depth, height = index % below, depth - top, height - top
    return at


@lru_cache
def tiers(height: int) -> tuple[int, ...]:
    """Levels of the blocks that the cutting ends with, from the bottom of the tree to its top."""
    if height <= BLOCK:
        return (height,)
    return (*tiers(height - height // 2), *tiers(height // 2))


@lru_cache
def _places(height: int, depth: int) -> tuple[int, ...]:
    return tuple(address(height, depth, i) for i in range(FAN**depth))


# Blocks


def _hash(parts: Iterable[bytes]) -> bytes:
    """Digest of digests, which enter as hexadecimal text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def build_block(height: int, lowest: Sequence[bytes]) -> bytes:
    """All nodes of a block over its lowest nodes, in van Emde Boas order."""
    levels = [list(lowest)]
    for _ in range(height - 1):
        below = levels[-1]
        levels.append([_hash(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    levels.reverse()
    places = [(_places(height, depth)[i], digest) for depth, level in enumerate(levels) for i, digest in enumerate(level)]
    out = bytearray(DIGEST * (1 + max(at for at, _ in places)))
    for at, digest in places:
        out[at * DIGEST : (at + 1) * DIGEST] = digest
    return bytes(out)


def siblings(nodes: bytes, height: int, counts: Sequence[int], index: int) -> list[tuple[int, bytes]]:
    """For the lowest node `index`, level by level up to below the block's root: its place in its run, and the others of the run.

    `counts` holds the nodes of each level of this block, from the root down.
    """
    path = []
    for depth in range(height - 1, 0, -1):
        run = index // FAN * FAN
        places = _places(height, depth)[run : min(run + FAN, counts[depth])]
        at = index - run
        path.append((at, b"".join(nodes[p * DIGEST : (p + 1) * DIGEST] for i, p in enumerate(places) if i != at)))
        index //= FAN
    return path


def fold(digest: bytes, path: Iterable[tuple[int, bytes]]) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for at, others in path:
        digest = _hash((others[: at * DIGEST], digest, others[at * DIGEST :]))
    return digest


def _level_counts(height: int, lowest: int) -> list[int]:
    counts = [lowest]
    for _ in range(height - 1):
        counts.append(-(-counts[-1] // FAN))
    return counts[::-1]


# Numbering leaves, building blocks


def number_leaves(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """`leaves` with `idx` (from 0 within its `grp`, by the order) and `n` (leaves of the group).

    The sort is by range over group and order together, so large groups are split; what is summed over is one row per
    task and group. `leaves` must be a written table, because the range sort reads it twice.
    """
    session = leaves.sparkSession
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order, "_tie"]
    tied = leaves.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = durable(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.spark_partition_id()).drop("_tie"))
    shares = placed.groupBy("grp", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = "sum(_rows) over (partition by grp order by _task rows between unbounded preceding and current row) - _rows"
    total = "sum(_rows) over (partition by grp)"
    shares = shares.select(
        F.col("grp").alias("_grp"), F.col("_task").alias("_t"), F.expr(f"{before} - _first").alias("_shift"), F.expr(total).alias("n")
    )
    same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_task") == F.col("_t"))
    rows = placed.join(shares, same).withColumn("idx", F.col("_at") + F.col("_shift"))
    return rows.drop("_at", "_task", "_grp", "_t", "_shift")


def _height_col(n: Column) -> Column:
    steps = F.lit(1)
    for level in range(1, LEVELS):
        steps = steps + (n > F.lit(FAN ** (level - 1))).cast("int")
    return steps


def _tier_col(height: Column, tier: int) -> Column:
    """Levels of the blocks of a tier, null above the top."""
    levels = F.array(*(F.lit(tiers(h)[tier] if tier < len(tiers(h)) else None).cast("int") for h in range(1, LEVELS + 1)))
    return F.get(levels, height - 1)


def _streamed(rows: DataFrame, columns: list[str], schema: str, work, order: Sequence[str]) -> DataFrame:
    """Rows brought together by (grp, block), in order, and handed to `work` block by block."""

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        for _, members in groupby(found, key=lambda r: r[:2]):
            yield from work(members)

    together = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", *order)
    return map_rows(together, ["grp", "block", *columns], schema, run)


BLOCKS = "grp string, block long, n long, height int, nodes binary"


def _make_lowest(members: Iterator[tuple]) -> Iterator[tuple]:
    """A block over at most FAN ** (BLOCK - 1) leaves."""
    held = list(members)
    grp, block, _, n, height, _ = held[0]
    yield grp, block, n, height, build_block(height, [r[5] for r in held])


def _make_above(members: Iterator[tuple]) -> Iterator[tuple]:
    """A block over at most FAN ** BLOCK roots of the tier below: its lowest nodes are the runs of sixteen of them."""
    held = list(members)
    grp, block, _, n, height, _ = held[0]
    roots = [r[5] for r in held]
    yield grp, block, n, height, build_block(height, [_hash(roots[i : i + FAN]) for i in range(0, len(roots), FAN)])


def build_tiers(leaves: DataFrame) -> list[DataFrame]:
    """Blocks (grp, block, n, height, nodes) of every tier, from the bottom; `leaves` has grp, idx, n and leaf.

    The number of tiers follows from the largest group: one number for the driver.
    """
    largest = leaves.agg(F.max("n")).first()[0]
    if largest is None:
        return []
    rows = leaves.select("grp", "idx", "n", "leaf")
    out: list[DataFrame] = []
    for tier in range(len(tiers(tree_height(largest)))):
        rows = rows.withColumn("height", _tier_col(_height_col(F.col("n")), tier)).where("height is not null")
        # the lowest tier holds the leaves themselves; the others lie one level above the roots that they are made from
        covered = "(height - 1) * 4" if tier == 0 else "height * 4"
        rows = rows.withColumn("block", F.expr(f"shiftright(idx, {covered})"))
        blocks = _streamed(
            rows, ["idx", "n", "height", "leaf"], BLOCKS, _make_lowest if tier == 0 else _make_above, ["idx"]
        )
        out.append(durable(blocks))
        rows = out[-1].select("grp", F.col("block").alias("idx"), "n", F.substring("nodes", 1, DIGEST).alias("leaf"))
    return out


# Retrieval


def _at_lowest(n: int, tier: int, height: int) -> int:
    """Nodes on the lowest level of a tier in a tree over n leaves."""
    for one in range(tier):
        for _ in range(tiers(height)[one]):
            n = -(-n // FAN)
    return n


def _pack(path: Sequence[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes((at, len(others) // DIGEST)) + others for at, others in path)


def unpack(packed: bytes) -> list[tuple[int, bytes]]:
    path, at = [], 0
    while at < len(packed):
        end = at + 2 + packed[at + 1] * DIGEST
        path.append((packed[at], packed[at + 2 : end]))
        at = end
    return path


def paths_to_blocks(blocks: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks with `above`: the packed siblings from the block's root up to the root of all.

    `tops` has (grp, above) for the root of each group. A block's root lies in a run whose other members are roots of
    neighbouring blocks; these are read from the tier itself, sixteen blocks at a time.
    """
    known = None
    for tier in range(len(blocks) - 1, -1, -1):
        here = blocks[tier].withColumn("_tops", F.size(_tiers_array(_height_col(F.col("n")))))
        top = here.where(F.col("_tops") == tier + 1).drop("_tops")
        top = top.join(tops.withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g")), "left").drop("_g")
        with_path = top
        if known is not None:
            lower = here.where(F.col("_tops") > tier + 1).drop("_tops")
            # sixteen neighbouring roots meet, and get what lies above their run
            runs = lower.withColumn("run", F.shiftright("block", 4)).select(F.col("grp"), F.col("run").alias("block"), F.col("block").alias("idx"), "n", "height", "nodes")
            above = known.select("grp", "block", "above")
            met = runs.withColumn("above", F.lit(None).cast("binary")).unionByName(
                above.select(
                    "grp", "block", F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("height"),
                    F.lit(None).cast("binary").alias("nodes"), "above",
                )
            )
            found = _streamed(
                met, ["idx", "n", "height", "nodes", "above"],
                f"{BLOCKS}, above binary", _spread_runs, ["idx"],
            )
            with_path = top.unionByName(found)
        if tier == 0:
            return with_path
        known = map_rows(
            with_path, ["grp", "block", "n", "height", "nodes", "above"], "grp string, block long, above binary", _run_paths(tier)
        )
    raise ValueError("no blocks")


def _tiers_array(height: Column) -> Column:
    return F.get(F.array(*(F.array(*(F.lit(t) for t in tiers(h))) for h in range(1, LEVELS + 1))), height - 1)


def _run_paths(tier: int):
    """For each lowest node of a block, which stands for a run of sixteen roots below: the siblings above that run."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for grp, block, n, height, nodes, above in rows:
            width = FAN ** (height - 1)
            lowest = min(width, _at_lowest(n, tier, tree_height(n)) - block * width)
            counts = _level_counts(height, lowest)
            for i in range(lowest):
                yield grp, block * width + i, _pack(siblings(nodes, height, counts, i)) + above

    return work


def _spread_runs(members: Iterator[tuple]) -> Iterator[tuple]:
    first, *held = list(members)  # the path above, then at most sixteen blocks
    above, roots = first[6], [r[5][:DIGEST] for r in held]
    for at, (grp, _, idx, n, height, nodes, _) in enumerate(held):
        others = b"".join(roots[:at] + roots[at + 1 :])
        yield grp, idx, n, height, nodes, _pack([(at, others)]) + above


def _proofs(members: Iterator[tuple]) -> Iterator[tuple]:
    """Every leaf of a block with its siblings up to the root, also as text; the block's own row comes first."""
    block = next(members)
    _, number, _, n, height, nodes, above = block[:7]
    upper = unpack(above)
    upper_hex = b"".join(others for _, others in upper).hex()
    width = FAN ** (height - 1)
    counts = _level_counts(height, min(width, n - number * width))
    for row in members:
        own = siblings(nodes, height, counts, row[2] - number * width)
        yield row, own + upper, b"".join(others for _, others in own).hex() + upper_hex


# The manifest of documents


def _field(name: str) -> Column:
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_table(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, grp, leaf, changed): the digest of every document, and where `tampered` holds that of its tampered text.

    Tampering lower-cases A-Z; `changed` is null where the digest stays the same. The table is written once.
    """
    head = F.concat(*(_field(c) for c in FIELDS[:-1]))
    own = F.unhex(F.sha2(F.concat(head, _field("text")).cast("binary"), 256))
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    other = F.concat(F.octet_length(lowered).cast("string"), F.lit(":"), lowered)
    touched = (F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))) & F.col("text").rlike("[A-Z]")
    changed = F.when(touched, F.unhex(F.sha2(F.concat(head, other).cast("binary"), 256)))
    return docs.select("doc_id", F.col("source").alias("grp"), own.alias("leaf"), changed.alias("changed"))


class Manifest:
    """The numbered leaves, the blocks of every source's tree, and the blocks of the tree over the sources.

    `root` is the table's digest in lowercase hexadecimal, None for an empty table.
    """

    def __init__(self, docs: DataFrame, tampered: Column | None = None) -> None:
        self.leaves = durable(number_leaves(durable(leaf_table(docs, tampered)), ["doc_id", "leaf"]))
        self.blocks = build_tiers(self.leaves)
        self.root: str | None = None
        if not self.blocks:
            return
        self.subroots = durable(self._tops())
        names = self.subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("subroot").alias("leaf"))
        self.sources = durable(number_leaves(names, ["source"]))
        self.source_blocks = build_tiers(self.sources)
        self.root = bytes(self.source_blocks[-1].first()["nodes"][:DIGEST]).hex()

    def _tops(self) -> DataFrame:
        """(grp, subroot): the root of the highest block of every source."""
        parts = None
        for tier, blocks in enumerate(self.blocks):
            top = blocks.where(F.size(_tiers_array(_height_col(F.col("n")))) == tier + 1)
            top = top.select("grp", F.substring("nodes", 1, DIGEST).alias("subroot"))
            parts = top if parts is None else parts.unionByName(top)
        return parts

    def table(self) -> DataFrame:
        """The manifest to store: one row per block, in van Emde Boas order by (tree, source, address).

        `tree` is 0 for the tree over the sources and 1 for those of the sources. A block's nodes of 32 bytes follow
        each other from `address` on.
        """
        if not self.blocks:
            empty = "tree int, source string, n long, address long, height int, nodes binary"
            return self.leaves.sparkSession.createDataFrame([], empty)
        parts = [
            blocks.select(
                F.lit(tree).alias("tree"), F.when(F.lit(tree == 1), F.col("grp")).alias("source"), "n",
                block_address(F.col("n"), tier, F.col("block")).alias("address"), "height", "nodes",
            )
            for tree, trees in ((0, self.source_blocks), (1, self.blocks))
            for tier, blocks in enumerate(trees)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _source_paths(self) -> DataFrame:
        """(grp, subroot, above): the packed siblings of every subroot up to the root."""
        everything = self.source_blocks[-1].select("grp", F.lit(b"").alias("above")).distinct()
        lowest = paths_to_blocks(self.source_blocks, everything)
        rows = _with_leaves(self.sources.withColumn("changed", F.lit(None).cast("binary")), lowest, "source")

        def run(members: Iterator[tuple]) -> Iterator[tuple]:
            for row, path, _ in _proofs(members):
                yield row[7], row[8], _pack(path)

        return _streamed(
            rows, ["idx", "n", "height", "nodes", "above", "label", "leaf"], "grp string, subroot binary, above binary", run, ["idx"]
        )

    def proofs(self) -> DataFrame:
        """Per document: doc_id, leaf, subroot, root, proof_sha256 (of its siblings up to the root), folded_root, verified."""
        if not self.blocks:
            return self.leaves.sparkSession.createDataFrame([], PROOFS)
        above = durable(self._source_paths())
        lowest = paths_to_blocks(self.blocks, above.select("grp", "above"))
        rows = _with_leaves(self.leaves, lowest, "doc_id")
        root = self.root

        def run(members: Iterator[tuple]) -> Iterator[tuple]:
            for row, path, others in _proofs(members):
                doc_id, leaf, changed = row[7:]
                proof = hashlib.sha256(others.encode()).hexdigest()
                folded = fold(changed or leaf, path).hex()
                yield row[0], doc_id, leaf.hex(), proof, folded, folded == root

        found = _streamed(
            rows, ["idx", "n", "height", "nodes", "above", "label", "leaf", "changed"],
            "grp string, doc_id long, leaf string, proof_sha256 string, folded_root string, verified boolean", run, ["idx"],
        )
        subroots = self.subroots.select(F.col("grp").alias("_g"), F.lower(F.hex("subroot")).alias("subroot"))
        return found.join(subroots, F.col("grp").eqNullSafe(F.col("_g"))).select(
            "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", "verified"
        )


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def block_address(n: Column, tier: int, block: Column) -> Column:
    """Address of a block's root in the tree of its group, as a Column: the arithmetic of `address`, unrolled by height."""
    out = F.lit(None).cast("long")
    height = _height_col(n)
    for h in range(1, LEVELS + 1):
        if tier < len(tiers(h)):
            out = F.when(height == h, _address_col(h, sum(tiers(h)[tier + 1 :]), block)).otherwise(out)
    return out


def _address_col(height: int, depth: int, index: Column) -> Column:
    at = F.lit(0).cast("long")
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        bits = 4 * (depth - top)
        at = at + F.lit(tree_size(top)) + F.shiftright(index, bits) * F.lit(tree_size(height - top))
        index, depth, height = index.bitwiseAND(F.lit((1 << bits) - 1)), depth - top, height - top
    return at


def _with_leaves(leaves: DataFrame, lowest: DataFrame, label: str) -> DataFrame:
    """Blocks (idx -1) and the leaves of each, to be streamed together."""
    none = lambda kind: F.lit(None).cast(kind)
    kind = dict(leaves.dtypes)[label]
    blocks = lowest.select(
        "grp", "block", F.lit(-1).cast("long").alias("idx"), "n", "height", "nodes", "above",
        none(kind).alias("label"), none("binary").alias("leaf"), none("binary").alias("changed"),
    )
    span = (_tier_col(_height_col(F.col("n")), 0) - 1) * 4
    members = leaves.withColumn("_bits", span).select(
        "grp", F.expr("shiftright(idx, _bits)").alias("block"), "idx", "n", F.lit(0).alias("height"), none("binary").alias("nodes"),
        none("binary").alias("above"), F.col(label).alias("label"), "leaf", "changed",
    )
    return blocks.unionByName(members)


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The Merkle manifest of the documents; rows for which `tampered` holds are later verified with a tampered text."""
    return Manifest(docs, tampered)
