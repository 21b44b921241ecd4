from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from featmatrix.llm import merkle
from featmatrix.llm.common import crc_mod


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels_over(lowest):
    levels = [list(lowest)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def walk(levels, index, value):
    """(what the value folds to, the siblings met) on the way up."""
    met = ""
    for level in levels[:-1]:
        run = index // 16 * 16
        left, right = "".join(level[run:index]), "".join(level[index + 1 : run + 16])
        value, met, index = digest(left + value + right), met + left + right, index // 16
    return value, met


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of every row; also the trees by source."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = levels_over([leaf_of(r) for r in groups[s]])
    top = levels_over([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, row in enumerate(groups[s]):
            touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            value, low = walk(trees[s], i, leaf_of((*row[:4], lowered(row[4]))) if touched else leaf_of(row))
            folded, high = walk(top, at, value)
            out.append((row[0], leaf_of(row), trees[s][-1][0], top[-1][0], digest(low + high), folded, folded == top[-1][0]))
    return out, trees, top


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, n long, idx string, leaf int"


def table(spark, rows):
    """With further columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)


def made_up():
    rnd = random.Random(11)
    rows = [(i, "hot", "en", i % 9, f"Text {i} " + "é" * (i % 4)) for i in range(4100)]  # blocks of three tiers' heights
    rows += [(10_000 + i, f"s{i % 23}", None, None, rnd.choice(["Abc", "abc", None, "", "Ä"])) for i in range(160)]
    rows += [(20_000 + i, None, "de", 1, "X") for i in range(17)] + [(30_000, "Ünique", "fr", 1, "Y" * 300_000)]
    rows += [(None, "s1", "en", 3, "Null"), (None, "s1", "en", 3, "Other"), (10_001, "s1", "en", 2, "again"), (5, "hot", "en", 5, "Text 5 é")]
    rnd.shuffle(rows)
    return rows


def test_proofs_by_brute_force(spark):
    rows = made_up()
    found = merkle.manifest(table(spark, rows), crc_mod("doc_id", 5) == 0)
    order = lambda r: tuple((x is not None, str(x)) for x in r)
    want, _, _ = brute(rows)
    assert sorted((tuple(r) for r in found.proofs().collect()), key=order) == sorted(want, key=order)
    assert {r[6] for r in want} == {True, False}


def test_stored_nodes_lie_at_their_addresses(spark):
    rows = made_up()
    _, trees, top = brute(rows)
    stored = {}
    for r in merkle.manifest(table(spark, rows)).table().collect():
        for i in range(len(r.nodes) // 32):
            node = bytes(r.nodes[32 * i : 32 * i + 32])
            if any(node):
                assert stored.setdefault((r.tree, r.source, r.address + i), node.hex()) == node.hex()
    want = {}
    for tree, source, levels in [(0, None, top), *((1, s, t) for s, t in trees.items())]:
        for depth, level in enumerate(reversed(levels)):
            for i, node in enumerate(level):
                want[tree, source, merkle.address(len(levels), depth, i)] = node
    assert stored == want


@pytest.mark.parametrize("height", range(1, 5))
def test_addresses_fill_a_tree_without_gaps(height):
    found = [merkle.address(height, d, i) for d in range(height) for i in range(16**d)]
    assert sorted(found) == list(range(merkle.tree_size(height)))
    # the recursive split: the top half comes first, each bottom subtree is one run
    top = height // 2
    assert sorted(merkle.address(height, d, i) for d in range(top) for i in range(16**d)) == list(range(merkle.tree_size(top)) if top else [])


def test_block_heights_follow_the_split():
    assert [merkle.tiers(h) for h in (1, 3, 4, 5, 7, 9)] == [(1,), (3,), (2, 2), (3, 2), (2, 2, 3), (3, 2, 2, 2)]
    assert [merkle.tree_height(n) for n in (1, 2, 16, 17, 256, 257)] == [1, 2, 2, 3, 3, 4]


def test_empty_table_and_single_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = merkle.manifest(empty)
    assert none.root is None and none.proofs().count() == 0 and none.table().count() == 0
    lone = [(7, None, None, None, None)]
    found = merkle.manifest(spark.createDataFrame([(*lone[0], 1, "x", 2)], SCHEMA))
    assert [tuple(r) for r in found.proofs().collect()] == brute(lone)[0] and found.root == digest("1:7----")
