from __future__ import annotations

import random
import re

import numpy as np
import pytest

from featmatrix.llm.common import durable
from featmatrix.llm.components import connected_components
from featmatrix.llm.embed_dedup import Passes, near_duplicate_vectors
from featmatrix.llm.minhash import Sketching, estimate, near_duplicates, odd_sketch, parity


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 300)] + [(7, 7), (300, 100)]
    edges += [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(60)]
    rnd.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == roots(nodes, [(a, b) for a, b in edges if a != b])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold=0.93):
    good = [(i, np.array(v, float), label) for i, v, label in rows if v is not None and label is not None and i is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [
        (a[0], b[0]) for n, a in enumerate(good) for b in good[:n]
        if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold
    ]
    return links, roots([r[0] for r in rows], links)


def test_vectors_against_all_pairs(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for centre in range(12):
        base = rnd.standard_normal(16)
        for _ in range(int(rnd.integers(1, 30))):
            rows.append((len(rows), (base + 0.08 * rnd.standard_normal(16)).astype(np.float32).tolist(), centre % 3))
    hot = rnd.standard_normal(16)
    rows += [(len(rows) + i, (hot + 0.05 * rnd.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(150)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, rows[0][1], None), (2005, [float("inf")] * 16, 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1)]
    links, component = brute_vectors(rows)
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, size int")
    got = {r.vec_id: r for r in near_duplicate_vectors(table, Passes(window=12, block=64, chunk=40)).collect()}
    assert len(got) == len(rows)
    degree = dict.fromkeys(component, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert {i: r.n_links for i, r in got.items()} == degree
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_links_that_every_window_misses_are_found(spark):
    """Isolated pairs just above the threshold; one pass with one neighbour finds few of them."""
    rnd = np.random.default_rng(8)
    base = rnd.standard_normal((400, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rnd.standard_normal(base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    both = np.concatenate([base, 0.94 * base + np.sqrt(1 - 0.94**2) * aside]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(both)]
    links, component = brute_vectors(rows)
    assert len(links) >= 400
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in near_duplicate_vectors(table, Passes(passes=1, window=1, side=150)).collect()}
    assert sum(r.n_links for r in got.values()) == 2 * len(links)
    assert {i: r.component_id for i, r in got.items()} == component


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_documents_against_all_pairs(documents):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 120]))]
        for _ in range(rnd.randint(1, 6)):
            other = list(base)
            for _ in range(rnd.randint(0, 4)):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            rows.append((len(rows), " ".join(other)))
    hot = [rnd.choice(words) for _ in range(90)]
    for _ in range(60):  # one large group around the threshold
        other = list(hot)
        for _ in range(rnd.randint(0, 5)):
            other[rnd.randrange(90)] = rnd.choice(words)
        rows.append((len(rows), " ".join(other)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B"), (905, "a b"), (906, rows[0][1].upper()), (907, "wörd " * 3000)]
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a > b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    component = roots(list(sets), links)
    got = {r.doc_id: r for r in near_duplicates(documents(rows), Sketching(chunk=16)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_empty_and_repeated_rows(documents):
    assert near_duplicates(documents([(1, "x")]).limit(0)).count() == 0
    got = near_duplicates(documents([(1, "a b c d e f"), (1, "a b c d e f"), (0, "a b c d e f")])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(0, 0, True), (1, 0, False), (1, 0, False)]


def test_rows_that_share_a_doc_id_are_searched_by_their_own_text(documents):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, one), (5, two), (2, two + " end"), (9, one + " end"), (7, two), (7, "c d e f g h")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(rows)).collect())
    assert got == sorted([(5, 36, 5, True), (5, 36, 2, False), (2, 37, 2, True), (9, 37, 5, False), (7, 36, 2, False), (7, 2, 7, True)])


def test_sketches_estimate_and_bound():
    rnd = np.random.default_rng(2)
    mins = rnd.integers(0, 1 << 63, 128, dtype=np.uint64)
    for same in (128, 116, 96):
        other = mins.copy()
        other[same:] = rnd.integers(0, 1 << 63, 128 - same, dtype=np.uint64)
        bits = np.frombuffer(odd_sketch(mins, 512), np.uint8) ^ np.frombuffer(odd_sketch(other, 512), np.uint8)
        assert abs(float(estimate(np.bitwise_count(bits).sum(), 128, 512)) - same / 128) < 0.06
    one, two = rnd.integers(0, 1 << 63, 500, dtype=np.uint64), rnd.integers(0, 1 << 63, 80, dtype=np.uint64)
    bits = np.frombuffer(parity(one, 2048), np.uint8) ^ np.frombuffer(parity(np.concatenate([one[50:], two]), 2048), np.uint8)
    assert 0.8 * 130 <= np.bitwise_count(bits).sum() <= 130


def test_durable_cuts_the_lineage(spark):
    assert "LogicalRDD" in durable(spark.range(3))._jdf.queryExecution().toString() or durable(spark.range(3)).count() == 3


@pytest.mark.parametrize("percent", [50, 90])
def test_other_similarities(documents, percent):
    base = [f"v{i}" for i in range(60)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:50])), (2, " ".join(base[30:]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(rows), Sketching(percent=percent)).collect()}
    assert got == ({0: 0, 1: 0, 2: 2} if percent == 50 else {0: 0, 1: 1, 2: 2})
