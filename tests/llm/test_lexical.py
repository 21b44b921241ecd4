from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from featmatrix.llm import lexical
from featmatrix.llm.common import durable

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    """By the definition, document by document."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    held = {}
    for item_id, text in items:
        held.setdefault(item_id, set()).update(terms_of(text))
    out = []
    for item_id, terms in held.items():
        scores = []
        for doc_id, bag in bags:
            m = 100 - 50 + (50 * bag.total() * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in terms & bag.keys()
            )
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "ÄÖ", "x1y", "日本"]
    docs = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ",", ".", "!", "\t", "_"]) for _ in range(rnd.choice([1, 4, 20, 200])))) for i in range(300)]
    docs += [(1000 + i, "W1 w2, w3 the same") for i in range(400)]  # one class with more than half of the rows
    docs += [(2000 + i, ("w4 w5 " if i % 2 else "w5 w4 ") + " ".join(f"z{i}x{k}" for k in range(3))) for i in range(90)]  # equal bags, other texts
    docs += [(5000, None), (5001, ""), (5002, " .,;\n"), (None, "w7 w8"), (None, "w7 w8"), (17, "w9 w9 repeated id"), (17, "w1"), (6000, "w3 " * 30_000)]
    rnd.shuffle(docs)
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 12])))) for i in range(25)]
    items += [(100, "W1 w2 W3"), (101, None), (102, "--"), (103, "nowhere"), (None, "w7"), (104, "w1"), (104, "w8 w8"), (105, "w4 w5")]
    return docs, items


def tables(spark, docs, items):
    """With further columns whose names the operator uses itself."""
    d = spark.createDataFrame([(i, t, 5, "b", 1) for i, t in docs], "doc_id long, text string, n long, bag string, rank int")
    return d.repartition(7), spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")


@pytest.mark.parametrize("options", [{}, {"top": 3}, {"block_items": 6}])
def test_ranks_by_brute_force(spark, corpus, options):
    found = [tuple(r) for r in lexical.search(*tables(spark, *corpus), **options).collect()]
    assert sorted(found, key=str) == brute(*corpus, options.get("top", 50))


def test_a_class_is_scored_once_and_cut_before_the_shuffle(spark, corpus, plan_of):
    docs, items = tables(spark, *corpus)
    known = lexical._Items([tuple(r[:2]) for r in items.collect()])
    found = durable(lexical.bags(docs, known.numbers).withColumn("row", lexical.F.monotonically_increasing_id()))
    classes = lexical._classes(found, 800, 20_000, 50)
    assert plan_of(classes).count("WindowGroupLimit") >= 2  # before and after the exchange
    sizes = Counter(r.class_id for r in classes.collect())
    assert max(sizes.values()) == 50
    assert classes.where("r = 1").count() == len(sizes) == classes.where("bag is not null").count()


def test_empty_tables(spark, corpus):
    docs, items = tables(spark, *corpus)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("text is null"), items), (docs, items.where("item_id in (101, 102)"))):
        found = lexical.search(d, i)
        assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("aBé1日 .,") for _ in range(rnd.randrange(60)))
        assert [t.decode() for part in lexical.terms(text) for t in part] == terms_of(text)
