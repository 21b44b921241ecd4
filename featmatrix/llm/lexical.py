"""Ranked lexical search: the best documents for each item, with documents scored once per class of equal bags.

A document is read once. Of its terms only those that some item holds count for a score, so it is reduced to its bag:
the vector of term frequencies over the vocabulary of the items. Documents with equal bags and an equal length part `m`
score alike for every item and form a class: they are brought together by hash and told apart by the whole bag. One
score per class and item is computed, as a product of the bags with the items in blocks of classes, and a class competes
with its smallest doc_id. Since every class has a member, the documents wanted lie in the `top` best classes of an item,
and of each class at most the `top` smallest doc_ids are needed. These are kept when the classes are formed, map-side
first, so a class with a third of all documents is never gathered.

Items are searched in blocks of `block_items`, each block against all documents. This bounds what the tasks are given
(vocabulary, weights) and what the driver collects, not what is found; statistics are always those of all documents.

Nulls: a null text has no terms, like an empty one, and counts nowhere. A null doc_id sorts first. Rows that repeat a
doc_id are ranked row by row; rows that repeat an item_id are one item with the terms of all of them; a null item_id is an
item like any other. Ties go to the smaller doc_id. An item without terms, or none of whose terms occur, has no rows;
an empty table of documents or items gives no rows. Long texts are read in pieces that end between terms. Further columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featmatrix.llm.common import durable, map_rows, small_batches

#: Digits, letters of ASCII in lower case, and every byte of characters beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

PIECE = 1 << 20
#: Cells of the table of scores that a task holds at a time.
CELLS = 1 << 21
FIRST = np.iinfo(np.int64).min


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of the terms of one piece."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # lowers A-Z alone
    at = 0
    while at < len(raw):
        cut = GAP.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield TERM.findall(raw, at, end)
        at = end


class _Items:
    """The items of a block: vocabulary, and the items that hold each term."""

    def __init__(self, rows: list[tuple[int | None, str | None]]) -> None:
        held: dict[int | None, set[bytes]] = {}
        for item_id, text in rows:
            held.setdefault(item_id, set()).update(t for part in terms(text) for t in part)
        self.ids = list(held)
        vocabulary = sorted(set().union(*held.values())) if held else []
        self.numbers = {t: i for i, t in enumerate(vocabulary)}
        holders: list[list[int]] = [[] for _ in vocabulary]
        for at, item_id in enumerate(self.ids):
            for t in held[item_id]:
                holders[self.numbers[t]].append(at)
        self.degree = np.array([len(h) for h in holders], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.degree)])[:-1].astype(np.int64) if vocabulary else self.degree
        self.holders = np.array([at for h in holders for at in h], np.int64)


def bags(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag) of the documents with a term; the bag holds numbers and frequencies of the vocabulary's terms."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        number = numbers.get
        for doc_id, text in rows:
            found: Counter = Counter()
            n = 0
            for part in terms(text):
                n += len(part)
                found.update(map(number, part))
            found.pop(None, None)
            if n:
                known = sorted(found)
                yield doc_id, n, np.array([known, [found[t] for t in known]], "<u4").tobytes()

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n long, bag binary", run)


def _document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs; tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                counts[np.frombuffer(bag, "<u4")[: len(bag) // 8]] += 1
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["term", "df"])

    sums = found.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(size, np.int64)
    for term, df in sums.collect():  # one row per term of the items
        out[term] = df
    return out


def _classes(found: DataFrame, documents: int, length: int, top: int) -> DataFrame:
    """(class_id, r, doc_id, m, bag): the `top` smallest doc_ids of every class; the first of them carries the bag."""
    with_m = found.where(F.length("bag") > 0).withColumn("m", F.expr(f"50 + (50 * n * {documents}L) div {length}L"))
    hashed = with_m.withColumn("hash", F.xxhash64("bag", "m"))
    # equal hashes are verified by the bag itself, which is part of the key
    members = Window.partitionBy("hash", "m", "bag").orderBy("doc_id", "row")
    so_far = members.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hashed.withColumns({"r": F.row_number().over(members), "class_id": F.first("row").over(so_far)})
    return ranked.where(F.col("r") <= top).select(
        "class_id", "r", "doc_id", "m", F.when(F.col("r") == 1, F.col("bag")).alias("bag")
    )


def _scores(batch: pa.RecordBatch, items: _Items, weights: np.ndarray) -> np.ndarray:
    """Scores of some classes (rows) for all items (columns)."""
    found = batch.column("bag").to_pylist()
    sizes = np.array([len(b) // 8 for b in found], np.int64)
    numbers = np.concatenate([np.frombuffer(b, "<u4")[: len(b) // 8] for b in found]).astype(np.int64)
    tf = np.concatenate([np.frombuffer(b, "<u4")[len(b) // 8 :] for b in found]).astype(np.int64)
    row = np.repeat(np.arange(len(found)), sizes)
    m = batch.column("m").to_numpy()[row]
    parts = weights[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
    degree = items.degree[numbers]
    ends = np.cumsum(degree)
    within = np.arange(ends[-1]) - np.repeat(ends - degree, degree)
    cells = np.repeat(row * len(items.ids), degree) + items.holders[np.repeat(items.start[numbers], degree) + within]
    scores = np.zeros(len(found) * len(items.ids), np.int64)
    np.add.at(scores, cells, np.repeat(parts, degree))
    return scores.reshape(len(found), -1)


def _best(held: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Of (item, score, doc_id, class_id), the best `top` of each item."""
    item, score, doc_id, _ = held
    order = np.lexsort((doc_id, -score, item))
    item = item[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else item
    rank = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
    return [x[order[rank < top]] for x in held]


def _leaders(classes: DataFrame, items: _Items, weights: np.ndarray, top: int) -> DataFrame:
    """(item, score, doc_id, class_id): the best classes of each task for every item."""
    step = max(1, CELLS // max(1, len(items.ids)))
    schema = pa.schema([(c, pa.int64()) for c in ("item", "score", "doc_id", "class_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64)] * 4
        least = np.ones(len(items.ids), np.int64)  # what a class needs at least to be among the best so far
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                scores = _scores(batch, items, weights)
                row, item = np.nonzero(scores >= least)
                ids = [batch.column(c).fill_null(FIRST).to_numpy()[row] for c in ("doc_id", "class_id")]
                best = _best([np.concatenate(x) for x in zip(best, [item, scores[row, item], *ids])], top)
                full = np.bincount(best[0], minlength=len(items.ids)) >= top
                lowest = np.full(len(items.ids), np.iinfo(np.int64).max)
                np.minimum.at(lowest, best[0], best[1])
                least = np.where(full, lowest, 1)
        columns = [pa.array(x) for x in best]
        columns[2] = pa.array(best[2], mask=best[2] == FIRST)
        yield pa.record_batch(columns, schema=schema)

    firsts = classes.where("r = 1").select("doc_id", "class_id", "m", "bag")
    return small_batches(firsts).mapInArrow(run, "item long, score long, doc_id long, class_id long")


def _block(docs: DataFrame, rows: list[tuple], top: int) -> DataFrame | None:
    items = _Items(rows)
    if not items.numbers:
        return None
    found = durable(bags(docs, items.numbers).withColumn("row", F.monotonically_increasing_id()))
    documents, length = found.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    frequencies = _document_frequencies(found, len(items.numbers))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequencies], np.int64)
    classes = durable(_classes(found, documents, length, top))
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    leaders = _leaders(classes, items, weights, top).withColumn("at", F.row_number().over(by_item)).where(F.col("at") <= top)
    members = leaders.select("item", "score", "class_id").join(classes.select("class_id", "doc_id"), "class_id")
    ranked = members.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "item long, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 50, block_items: int = 2000) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents with a score above 0 for every item."""
    blocks = max(1, math.ceil(items.count() / block_items))
    out = None
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "text").collect()
        part = _block(docs, [tuple(r) for r in mine], top)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
