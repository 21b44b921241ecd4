"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A word's probability is that of its class given the words before it, times that of the word within its class.

* Classes: word endings (last two bytes) are clustered by what precedes and follows them in the training texts; the
  end of a text is a class of its own.
* Class given history: a maximum-entropy model over hashed features, namely the last word, the last two words, and
  the word before the last (a skip feature). It is trained by distributed gradient updates: each round, every task
  runs AdaGrad over all its documents from the shared weights, and the changes are averaged, weighted by tokens.
* Word within class: smoothed relative frequency, for which counts of all training words are kept in a table.

The most frequent `vocabulary` words (a fixed bound) and the weights (`buckets` x `classes`) are sent to the tasks.
All other words are known there by their ending only; their counts come from a join, because the logarithm of the
within-class probability simply adds up. So no table that grows with the corpus is ever held in one place.

Null text counts as empty: only the end token. Words of equal frequency are all taken or none. Without any training text
all counts are 0. Repeated rows are separate documents for training; rows that repeat a doc_id are scored each by
itself. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.llm.common import durable, map_rows, small_batches

#: Parts of scores: sums of a document without its rare words, and rows of its rare words.
SCORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("token", pa.binary()), ("times", pa.int64()), ("n", pa.int64()),
    ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()),
])

#: The end of a text; no word holds a line feed.
END = b"\n"


@dataclass(frozen=True)
class Settings:
    vocabulary: int = 50_000
    endings: int = 512
    classes: int = 16
    buckets: int = 1 << 15
    rounds: int = 2
    batch: int = 1 << 15
    rate: float = 0.3
    task_tokens: int = 4_000_000
    blocks: int = 32


def tokens_of(text: str | None) -> list[bytes]:
    """Words (UTF-8) with A-Z lower-cased, then the end. Bytes are split at blanks and tab to carriage return only."""
    return [*(text or "").encode("utf-8").lower().split(), END]


class Vocabulary(dict):
    """Ids of words: frequent ones have their own, all others that of their ending."""

    def __init__(self, words: list[bytes], endings: list[bytes], classes: np.ndarray | None = None):
        super().__init__((w, i + 1) for i, w in enumerate(words))
        self[END] = 0
        self.first_rare = len(words) + 1
        self.endings = {e: i + 1 for i, e in enumerate(endings)}  # 0: any other ending
        own = [0] + [self.endings.get(w[-2:], 0) + 1 for w in words]
        #: ending + 1 of every id; 0 is the end of a text
        self.ending = np.array(own + list(range(1, len(endings) + 2)), np.int64)
        self.classes = None if classes is None else classes[self.ending]

    def __missing__(self, word: bytes) -> int:
        return self.first_rare + self.endings.get(word[-2:], 0)

    def encode(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts; tasks combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def found() -> Iterator[pa.RecordBatch]:
            words, times = pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())
            for at in range(0, len(words), 50_000):
                yield pa.record_batch([words.slice(at, 50_000), times.slice(at, 50_000)], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens_of(text))
                if len(counts) > 400_000:
                    yield from found()
                    counts.clear()
        yield from found()

    parts = small_batches(docs).select("text").mapInArrow(run, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def _sum_blocks(parts: DataFrame, width: int, dtype: str) -> np.ndarray:
    """Add arrays that came as (block, salt, bytes): first by block and salt, then by block, each as a stream."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            for block, salt, values in zip(frame["block"], frame["salt"], frame["values"]):
                part = np.frombuffer(values, dtype)
                key = (block, salt)
                sums[key] = sums[key] + part if key in sums else part
        rows = [(b, s, v.tobytes()) for (b, s), v in sums.items()]
        yield pd.DataFrame(rows, columns=["block", "salt", "values"])

    schema = "block int, salt int, values binary"
    some = parts.repartition("block", "salt").mapInPandas(add, schema)
    whole = some.withColumn("salt", F.lit(0)).repartition("block").mapInPandas(add, schema).collect()
    found = {r["block"]: np.frombuffer(r["values"], dtype) for r in whole}  # a fixed number of blocks
    return np.concatenate([found[b] for b in sorted(found)]) if found else np.zeros(width, dtype)


def _as_blocks(values: np.ndarray, blocks: int, salt: int) -> list[tuple]:
    return [(b, salt, part.tobytes()) for b, part in enumerate(np.split(values.ravel(), blocks))]


def _few_tasks(docs: DataFrame, tokens: int, conf: Settings) -> DataFrame:
    """Whole partitions taken together, so that each task has enough tokens for a sum of a fixed size."""
    least = docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(least, math.ceil(tokens / conf.task_tokens)))


def _encoded(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(ids): the ids of every text, as 32-bit integers; written once, since every pass of the training reads them."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = vocabulary.value
        for (text,) in rows:
            yield (words.encode(tokens_of(text)).astype("<i4").tobytes(),)

    return durable(map_rows(docs, ["text"], "ids binary", run, batch=1024))


def _id_batches(texts: Iterator[tuple], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of whole texts, each with two ends before it, in batches of about `size` tokens, and which are tokens.

    A very long text comes in several batches; each goes on with the history of the one before.
    """
    held: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    total, start = 0, np.zeros(2, np.int64)
    for (raw,) in texts:
        ids = np.frombuffer(raw, "<i4").astype(np.int64)
        for at in range(0, len(ids), size):
            part = ids[at : at + size]
            held += [ids[at - 2 : at] if at else start, part]
            marks += [np.zeros(2, bool), np.ones(len(part), bool)]
            total += len(part)
            if total >= size:
                yield np.concatenate(held), np.concatenate(marks)
                held, marks, total = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(marks)


def _ending_neighbours(encoded: DataFrame, vocabulary: Broadcast, n: int, conf: Settings) -> np.ndarray:
    """n x n counts of which ending follows which."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = vocabulary.value
        total = np.zeros(n * n, np.int64)
        for ids, good in _id_batches(rows, conf.batch):
            own = words.ending[ids]
            total += np.bincount((own[:-1] * n + own[1:])[good[1:]], minlength=n * n)
        room = np.zeros(-len(total) % conf.blocks, np.int64)
        yield from _as_blocks(np.concatenate([total, room]), conf.blocks, int(total.sum() % 64))

    parts = map_rows(encoded, ["ids"], "block int, salt int, values binary", run, batch=conf.blocks)
    return _sum_blocks(parts, n * n, "<i8")[: n * n].reshape(n, n)


def _cluster_endings(follows: np.ndarray, classes: int) -> np.ndarray:
    """The class of each ending; class 0 is the end of a text alone."""
    n = len(follows)
    mass = follows.sum(0)
    shape = np.concatenate([np.sqrt(follows + 0.0), np.sqrt(follows.T + 0.0)], 1)
    shape /= np.maximum(np.linalg.norm(shape, axis=1, keepdims=True), 1e-12)
    order = [i for i in np.argsort(-mass, kind="stable") if i != 0]
    centre = shape[order[:1]]
    while len(centre) < min(classes - 1, len(order)):  # far from all so far, and frequent
        far = (1 - (shape @ centre.T).max(1)) * np.sqrt(mass)
        far[0] = -1
        centre = np.concatenate([centre, shape[[int(np.argmax(far))]]])
    own = np.zeros(n, np.int64)
    for _ in range(15):
        own = np.argmax(shape @ centre.T, axis=1)
        for k in range(len(centre)):
            if (inside := (own == k) & (np.arange(n) > 0)).any():
                middle = (shape[inside] * mass[inside, None]).sum(0)
                centre[k] = middle / max(np.linalg.norm(middle), 1e-12)
    own += 1
    own[0] = 0
    return own


def _rows(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Hashed feature rows of each position from the third on: last word, last two, word before the last."""
    one, two = ids[1:-1].astype(np.uint64), ids[:-2].astype(np.uint64)
    mult, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - (buckets.bit_length() - 1))
    features = np.stack([one * np.uint64(3) + np.uint64(1), (one << np.uint64(20)) + two * np.uint64(7) + np.uint64(5), two * np.uint64(3) + np.uint64(2)])
    return ((features + np.uint64(11)) * mult >> shift).astype(np.int64)


def _chances(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    scores = weights.take(rows[0], axis=0)
    scores += weights.take(rows[1], axis=0)
    scores += weights.take(rows[2], axis=0)
    scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(1, keepdims=True)
    return scores


def _train_round(encoded: DataFrame, vocabulary: Broadcast, weights: Broadcast, conf: Settings) -> np.ndarray:
    """The averaged change of the weights after one pass over these documents."""
    shape = (conf.buckets, conf.classes)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = vocabulary.value
        own = weights.value.copy()
        squares = np.full(shape, 1e-3, np.float32)
        seen = 0
        for ids, marks in _id_batches(rows, conf.batch):
            good = np.flatnonzero(marks[2:])
            where = _rows(ids, conf.buckets).take(good, axis=1)
            error = _chances(own, where)
            error[np.arange(error.shape[0]), words.classes[ids[2:][good]]] -= 1
            for feature in where:
                order = np.argsort(feature.astype(np.uint16) if conf.buckets <= 1 << 16 else feature, kind="stable")
                sorted_rows = feature[order]
                starts = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
                slope = np.add.reduceat(error.take(order, axis=0), starts, axis=0)
                touched = sorted_rows[starts]
                square = squares.take(touched, axis=0)
                square += slope * slope
                squares[touched] = square
                slope *= -conf.rate
                slope /= np.sqrt(square, out=square)
                slope += own.take(touched, axis=0)
                own[touched] = slope
            seen += len(good)
        if seen:
            change = (own - weights.value).astype(np.float64) * seen
            parts = np.split(change.ravel().astype(np.float32), conf.blocks)
            salt = seen % 64
            for b, part in enumerate(parts):
                yield b, salt, np.append(part, np.float32(seen)).tobytes()

    parts = map_rows(encoded, ["ids"], "block int, salt int, values binary", run, batch=conf.blocks)
    width = shape[0] * shape[1]
    total = _sum_blocks(parts, width + conf.blocks, "<f4").reshape(conf.blocks, -1)
    return (total[:, :-1] / np.maximum(total[:, -1:], 1)).reshape(shape)


def _frequent(words: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, at most `most`.

    Counts fall into bands of a twentieth of an octave; the bands that together hold no more words are taken whole,
    so no task hands on more than belongs to the answer.
    """
    band = F.floor(F.log2("n") * 20)
    bands = sorted((r["band"], r["count"]) for r in words.groupBy(band.alias("band")).count().collect())  # 1300 at most
    total, least = 0, None
    for value, count in reversed(bands):
        total += count
        if total > most:
            break
        least = value
    if least is None:
        return []
    found = words.where(band >= least).collect()
    return sorted(((bytes(r["token"]), int(r["n"])) for r in found), key=lambda x: (-x[1], x[0]))


@dataclass(frozen=True)
class Model:
    vocabulary: Broadcast
    weights: Broadcast
    counts: DataFrame
    top: Broadcast  # log10(count + 0.5) of each id below first_rare
    tokens: int
    distinct: int
    class_logs: np.ndarray  # log10 of each class's smoothed size


def fit(training: DataFrame, conf: Settings = Settings()) -> Model:
    """Train on every text of the table."""
    spark = training.sparkSession
    texts = training.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = durable(count_tokens(texts))
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = int(total[0] or 0), int(total[1] or 0)
    words_only = counts.where(F.col("token") != F.lit(END))
    top = _frequent(words_only, conf.vocabulary)
    ending = F.substring(F.col("token"), -2, 2)
    sizes = words_only.groupBy(ending.alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    by_size = sorted(((bytes(r["ending"]), int(r["n"]), int(r["v"])) for r in sizes), key=lambda x: (-x[1], x[0]))
    endings = [e for e, _, _ in by_size[: conf.endings]]
    words = [w for w, _ in top]
    plain = spark.sparkContext.broadcast(Vocabulary(words, endings))
    encoded = _encoded(_few_tasks(texts, tokens, conf), plain)
    n = len(endings) + 2
    classes = _cluster_endings(_ending_neighbours(encoded, plain, n, conf), conf.classes)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(words, endings, classes))
    mass, kinds = np.zeros(conf.classes), np.zeros(conf.classes)
    place = {e: i + 2 for i, e in enumerate(endings)}
    for e, count, v in by_size:
        k = classes[place.get(e, 1)]
        mass[k] += count
        kinds[k] += v
    ends = tokens - int(mass.sum())
    mass[0], kinds[0] = ends, min(1, ends)
    weights = np.zeros((conf.buckets, conf.classes), np.float32)
    for _ in range(conf.rounds if tokens else 0):
        held = spark.sparkContext.broadcast(weights)
        weights = weights + _train_round(encoded, vocabulary, held, conf)
        held.unpersist()
    found = np.log10(np.array([ends] + [n for _, n in top], float) + 0.5)
    return Model(
        vocabulary, spark.sparkContext.broadcast(weights.astype(np.float32)), counts, spark.sparkContext.broadcast(found),
        tokens, distinct, np.log10(mass + 0.5 * (kinds + 1)),
    )


def score(docs: DataFrame, model: Model, conf: Settings = Settings()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document.

    A task adds up all but the counts of rare words, which it hands on as (row, word, times) to a join by word; the
    sums per row follow from one aggregation.
    """
    vocabulary, weights, top, class_logs = model.vocabulary, model.weights, model.top, model.class_logs
    trained = model.tokens > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table, logs = vocabulary.value, weights.value, top.value
        row = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        rare_words: list[bytes] = []
        rare_times: list[int] = []

        def documents() -> pa.RecordBatch:
            ids = np.concatenate([x for _, _, own, _ in held for x in (np.zeros(2, np.int64), own)])
            starts = np.cumsum([0] + [len(own) + 2 for _, _, own, _ in held])[:-1]
            shown = ids[2:]
            chance = np.empty(len(ids))
            chance[:2] = 0
            for at in range(0, len(shown), conf.batch):
                part = ids[at : at + conf.batch + 2]
                if len(part) > 2:
                    p = _chances(table, _rows(part, conf.buckets))
                    k = words.classes[part[2:]]
                    chance[at + 2 : at + len(part)] = np.log10(p[np.arange(len(k)), k] + 1e-30) - class_logs[k]
            frequent = ids < words.first_rare
            known = frequent & trained  # without training text not even the end is known
            base = np.where(frequent, logs[np.minimum(ids, words.first_rare - 1)], 0.0)
            rows = []
            for (number, doc_id, own, _), start in zip(held, starts.tolist()):
                span = slice(start + 2, start + 2 + len(own))
                sums = float(base[span].sum())
                rows.append((number, doc_id, None, 0, len(own), int(known[span].sum()), sums, sums + float(chance[span].sum())))
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), SCORED)], schema=SCORED)

        def rare_rows() -> pa.RecordBatch:
            n = len(rare_words)
            owners = np.repeat([r for r, _, _, _ in held], [c for _, _, _, c in held])
            zeros, nothing = np.zeros(n, np.int64), np.zeros(n)
            columns = [owners, pa.nulls(n, pa.int64()), pa.array(rare_words, pa.binary()), rare_times, zeros, zeros, nothing, nothing]
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, SCORED)], schema=SCORED)

        size = 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = tokens_of(text)
                own = words.encode(tokens)
                rare = Counter(map(tokens.__getitem__, np.flatnonzero(own >= words.first_rare).tolist()))
                rare_words.extend(rare.keys())
                rare_times.extend(rare.values())
                held.append((row, doc_id, own, len(rare)))
                row += 1
                size += len(own)
                if size >= conf.batch:
                    yield documents()
                    yield rare_rows()
                    held, size, rare_words, rare_times = [], 0, [], []
        if held:
            yield documents()
            yield rare_rows()

    schema = "row long, doc_id long, token binary, times long, n long, known long, base double, model double"
    parts = durable(small_batches(docs).select("doc_id", "text").mapInArrow(run, schema))
    rare = (
        parts.where("token is not null").select("row", "doc_id", "token", "times")
        .join(model.counts.withColumnRenamed("n", "count"), "token", "left")
    )
    times, count = F.col("times"), F.coalesce("count", F.lit(0))
    added = times * F.log10(count + 0.5)
    rare = rare.select(
        "row", "doc_id", F.lit(0).cast("long").alias("n"), F.when(count > 0, times).otherwise(0).alias("known"),
        added.alias("base"), added.alias("model"),
    )
    whole = parts.where("token is null").select("row", "doc_id", "n", "known", "base", "model").unionByName(rare)
    sums = whole.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n", "known", "base", "model")], F.max("doc_id").alias("doc_id"))
    per_token = math.log10(model.tokens + 0.5 * (model.distinct + 1))
    return sums.select(
        "doc_id", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * per_token).alias("base_score"), F.col("model").alias("score"),
    )
