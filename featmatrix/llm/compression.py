"""Quality by compression: which of two dictionaries, of good or of bad text, makes a document smaller.

From a bounded sample of labelled documents (`sample` for each label, by a hash of doc_id) half go to train one zstandard
dictionary per label, from up to `pieces` blocks of each document, and half to calibrate. A text is cut into blocks of
`block` bytes, all of them are compressed on their own under either dictionary, and the difference of the two sizes, as a
share of the text's bytes, is the evidence. Blocks are compressed on their own so that a long text does not become its own
dictionary. A logistic curve, fitted on the calibration half with the weights that the labels have among all labelled
documents, turns the evidence into a score.

Nulls, empty and odd cases: a null or empty text has the evidence 0 and the score that belongs to it. A null doc_id is
not held out and carries no label. Labels other than 0 and 1 are ignored, and so is a doc_id with both; of rows that
repeat a doc_id the smallest text is learned from, and each is scored by its own text. If a label has no text to learn
from, the score is the share of label 1 among the labels, 0.5 without any. An empty table gives no rows. Whole texts of any
length are scored block by block. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmatrix.llm.common import crc_mod, map_rows


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the logistic curve over their difference; without dictionaries the score is `share`."""

    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float
    share: float
    block: int = 1024
    level: int = 3

    def score(self, evidence: float) -> float:
        if self.good is None or self.bad is None:
            return self.share
        x = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def held_out() -> Column:
    """Whether a document is kept for tests: its labels are not learned from."""
    return F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))


def blocks(text: str | None, size: int) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def _dictionary(parts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the parts themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(
        level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Evidence:
    """(compressed size by bad text - by good text) / size, over the blocks of a text."""

    def __init__(self, model: CompressionModel) -> None:
        self.block = model.block
        self.known = model.good is not None and model.bad is not None
        if self.known:
            self.good, self.bad = (_compressor(d, model.level) for d in (model.good, model.bad))

    def __call__(self, text: str | None) -> float:
        parts = blocks(text, self.block) if self.known else []
        if not parts:
            return 0.0
        better = sum(len(self.bad.compress(p)) - len(self.good.compress(p)) for p in parts)
        return better / sum(map(len, parts))


def evidence(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """(doc_id, evidence) of every row."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        measure = Evidence(model)
        for doc_id, text in rows:
            yield doc_id, measure(text)

    return map_rows(docs, ["doc_id", "text"], "doc_id long, evidence double", run)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve of y over x, by Newton steps on centred x."""
    centre, scale = float(x.mean()), float(x.std()) or 1.0
    rows = np.stack([(x - centre) / scale, np.ones_like(x)], 1)
    beta = np.zeros(2)
    weights = weights / weights.sum()

    def loss(b: np.ndarray) -> float:
        z = rows @ b
        return float(weights @ (np.logaddexp(0, z) - y * z) + ridge / 2 * b[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -500, 500)))
        gradient = rows.T @ (weights * (p - y)) + [ridge * beta[0], 0.0]
        curve = (rows * (weights * p * (1 - p))[:, None]).T @ rows + np.diag([ridge, 1e-9])
        step = np.linalg.solve(curve, gradient)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-12:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, quality, half) of the sample, and how many documents have each label."""
    agreed = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).where("quality = _other")
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("at"))
    )
    counts = {r.quality: r["count"] for r in agreed.groupBy("quality").count().collect()}  # two rows
    chosen = None
    for quality in (0, 1):
        part = agreed.where(F.col("quality") == quality).orderBy("at", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64("at"), F.lit(2)))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.drop("at")), "doc_id")  # 2 * sample rows at most
    one_text = found.groupBy("doc_id", "quality", "half").agg(F.min("text").alias("text"))
    return one_text.where("length(text) > 0"), counts


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = 3000, pieces: int = 4, block: int = 1024, size: int = 112_640, level: int = 3
) -> CompressionModel:
    """The model of the labels of documents that are not held out.

    At most `sample` documents of each label are learned from; of each of the training half the driver gets `pieces`
    blocks, of the others the evidence.
    """
    chosen, counts = _labelled(docs, labels, sample)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, quality, text in rows:
            parts = blocks(text, block)
            pick = np.random.default_rng(doc_id & 0xFFFFFFFF).permutation(len(parts))[:pieces]
            for at in sorted(pick):
                yield doc_id, quality, int(at), parts[at]

    cut = map_rows(chosen.where("half = 0"), ["doc_id", "quality", "text"], "doc_id long, quality int, at int, part binary", run)
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for row in sorted(cut.collect()):
        parts[row.quality].append(bytes(row.part))
    if not (parts[0] and parts[1]):
        return CompressionModel(None, None, 0.0, 0.0, share, block, level)
    model = CompressionModel(_dictionary(parts[1], size), _dictionary(parts[0], size), 1.0, 0.0, share, block, level)
    rest = chosen.where("half = 1")
    measured = sorted(evidence(rest, model).join(rest.select("doc_id", "quality"), "doc_id").select("evidence", "quality").collect())
    x, y = (np.array([r[i] for r in measured], float) for i in (0, 1))
    if len(set(y)) < 2:
        return CompressionModel(None, None, 0.0, 0.0, share, block, level)
    weights = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    slope, offset = logistic(x, y, weights)
    return CompressionModel(model.good, model.bad, slope, offset, share, block, level)


def score(docs: DataFrame, model: CompressionModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        measure = Evidence(model)
        for doc_id, text in rows:
            found = model.score(measure(text))
            yield doc_id, found, int(found >= threshold)

    scored = map_rows(docs, ["doc_id", "text"], "doc_id long, score double, predicted int", run)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
