"""Language by nearest centroid over TF-IDF weighted byte n-grams.

A text is lower-cased, ASCII marks and digits become blanks, and its byte 1- to 3-grams are counted in a fixed number
of hashed cells. Counts are damped by a logarithm, weighted by inverse document frequency and normalised. Each
language has several centroids from spherical k-means; the answer is the language of the centroid with the largest
cosine. A text is rejected when that cosine is below the floor of the centroid, a share of the smallest cosine that a
training text of its own has.

The model is fitted on a bounded sample: about `per_language` texts of each language, drawn by a hash of doc_id, so the
same ones every time. Prediction reads nothing but the text.

Null text, or text without a letter, gives `und` with score 0 and counts as rejected. A null doc_id is not held out. Ties go to the language first
in alphabetical order. Training rows with null text or language are left out; without any training row every text is
`und`. Repeated rows are predicted each by itself; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmatrix.llm.common import crc_mod, durable, map_rows

WORDLIKE = re.compile(r"[^\W\d_]")
BLANKED = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray  # cells x centroids
    floors: np.ndarray
    idf: np.ndarray


def gram_counts(text: str, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of the byte n-grams of a text."""
    raw = b" " + text.lower().encode("utf-8").translate(BLANKED) + b" "
    one = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = one[:-1] * np.uint32(257) + one[1:] + np.uint32(1 << 10)
    three = two[:-1] * np.uint32(263) + one[2:] + np.uint32(1 << 26)
    grams = np.concatenate([one, two, three]) * np.uint32(2654435761)
    counts = np.bincount(grams >> np.uint32(33 - cells.bit_length()), minlength=cells)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _weighted(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[found]
    return values / max(float(np.sqrt(values @ values)), 1e-12)


def _cluster(vectors: np.ndarray, k: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first starts; (centroids, smallest own cosine of each)."""
    centres = [vectors.mean(0)]
    while len(centres) < min(k, len(vectors)):
        near = np.max(vectors @ np.stack(centres).T, axis=1)
        centres.append(vectors[int(np.argmin(near))])
    centre = np.stack(centres)
    for _ in range(steps):
        own = np.argmax(vectors @ centre.T, axis=1)
        centre = np.stack([vectors[own == i].mean(0) if (own == i).any() else centre[i] for i in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    sims = vectors @ centre.T
    own = np.argmax(sims, axis=1)
    floors = np.array([sims[own == i, i].min() if (own == i).any() else 0.0 for i in range(len(centre))])
    return centre, floors


def fit(
    training: DataFrame, per_language: int = 500, centroids: int = 4, cells: int = 1 << 15, floor: float = 0.3, steps: int = 10
) -> LanguageModel:
    """Fit on about `per_language` texts of each language of (doc_id, text, lang)."""
    training = training.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel((), np.zeros((cells, 0)), np.zeros(0), np.ones(cells))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, per_language / n)])
    sample = training.where(draw < share[F.col("lang")])

    def vectors(rows: Iterator[tuple]) -> Iterator[tuple]:
        for lang, text in rows:
            found, counts = gram_counts(text, cells)
            yield lang, found.astype(np.int32), counts.astype(np.int32)

    grams = durable(map_rows(sample, ["lang", "text"], "lang string, cells array<int>, counts array<int>", vectors, 256))
    total = grams.count()
    frequency = np.zeros(cells)
    for row in grams.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect():  # `cells` rows at most
        frequency[row["cell"]] = row["count"]
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.zeros((len(frame), cells), np.float32)
        for i, (found, counts) in enumerate(zip(frame["cells"], frame["counts"])):
            vectors[i, found] = _weighted(found, counts, idf)
        centre, floors = _cluster(vectors, centroids, steps)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": list(centre), "floor": floors.astype(float)})

    found = grams.groupBy("lang").applyInPandas(cluster, "lang string, centre array<float>, floor double").collect()
    found.sort(key=lambda r: (r["lang"], r["centre"]))
    if not found:
        return LanguageModel((), np.zeros((cells, 0)), np.zeros(0), idf)
    return LanguageModel(
        tuple(r["lang"] for r in found),
        np.ascontiguousarray(np.array([r["centre"] for r in found], np.float32).T),
        floor * np.array([r["floor"] for r in found]),
        idf,
    )


def has_letter(text: str) -> bool:
    """Whether a text holds a letter; number signs such as a half are none."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def predict_one(text: str | None, model: LanguageModel) -> tuple[str, float, bool]:
    if not text or not model.languages or not has_letter(text):
        return "und", 0.0, True
    found, counts = gram_counts(text, len(model.idf))
    sims = _weighted(found, counts, model.idf) @ model.centroids[found]
    best = int(np.argmax(sims))
    score = float(min(max(sims[best], 0.0), 1.0))
    return model.languages[best], score, bool(score < model.floors[best])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document; the model is a few megabytes at any input size."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield (doc_id, *predict_one(text, held.value))

    return map_rows(docs, ["doc_id", "text"], SCHEMA, rows_of)


def keep_recognised(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents that are not rejected, all columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([not predict_one(t if isinstance(t, str) else None, held.value)[2] for t in texts], dtype=bool)

    return docs.where(known("text"))


def held_out(divisor: int = 3) -> Column:
    """A null doc_id is not held out."""
    return F.coalesce(crc_mod("doc_id", divisor) == 1, F.lit(False))
