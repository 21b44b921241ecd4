"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct five-word shingles (64-bit hashes). Minima under 128 hash functions make 32 bands
of four for the candidate search, and are folded into an odd sketch: each minimum flips one of 512 bits, so the XOR of
two sketches counts the minima that differ, and its population count estimates high similarities well. A second parity
bitmap, of 2048 bits, folds the whole set: its XOR never has more ones than the sets have differing shingles, so it
rules out pairs for certain. Documents with equal sets are one class before the search.

1. In each band bucket every class is paired with the bucket's smallest; of these pairs each class keeps the one
   with the best sketch estimate. Full sets confirm or refute it. Confirmed pairs are united.
2. Buckets whose classes are still in several components get the rest of their pairs: members are cut into chunks,
   and chunk is compared with chunk by sketches. Of the pairs across components that the sketch lets through, each
   class first has its best one confirmed on full sets, and components are united; then all pairs that still lie
   across components are confirmed. So no link is lost, though a dense group needs about one confirmation a class.

A pair is looked at only in its first common bucket. A pair at the threshold shares a band with a chance of 0.999995,
and the estimate from the first sketch leaves four standard deviations of room.

Null and blank texts have an empty set, link with nothing and are kept. Every row is searched by its own text, also
where rows repeat a doc_id with one text or several; `text_hash` tells their answers apart. Ties go to the smaller doc_id. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.llm.common import durable, map_rows, mix64
from featmatrix.llm.components import connected_components, forest_roots


@dataclass(frozen=True)
class Sketching:
    percent: int = 75
    shingle: int = 5
    bands: int = 32
    rows: int = 4
    sketch_bits: int = 512
    parity_bits: int = 2048
    margin: float = 0.17
    chunk: int = 256
    seed: int = 5


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: lower-cases A-Z, splits at the six blanks
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return np.unique(mix64(total))


def minima(values: np.ndarray, multipliers: np.ndarray, addends: np.ndarray) -> np.ndarray:
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        part = values[at : at + 512, None] * multipliers[None, :]
        part += addends
        np.minimum(out, part.min(0), out=out)
    return out


def odd_sketch(mins: np.ndarray, bits: int) -> bytes:
    place = np.arange(len(mins), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    spots = mix64(mins ^ mix64(place)) % np.uint64(bits)
    return np.packbits((np.bincount(spots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def parity(values: np.ndarray, bits: int) -> bytes:
    """Parity bitmap of a whole set of hashes."""
    spots = (values >> np.uint64(20)) % np.uint64(bits)
    return np.packbits((np.bincount(spots.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def estimate(differing_bits: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    share = np.minimum(2 * differing_bits / bits, 1 - 1e-9)
    return 1 + bits / (4 * samples) * np.log(1 - share)


def text_hash(text: str | None) -> bytes | None:
    """What `F.unhex(F.md5("text"))` gives: null for null."""
    return None if text is None else hashlib.md5(text.encode("utf-8"), usedforsecurity=False).digest()


def signatures(docs: DataFrame, conf: Sketching) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands, sketch, text_hash); the sketch holds the odd sketch, then the set's parity bitmap."""
    draw = np.random.default_rng(conf.seed)
    count = conf.bands * conf.rows
    multipliers = draw.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    addends = draw.integers(0, 1 << 63, count, dtype=np.uint64)

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = _Words()
        for doc_id, text in rows:
            values, own = shingle_set(text, conf.shingle, known), text_hash(text)
            if not len(values):
                yield doc_id, 0, None, None, None, own
                continue
            mins = minima(values, multipliers, addends)
            grid = mins.reshape(conf.bands, conf.rows)
            key = np.arange(1, conf.bands + 1, dtype=np.uint64)
            for i in range(conf.rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, i])
            yield (
                doc_id, len(values), xxhash.xxh3_128_digest(values.tobytes()), key.view(np.int64),
                odd_sketch(mins, conf.sketch_bits) + parity(values, conf.parity_bits), own,
            )

    schema = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary, text_hash binary"
    return map_rows(docs, ["doc_id", "text"], schema, rows_of, batch=1024)


def _similar_enough(first: bytes, second: bytes, percent: int) -> bool:
    a, b = np.frombuffer(first, np.uint64), np.frombuffer(second, np.uint64)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, conf: Sketching) -> DataFrame:
    """(a, b): the components `ca` and `cb` of those pairs whose full sets reach the similarity."""
    percent = conf.percent
    joined = (
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("one")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("two")), "b")
        .select("ca", "cb", "one", "two")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [_similar_enough(x, y, percent) for x, y in zip(frame["one"], frame["two"])]
            yield frame.loc[good, ["ca", "cb"]].set_axis(["a", "b"], axis=1)

    return joined.mapInPandas(run, "a long, b long")


def _likely(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, conf: Sketching) -> tuple[np.ndarray, np.ndarray]:
    """(similarity estimates, whether the pair can reach the similarity); sketches as rows of 64-bit words."""
    words = conf.sketch_bits // 64
    differ = np.bitwise_count(one ^ two)
    similar = estimate(differ[:, :words].sum(1, dtype=np.int64), conf.bands * conf.rows, conf.sketch_bits)
    least_apart = differ[:, words:].sum(1, dtype=np.int64)  # shingles that differ, at least
    possible = (100 + conf.percent) * least_apart <= (100 - conf.percent) * (n_one + n_two)
    sizes = 100 * np.minimum(n_one, n_two) >= conf.percent * np.maximum(n_one, n_two)
    return similar, sizes & possible & (similar >= conf.percent / 100 - conf.margin)


def _sketch_filter(pairs: DataFrame, conf: Sketching) -> DataFrame:
    """Add the sketch estimate of (a, b, sketch_a, sketch_b, n_a, n_b) and drop what cannot reach the similarity."""

    @F.pandas_udf("double")
    def similarity(one: pd.Series, two: pd.Series, n_one: pd.Series, n_two: pd.Series) -> pd.Series:
        if not len(one):
            return pd.Series([], dtype=float)
        x = np.frombuffer(b"".join(one), np.uint64).reshape(len(one), -1)
        y = np.frombuffer(b"".join(two), np.uint64).reshape(len(two), -1)
        similar, good = _likely(x, y, n_one.to_numpy(), n_two.to_numpy(), conf)
        return pd.Series(np.where(good, similar, -9.0))

    return pairs.withColumn("similar", similarity("sketch_a", "sketch_b", "n_a", "n_b")).where("similar > -9")


def _pairs_across(members: DataFrame, conf: Sketching) -> DataFrame:
    """(a, b, ca, cb, similar): pairs of different components `ca` and `cb` in one bucket that the sketch lets through.

    Chunk is compared with chunk; each pair comes once, from its first common bucket.
    """
    chunks = F.ceil(F.col("n") / conf.chunk).cast("int")
    cells = (
        members.withColumn("own", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
            "rep", "component", "n_shingles", "sketch", "bands",
        )
    )

    def compare(frame: pd.DataFrame) -> Iterator[tuple]:
        bucket, low, high = frame["bucket"].iloc[0], frame["low"].iloc[0], frame["high"].iloc[0]
        own, rep, comp = frame["own"].to_numpy(), frame["rep"].to_numpy(), frame["component"].to_numpy()
        size = frame["n_shingles"].to_numpy()
        words = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
        bands = np.stack(frame["bands"].to_list())
        two = np.flatnonzero(own == high)
        for i in np.flatnonzero(own == low):
            against = two if low != high else two[two > i]
            against = against[comp[against] != comp[i]]
            if len(against):
                similar, good = _likely(words[against], words[i][None], size[against], size[i], conf)
                against, similar = against[good], similar[good]
                first = np.argmax(bands[against] == bands[i], axis=1)  # their first common bucket
                here = bands[i][first] == bucket
                for j, value in zip(against[here], similar[here]):
                    x, y = (i, j) if rep[i] > rep[j] else (j, i)
                    yield rep[x], rep[y], comp[x], comp[y], value

    kinds = {"a": "int64", "b": "int64", "ca": "int64", "cb": "int64", "similar": "float64"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            whole = pd.concat(held) if len(held) > 1 else held[0]
            return pd.DataFrame(compare(whole), columns=["a", "b", "ca", "cb", "similar"]).astype(kinds)

        for frame in frames:
            key = frame[["bucket", "low", "high"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(frame)]
            for start, end in zip(cuts, cuts[1:]):
                part = frame.iloc[start:end]
                if held and tuple(held[-1][["bucket", "low", "high"]].iloc[0]) != tuple(key[start]):
                    yield done()
                    held = []
                held.append(part)
        if held:
            yield done()

    order = ["bucket", "low", "high"]
    schema = "a long, b long, ca long, cb long, similar double"
    return cells.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, schema)


def _renamed(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """The rows with a component column as `found` (node, component) names it now."""
    now = found.select(F.col("node").alias(column), F.col("component").alias("_now"))
    return rows.join(now, column, "left").withColumn(column, F.coalesce("_now", column)).drop("_now")


def near_duplicates(docs: DataFrame, conf: Sketching = Sketching()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row of (doc_id, text).

    A class is all rows of one set, and is named by the number of its first row.
    """
    docs = docs.select("doc_id", "text")
    signed = durable(signatures(docs, conf).withColumn("row", F.monotonically_increasing_id()))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    firsts = real.groupBy("set_hash").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    reps = firsts.select("set_hash", F.col("first.row").alias("rep"))
    classes = durable(
        real.join(firsts.select(F.col("first.row").alias("row")), "row")
        .select(F.col("row").alias("rep"), "doc_id", "text_hash", "n_shingles", "sketch", "bands")
    )
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = durable(banded.join(buckets, "bucket"))  # only classes that share a bucket
    traits = classes.select("rep", "n_shingles", "sketch")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        one = traits.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
        two = traits.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(one, "a").join(two, "b")

    stars = shared.where("rep > first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    rated = _sketch_filter(with_sketches(stars), conf).select("a", "b", "similar")
    best = durable(
        rated.groupBy("a").agg(F.max(F.struct("similar", -F.col("b"))).alias("top"))
        .select("a", (-F.col("top.col2")).alias("b"), F.col("a").alias("ca"), (-F.col("top.col2")).alias("cb"))
    )

    searched = classes.select("rep", "doc_id", "text_hash").join(shared.select("rep").distinct(), "rep", "left_semi")
    # one text of each class; made distinct by the keys of the join, so that neither texts nor full sets are shuffled again
    texts = docs.withColumn("text_hash", F.unhex(F.md5("text"))).join(searched, ["doc_id", "text_hash"])
    sets = durable(map_sets(texts.dropDuplicates(["doc_id", "text_hash"]).select("rep", "text"), conf))
    # each class has one link to a smaller one here
    state = durable(_renamed(classes.select("rep", F.col("rep").alias("component")), "component", forest_roots(_confirm(best, sets, conf))))

    placed = shared.join(state, "rep")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    members = placed.join(mixed.select("bucket"), "bucket").join(classes.select("rep", "n_shingles", "sketch", "bands"), "rep")
    across = durable(_pairs_across(members, conf))
    dense = across.groupBy("a").agg(F.max(F.struct("similar", -F.col("b"), "ca", "cb")).alias("top"))
    dense = dense.select("a", (-F.col("top.col2")).alias("b"), "top.ca", "top.cb")
    joined = durable(connected_components(_confirm(dense, sets, conf)))
    rest = _renamed(_renamed(across, "ca", joined), "cb", joined).where("ca <> cb")
    final = _renamed(_renamed(state, "component", joined), "component", connected_components(_confirm(rest, sets, conf)))

    # a component is named by its smallest doc_id; by set, so that a large group of copies meets its answer in a join
    # that can be split
    named = final.join(classes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = reps.join(final, "rep").join(named, "component").select("set_hash", "component_id")
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id")
    return (
        signed.select("doc_id", "n_shingles", "set_hash", "text_hash")
        .join(answer, "set_hash", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"), "text_hash")
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def map_sets(texts: DataFrame, conf: Sketching) -> DataFrame:
    """(rep, shingles): the full set of each text as sorted 64-bit integers in bytes."""

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        known = _Words()
        for rep, text in rows:
            yield rep, shingle_set(text, conf.shingle, known).tobytes()

    return map_rows(texts, ["rep", "text"], "rep long, shingles binary", rows_of, batch=256)
