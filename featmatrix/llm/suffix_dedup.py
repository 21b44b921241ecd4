"""Repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

Removes every byte that lies in a string of `length` bytes which also starts somewhere else. Sorting every suffix
would move the corpus a hundred times over, so a sparse set of suffixes is sorted, chosen by content:

* In each window of `length` bytes the `gram`-byte string with the smallest hash is its anchor. Equal windows have
  equal anchors at equal distances, so only windows with equal anchors can be equal. Consecutive windows with one
  anchor are kept together as one item: the suffix at the anchor, the bytes before it, and the range of windows.
* Each task first counts its anchors; anchors that occur once in the whole corpus need no sorting. One row per task
  and anchor is moved, so no anchor is hot.
* Each task sorts its remaining suffixes (a run), unites equal items, front-codes the run (shared prefix length and
  the rest) and deals it to ranges by the hash of the anchor. A range merges its runs with a loser tree which keeps
  the known common prefix of every competitor and compares only from there on.
* Neighbours in merged order with one anchor form a group. The common prefixes known from the merge tell how far two
  items agree to the right, the bytes before the anchor how far to the left; both give the windows that are equal.
* Anchors with very many different surroundings (`hot` occurrences or more) are not grouped: each of their windows is
  an item of its own, sorted and merged in the same way. It is dealt by the `lowest` grams of smallest hash in it, so
  such a group spreads out while neighbouring windows mostly meet again; what a run or a range finds of a document
  leaves it as ranges, not as windows.

The texts are first written, compressed, to the shared checkpoint folder; a run is one partition of that copy, so a
lost executor never changes what a run holds.

Null text counts as empty. Rows are told apart by a number of their own, so repeated or null row_ids are separate
documents. An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featmatrix.llm.common import durable, mix64, small_batches

BASE = 0x9E3779B97F4A7C15

@dataclass(frozen=True)
class Repeats:
    length: int = 200
    gram: int = 80
    hot: int = 2000
    lowest: int = 3
    range_items: int = 40_000


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 4096)
            out = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                steps = np.full(self.size, base, np.uint64)
                steps[0] = 1
                out.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def gram_hashes(raw: bytes, conf: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """(sums that give the hash of any part, hash of the gram at each place) of a text."""
    size = len(raw)
    values = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _POWERS.upto(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(values * up[:-1], dtype=np.uint64, out=sums[1:])
    return sums, mix64((sums[conf.gram :] - sums[: -conf.gram]) * down[: size - conf.gram + 1])


def window_codes(grams: np.ndarray, first: int, last: int, conf: Repeats) -> np.ndarray:
    """A hash of each window's `lowest` grams of smallest hash: equal for equal windows, mostly equal for neighbours."""
    width = conf.length - conf.gram + 1
    inside = np.lib.stride_tricks.sliding_window_view(grams[first : last + width], width)
    low = np.sort(np.partition(inside, conf.lowest - 1, axis=1)[:, : conf.lowest], axis=1)
    code = low[:, 0]
    for i in range(1, conf.lowest):
        code = mix64(code + low[:, i])
    return code


def anchors(raw: bytes, conf: Repeats) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor position, first window, last window, item hash) of each item of a text."""
    size = len(raw)
    if size < conf.length:
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64)
    sums, grams = gram_hashes(raw, conf)
    _, down = _POWERS.upto(size + 1)
    width = conf.length - conf.gram + 1
    n = len(grams)
    padded = np.full(n + -n % width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = grams
    blocks = padded.reshape(-1, width)
    # minimum and its leftmost place from each block's start and to each block's end
    ahead = np.minimum.accumulate(blocks, axis=1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    places = np.arange(padded.size).reshape(blocks.shape)
    fresh = np.ones(blocks.shape, bool)
    fresh[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, places, 0), axis=1).ravel()
    behind_at = np.minimum.accumulate(np.where(blocks == behind, places, padded.size)[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    head, tail = behind.ravel()[:windows], ahead.ravel()[width - 1 : width - 1 + windows]
    place = np.where(head <= tail, behind_at[:windows], ahead_at[width - 1 : width - 1 + windows])
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], windows) - 1
    place = place[first]
    ends = last + conf.length
    item = mix64((sums[ends] - sums[first]) * down[first] + (ends - first).astype(np.uint64))
    return grams[place], place, first, last, item


def _shared(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be `start` at least."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(keys: list[bytes]) -> tuple[list[int], bytes]:
    """Shared prefix lengths of a sorted run and all rests, one after the other."""
    shared, rests, before = [], [], b""
    for key in keys:
        same = _shared(before, key, 0)
        shared.append(same)
        rests.append(key[same:])
        before = key
    return shared, b"".join(rests)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the key before) of all keys in sorted order, by a loser tree.

    Every competitor carries the length of the prefix it shares with the last winner it lost to. The one with the
    longer such prefix is smaller; only at equal lengths are the keys compared, and then from there on.
    """
    runs = [r for r in runs]
    width = 1
    while width < len(runs):
        width *= 2
    keys = [r[0] for r in runs]
    common = [r[1] for r in runs]
    at = [0] * len(runs)
    loser = [-1] * width
    held = [0] * width  # common prefix of the loser with the key that beat it

    def better(a: int, same_a: int, b: int, same_b: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix); -1 is an exhausted run."""
        if b < 0:
            return a, same_a, b, 0
        if a < 0:
            return b, same_b, a, 0
        if same_a != same_b:
            return (a, same_a, b, same_b) if same_a > same_b else (b, same_b, a, same_a)
        x, y = keys[a][at[a]], keys[b][at[b]]
        same = _shared(x, y, same_a)
        a_first = same == len(x) if same == len(x) or same == len(y) else x[same] < y[same]
        if same == len(x) == len(y):
            a_first = a < b
        return (a, same_a, b, same) if a_first else (b, same_b, a, same)

    level = [(i if i < len(runs) and keys[i] else -1, 0) for i in range(width)]
    node = width
    while len(level) > 1:
        node //= 2
        above = []
        for i in range(0, len(level), 2):
            win, same, lost, rest = better(*level[i], *level[i + 1])
            loser[node + i // 2], held[node + i // 2] = lost, rest
            above.append((win, same))
        level = above
    win, same = level[0]
    while win >= 0:
        yield win, at[win], same
        run = win
        at[run] += 1
        if at[run] < len(keys[run]):
            same = common[run][at[run]]
        else:
            win, same = -1, 0
        node = (run + width) // 2
        while node:
            lost, rest = loser[node], held[node]
            if win < 0 or lost < 0 or same == rest:
                win, same, loser[node], held[node] = better(win, same, lost, rest)
            elif rest > same:
                loser[node], held[node], win, same = win, same, lost, rest
            node //= 2


def equal_windows(items: list[tuple], right: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each item of one anchor, the ranges of its windows that another item holds too.

    An item is (suffix, bytes before, smallest and largest distance of a window start before the anchor). `right` has
    the common prefix of each suffix with the one before it; items are in the order of their suffixes.
    """
    n = len(items)
    found: list[list[tuple[int, int]]] = [[] for _ in items]
    if n <= 24:
        for i in range(n):
            _, before, low, high = items[i]
            reach = length
            for j in range(i + 1, n):
                reach = min(reach, right[j])
                other = items[j]
                least = max(length - reach, low, other[2])
                most = min(high, other[3])
                if least <= most:
                    most = min(most, _shared(before[::-1], other[1][::-1], 0))
                    if least <= most:
                        found[i].append((least, most))
                        found[j].append((least, most))
        return found
    low, high = np.array([x[2] for x in items]), np.array([x[3] for x in items])
    steps = np.array([0, *right[1:]])
    left = [x[1][::-1] for x in items]
    order = sorted(range(n), key=left.__getitem__)
    left_steps = np.array([0, *(_shared(left[a], left[b], 0) for a, b in zip(order, order[1:]))])
    for distance in range(int(low.min()), int(high.max()) + 1):
        right_class = np.cumsum(steps < length - distance)
        left_class = np.empty(n, np.int64)
        left_class[order] = np.cumsum(left_steps < distance) if distance else 0
        inside = np.flatnonzero((low <= distance) & (high >= distance))
        _, names, counts = np.unique(right_class[inside] * (n + 1) + left_class[inside], return_inverse=True, return_counts=True)
        for i in inside[counts[names] > 1].tolist():
            if found[i] and found[i][-1][1] == distance - 1:
                found[i][-1] = (found[i][-1][0], distance)
            else:
                found[i].append((distance, distance))
    return found


def _packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, packed): numbered rows with compressed texts; the upper bits of a number are its run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, press = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=3)
        for frame in frames:
            raw = [press.compress(t.encode("utf-8") if isinstance(t, str) else b"") for t in frame["text"]]
            yield pd.DataFrame({"row": np.arange(row, row + len(raw)), "doc_id": frame["doc_id"], "packed": raw})
            row += len(raw)

    return durable(small_batches(docs).select("doc_id", "text").mapInPandas(run, "row long, doc_id long, packed binary"))


def _by_run(packed: DataFrame) -> DataFrame:
    """The packed rows with their run; both uses of it share one exchange by run."""
    return packed.select(F.shiftright("row", 33).cast("int").alias("run"), "row", "doc_id", "packed")


def _count_anchors(packed: DataFrame, conf: Repeats) -> DataFrame:
    """(run, anchor, seen): one row per run and anchor; `seen` packs its times and the range of its items' 8-bit hashes.

    The hashes only tell an anchor with many different items from one that is copied as a whole.
    """

    def counted(number: int, parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        anchor, item = np.concatenate(parts, axis=1)
        order = np.argsort(anchor, kind="stable")
        anchor, item = anchor[order].view(np.int64), item[order].astype(np.int64)
        if not len(anchor):
            return
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        times = np.diff(np.append(starts, len(anchor)))
        low, high = np.minimum.reduceat(item, starts), np.maximum.reduceat(item, starts)
        for at in range(0, len(starts), 100_000):
            part = slice(at, at + 100_000)
            yield pd.DataFrame({"run": number, "anchor": anchor[starts[part]], "seen": (times[part] << 16) + (low[part] << 8) + high[part]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpress, number, parts = zstandard.ZstdDecompressor(), None, []
        for frame in frames:
            for row, blob in zip(frame["row"], frame["packed"]):
                if row >> 33 != number and parts:
                    yield from counted(number, parts)
                    parts = []
                number = row >> 33
                anchor, _, _, _, item = anchors(unpress.decompress(blob), conf)
                parts.append(np.stack([anchor, item & np.uint64(0xFF)]))
        if parts:
            yield from counted(number, parts)

    return packed.select("row", "packed").mapInPandas(run, "run int, anchor long, seen long")


def _pack(kind: bytes, entries: list[tuple[bytes, bytes, int, int, int, int]]) -> bytes:
    """A front-coded run: entries are (key, bytes before, low, high, row_id, first window); row_id -1 for several."""
    shared, rests = front_coded([e[0] for e in entries])
    numbers = np.array(
        [(s, len(e[0]) - s, len(e[1]), e[2], e[3], e[5]) for s, e in zip(shared, entries)], "<i4"
    ).tobytes()
    ids = np.array([e[4] for e in entries], "<i8").tobytes()
    before = b"".join(e[1] for e in entries)
    head = struct.pack("<III", len(entries), len(rests), len(before))
    return kind + zstandard.ZstdCompressor(level=3).compress(head + numbers + ids + rests + before)


def _unpack(blob: bytes) -> tuple[list[bytes], list[int], list[tuple]]:
    """(keys, shared prefix lengths, (bytes before, low, high, row_id, first window))."""
    data = zstandard.ZstdDecompressor().decompress(blob[1:])
    n, rest_size, _ = struct.unpack_from("<III", data)
    numbers = np.frombuffer(data, "<i4", 6 * n, 12).reshape(n, 6).tolist()
    ids = np.frombuffer(data, "<i8", n, 12 + 24 * n).tolist()
    at = 12 + 32 * n
    before_at, key = at + rest_size, b""
    keys, shared, rest = [], [], []
    for (same, size, before, low, high, first), row_id in zip(numbers, ids):
        key = key[:same] + data[at : at + size]
        at += size
        keys.append(key)
        shared.append(same)
        rest.append((data[before_at : before_at + before], low, high, row_id, first))
        before_at += before
    return keys, shared, rest


def fuse(ranges: list[tuple[int, int, int]]) -> np.ndarray:
    """Ranges (row, first, last) with those of one row that overlap or touch as one, by row and place."""
    found = np.array(ranges, np.int64).reshape(-1, 3)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    if not len(found):
        return found
    rows = np.concatenate([[0], np.cumsum(found[1:, 0] != found[:-1, 0])])
    step = int(found[:, 2].max()) + 2  # rows apart, so that the running maximum of one never reaches the next
    reach = np.maximum.accumulate(found[:, 2] + rows * step)
    new = np.concatenate([[True], found[1:, 1] + rows[1:] * step > reach[:-1] + 1])
    new |= np.concatenate([[True], rows[1:] != rows[:-1]])
    starts = np.flatnonzero(new)
    lasts = np.maximum.reduceat(found[:, 2], starts)
    return np.stack([found[starts, 0], found[starts, 1], lasts], 1)


def _make_runs(packed: DataFrame, wanted: DataFrame, ranges: int, conf: Repeats) -> DataFrame:
    """(range, kind, blob): sorted front-coded runs of the suffixes at wanted anchors.

    `wanted` has (run, anchor, hot). Its rows and the texts of a run meet in one task. Windows that repeat inside the
    run are known to repeat; they go along as plain ranges (kind `r`).
    """

    def sort_run(number: int, wanted_anchors: np.ndarray, hot_anchors: np.ndarray, texts: list[tuple]) -> Iterator[tuple]:
        unpress = zstandard.ZstdDecompressor()
        grouped: dict[tuple, list] = {}
        windows: dict[bytes, list] = {}
        codes: dict[bytes, int] = {}
        repeated: list[tuple[int, int, int]] = []
        wanted_anchors = np.sort(wanted_anchors)
        hot = set(hot_anchors.tolist())
        for row, blob in texts:
            raw = unpress.decompress(blob)
            anchor, place, first, last, _ = anchors(raw, conf)
            signed = anchor.view(np.int64)
            if not len(wanted_anchors) or not len(signed):
                continue
            grams = None
            spot = np.minimum(np.searchsorted(wanted_anchors, signed), len(wanted_anchors) - 1)
            for i in np.flatnonzero(wanted_anchors[spot] == signed).tolist():
                name, a, b, p = int(signed[i]), int(first[i]), int(last[i]), int(place[i])
                if name in hot:
                    grams = gram_hashes(raw, conf)[1] if grams is None else grams
                    for w, code in zip(range(a, b + 1), (window_codes(grams, a, b, conf) % np.uint64(ranges)).tolist()):
                        window = raw[w : w + conf.length]
                        windows.setdefault(window, []).append((row, w))
                        codes[window] = code
                else:
                    key = (name, raw[p : b + conf.length], raw[a:p], p - b, p - a)
                    grouped.setdefault(key, []).append((row, a))
        dealt: dict[tuple[int, bytes], list] = {}
        for (name, suffix, before, low, high), spots in grouped.items():
            if len(spots) > 1:
                repeated += [(row_id, a, a + high - low) for row_id, a in spots]
            row_id, a = spots[0] if len(spots) == 1 else (-1, 0)
            dealt.setdefault((name % ranges, b"s"), []).append((suffix, before, low, high, row_id, a, name))
        for window, spots in windows.items():
            if len(spots) > 1:
                repeated += [(row_id, w, w) for row_id, w in spots]
            row_id, w = spots[0] if len(spots) == 1 else (-1, 0)
            dealt.setdefault((codes[window], b"w"), []).append((window, b"", 0, 0, row_id, w, 0))
        for (target, kind), entries in dealt.items():
            entries.sort(key=lambda e: (e[0], e[1], e[2], e[3]))
            yield target, kind.decode(), _pack(kind, entries)
        fused = fuse(repeated)
        for at in range(0, len(fused), 100_000):
            part = fused[at : at + 100_000].astype("<i8").tobytes()
            yield (number + at) % ranges, "r", zstandard.ZstdCompressor(level=3).compress(part)

    def run(key: tuple, flags: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        names = flags["anchor"].to_numpy(dtype=np.int64)
        hot = names[flags["hot"].to_numpy(dtype=bool)]
        rows = sort_run(int(key[0]), names, hot, list(zip(texts["row"].tolist(), texts["packed"])))
        return pd.DataFrame(rows, columns=["range", "kind", "blob"])

    met = wanted.groupBy("run").cogroup(_by_run(packed).groupBy("run"))
    return met.applyInPandas(run, "range long, kind string, blob binary")


def _merge_ranges(runs: DataFrame, conf: Repeats) -> DataFrame:
    """(row_id, first, last): ranges of windows that start elsewhere too."""

    def suffixes(blobs: list[bytes]) -> Iterator[tuple[int, int, int]]:
        parts = [_unpack(b) for b in blobs]
        group: list[tuple] = []
        right: list[int] = []

        def done() -> Iterator[tuple[int, int, int]]:
            # equal items of several runs are one
            merged: list[tuple] = []
            owners: list[list[tuple]] = []
            steps: list[int] = []
            index: dict[tuple, int] = {}
            reach = conf.length
            for (suffix, before, low, high, row_id, first), same in zip(group, right):
                reach = min(reach, same)
                key = (suffix, before, low, high)
                if key in index:
                    owners[index[key]].append((row_id, first))
                    continue
                index[key] = len(merged)
                merged.append(key)
                owners.append([(row_id, first)])
                steps.append(reach)
                reach = conf.length
            ranges = equal_windows(merged, steps, conf.length) if len(merged) > 1 else [[]]
            for (_, _, low, high), spots, found in zip(merged, owners, ranges):
                if len(spots) > 1:
                    found = [(low, high)]
                for row_id, first in spots:
                    if row_id >= 0:
                        for least, most in found:
                            yield row_id, first + high - most, first + high - least

        for run, i, same in merge_runs([(keys, shared) for keys, shared, _ in parts]):
            key, rest = parts[run][0][i], parts[run][2][i]
            if group and same < conf.gram:
                yield from done()
                group, right = [], []
            group.append((key, *rest))
            right.append(same)
        if group:
            yield from done()

    def windows(blobs: list[bytes]) -> Iterator[tuple[int, int, int]]:
        parts = [_unpack(b) for b in blobs]
        before = None
        for run, i, same in merge_runs([(keys, shared) for keys, shared, _ in parts]):
            spot = parts[run][2][i][3:]
            if before is not None and same >= conf.length:
                for row_id, first in (before, spot) if before else (spot,):
                    if row_id >= 0:
                        yield row_id, first, first
                before = ()
            else:
                before = spot

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, blobs = None, []

        def done() -> pd.DataFrame:
            found = fuse(list((suffixes if current[1] == "s" else windows)(blobs)))
            return pd.DataFrame(found, columns=["row_id", "first", "last"])

        for frame in frames:
            for target, kind, blob in zip(frame["range"], frame["kind"], frame["blob"]):
                if kind == "r":
                    part = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8").reshape(-1, 3)
                    yield pd.DataFrame(part, columns=["row_id", "first", "last"])
                    continue
                if current is not None and current != (target, kind):
                    yield done()
                    blobs = []
                current = (target, kind)
                blobs.append(blob)
        if current is not None:
            yield done()

    dealt = runs.repartition("range").sortWithinPartitions("range", "kind")
    return dealt.mapInPandas(run, "row_id long, first long, last long")


def repeated_windows(packed: DataFrame, conf: Repeats = Repeats()) -> DataFrame:
    """(row, first, last): ranges of start positions whose string of `length` bytes starts elsewhere too."""
    over = Window.partitionBy("anchor")  # a row per run at most
    times, low, high = F.shiftright("seen", 16), F.col("seen").bitwiseAND(0xFF00), F.col("seen").bitwiseAND(0xFF)
    wanted = durable(
        _count_anchors(packed, conf)
        .withColumns({"all": F.sum(times).over(over), "lo": F.min(low).over(over), "hi": F.max(high).over(over)})
        .where(F.col("all") > 1)
        .select("run", "anchor", ((F.col("all") >= conf.hot) & (F.shiftright("lo", 8) < F.col("hi"))).alias("hot"), times.alias("times"))
    )
    items = wanted.agg(F.sum("times")).first()[0] or 0
    least = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, items // conf.range_items)
    found = _merge_ranges(_make_runs(packed, wanted.drop("times"), ranges, conf), conf)
    return found.withColumnRenamed("row_id", "row")


def cut(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, maximal removed runs) for sorted ranges of window starts."""
    kept, at, removed, runs = [], 0, 0, 0
    for first, last in spans:
        end = last + length
        if end <= at and runs:
            continue
        if first > at or not runs:
            kept.append(raw[at:first])
            runs += 1
            removed += end - first
        else:
            removed += end - at
        at = end
    return b"".join([*kept, raw[at:]]), removed, runs


def remove_repeats(docs: DataFrame, conf: Repeats = Repeats()) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): the bytes that stay of every document."""
    packed = _packed(docs)
    spans = repeated_windows(packed, conf).select(F.shiftright("row", 33).cast("int").alias("run"), "row", "first", "last")

    def run(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        unpress = zstandard.ZstdDecompressor()
        found = found.sort_values(["row", "first", "last"])
        owners = found["row"].to_numpy()
        starts = np.searchsorted(owners, texts["row"].to_numpy(), side="left").tolist()
        ends = np.searchsorted(owners, texts["row"].to_numpy(), side="right").tolist()
        first, last = found["first"].tolist(), found["last"].tolist()
        rows = []
        for doc_id, blob, a, b in zip(texts["doc_id"], texts["packed"], starts, ends):
            raw = unpress.decompress(blob)
            kept, removed, runs = cut(raw, list(zip(first[a:b], last[a:b])), conf.length)
            rows.append((doc_id, kept, len(raw), removed, runs))
        return pd.DataFrame(rows, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    met = _by_run(packed).groupBy("run").cogroup(spans.groupBy("run"))
    return met.applyInPandas(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
