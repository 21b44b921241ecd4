"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The field labels every word that
holds a digit or an at sign. Neighbouring such words are linked in a chain; words that repeat, or that share their
number of digits and one half of them, are linked to their last and to their first like across any distance. Beliefs
come from damped loopy message passing until no message changes by more than `tolerance`; the turns it may take follow
the number of marked words, so every word can be reached. So a word that is plainly a phone number pulls a bare
repetition of it along. Words believed with at least `sure` become further spans; spans of the patterns always stay.

Training is piecewise: word potentials by weighted logistic regression, link potentials from label pairs, both from
pattern labels of a bounded sample of documents (`sample` of them, drawn by a hash of doc_id), counted in Spark.
A pattern says nothing about words that it ran over together with a neighbour (a match with too many digits, such as a
phone number right before an IP address), so these are left unlabelled and the field has to label them from the rest.
Each labelled word is learned twice, once with the features of its neighbours hidden. Added words of a phone number
that follow each other are one span.

Null text counts as empty (no spans). Spans that start together are ordered by kind. Repeated rows are independent,
an empty table gives an empty table, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmatrix.llm.common import WORD, map_rows

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
FEATURES = 72
#: Features that come from the words before and after.
NEIGHBOURS = frozenset([48, 49, 50, 51, *range(56, 72)])


@dataclass(frozen=True)
class Field:
    words: np.ndarray  # FEATURES x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the whole run before the at sign, as far as no match has taken it."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            taken = domain.end()
        at = text.find("@", max(at + 1, taken))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    if not MARKED.search(text):
        return []
    spans = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def overrun(text: str) -> list[tuple[int, int]]:
    """Matches of the phone and card patterns that hold more digits than such a number has, sorted."""
    found = [(m.start(), m.end()) for m in PHONE.finditer(text) if len(NOT_DIGIT.sub("", m[0])) > 15] if "+" in text else []
    found += [(m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() > 19 and len(NOT_DIGIT.sub("", m[0])) > 19]
    return sorted(found)


def _features(word: str, before: str, after: str) -> list[int]:
    """Active features: shapes of the word and of its neighbours."""
    digits = sum("0" <= c <= "9" for c in word)
    letters = sum(map(str.isalpha, word))
    on = [0, 1 + min(digits, 20), 24 + min(word.count("."), 4), 30 + min(word.count("-"), 3), 36 + min(letters, 5)]
    on += [43] * ("@" in word) + [44] * word.startswith("+") + [45] * ("(" in word) + [46] * (":" in word)
    on += [47] * word.isdigit() + [48] * before.startswith("+") + [49] * bool(MARKED.search(before))
    on += [50] * bool(MARKED.search(after)) + [51] * ("=" in before) + [52] * ('"' in word)
    if 14 <= digits <= 19:
        on.append(53 if _luhn(NOT_DIGIT.sub("", word)) else 54)
    return [*on, 56 + zlib.crc32(before.lower().encode()) % 16]


def _graph(text: str) -> tuple[list[tuple[int, int]], list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Marked words, their features, chain links and skip links."""
    words, feats, chain, skip = [], [], [], []
    last: dict[tuple, int] = {}
    first: dict[tuple, int] = {}
    spots = [(m.start(), m.end()) for m in WORD.finditer(text)]
    previous = -9
    for i, (start, end) in enumerate(spots):
        word = text[start:end]
        if not MARKED.search(word):
            continue
        n = len(words)
        words.append((start, end))
        before = text[slice(*spots[i - 1])] if i else ""
        after = text[slice(*spots[i + 1])] if i + 1 < len(spots) else ""
        feats.append(_features(word, before, after))
        if i - previous <= 3:
            chain.append((n - 1, n))
        previous = i
        digits = NOT_DIGIT.sub("", word)
        keys = [("w", word.strip(".,;:()\"'").lower())]
        if len(digits) >= 6:
            half = len(digits) // 2
            keys += [(len(digits), "a", digits[:half]), (len(digits), "b", digits[half:]), ("c", digits[-7:])]
        for other in sorted({at[k] for at in (last, first) for k in keys if k in at}):
            skip.append((other, n))
        last.update(dict.fromkeys(keys, n))
        for k in keys:
            first.setdefault(k, n)
    return words, feats, chain, skip


def _labels(words: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """0 or 1 + kind of the first span that overlaps each word; both lists are sorted."""
    out, at = [], 0
    for start, end in words:
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        hit = next((k for s, k, e in spans[at : at + 4] if s < end and e > start), None)
        out.append(0 if hit is None else 1 + hit)
    return out


def _training_labels(text: str, words: list[tuple[int, int]]) -> list[int | None]:
    """Labels of the patterns; None for words in a match that ran over."""
    mine: list[int | None] = list(_labels(words, base_spans(text)))
    unclear = _labels(words, [(start, 0, end) for start, end in overrun(text)])
    return [None if lost and not label else label for label, lost in zip(mine, unclear)]


def fit(docs: DataFrame, sample: int = 30_000, steps: int = 300) -> Field:
    """Fit on pattern labels of about `sample` documents. Only counts of feature and label combinations are collected."""
    labels = len(KINDS) + 1
    total = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) / 1_000_000
    drawn = docs.where(draw < sample / max(total, 1)).where(F.col("text").rlike("[0-9@]"))

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in rows:
            words, feats, chain, skip = _graph(text)
            mine = _training_labels(text, words)
            for on, label in zip(feats, mine):
                if label is not None:
                    yield "word", ",".join(map(str, sorted(on))), label
                    yield "word", ",".join(str(x) for x in sorted(on) if x not in NEIGHBOURS), label
            for name, links in (("chain", chain), ("skip", skip)):
                for a, b in links:
                    if mine[a] is not None and mine[b] is not None:
                        yield name, str(mine[a]), mine[b]

    counted = (
        map_rows(drawn, ["text"], "part string, key string, label int", rows_of)
        .groupBy("part", "key", "label")
        .count()
        .collect()
    )  # finite: shapes times labels
    tables = {name: np.full((labels, labels), 0.5) for name in ("chain", "skip")}
    combos: dict[str, np.ndarray] = {}
    for row in sorted(counted):
        if row["part"] == "word":
            combos.setdefault(row["key"], np.zeros(labels))[row["label"]] += row["count"]
        else:
            tables[row["part"]][int(row["key"]), row["label"]] += row["count"]
            tables[row["part"]][row["label"], int(row["key"])] += row["count"]
    weights = np.zeros((FEATURES, labels))
    if combos:
        shape = np.zeros((len(combos), FEATURES))
        for i, key in enumerate(combos):
            shape[i, [int(x) for x in key.split(",")]] = 1
        seen = np.array(list(combos.values()))
        squares = np.full_like(weights, 1e-6)
        for _ in range(steps):
            scores = shape @ weights
            chance = np.exp(scores - scores.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            slope = shape.T @ (seen - chance * seen.sum(1, keepdims=True)) / seen.sum() - 1e-5 * weights
            squares += slope * slope
            weights += 0.5 * slope / np.sqrt(squares)

    def link(table: np.ndarray) -> np.ndarray:
        share = table / table.sum()
        return np.clip(np.log(share / np.outer(share.sum(1), share.sum(0))), -3, 3)

    return Field(weights, link(tables["chain"]), link(tables["skip"]))


def beliefs(feats: list[list[int]], chain: list[tuple[int, int]], skip: list[tuple[int, int]], field: Field, tolerance: float = 1e-4) -> np.ndarray:
    """Label beliefs by damped loopy sum-product, run until it settles; exact on a chain without skip links.

    Messages cross a link per turn, so the most turns grow with the words. From turn 100 on steps get shorter, which
    settles loops that swing.
    """
    unary = np.array([field.words[on].sum(0) for on in feats])
    if chain or skip:
        ends = np.array(chain + skip)
        tables = np.concatenate([np.repeat(field.chain[None], len(chain), 0), np.repeat(field.skip[None], len(skip), 0)])
        source = np.concatenate([ends[:, 0], ends[:, 1]])
        target = np.concatenate([ends[:, 1], ends[:, 0]])
        pair = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(ends)) + len(ends), np.arange(len(ends))])
        messages = np.zeros((len(source), unary.shape[1]))
        for turn in range(200 + 4 * len(feats)):
            gathered = unary.copy()
            np.add.at(gathered, target, messages)
            outward = (gathered[source] - messages[back])[:, :, None] + pair
            top = outward.max(1, keepdims=True)
            fresh = np.log(np.exp(outward - top).sum(1)) + top[:, 0]
            fresh -= fresh.max(1, keepdims=True)
            moved = np.abs(fresh - messages).max()
            step = 0.7 * min(1, 100 / (turn + 1))
            messages += step * (fresh - messages)
            if moved <= tolerance:
                break
        unary = unary.copy()
        np.add.at(unary, target, messages)
    chance = np.exp(unary - unary.max(1, keepdims=True))
    return chance / chance.sum(1, keepdims=True)


def all_spans(text: str, field: Field, sure: float = 0.9) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(pattern spans, added spans), each as (start, kind, end)."""
    base = base_spans(text)
    words, feats, chain, skip = _graph(text) if MARKED.search(text) else ([], [], [], [])
    if not words:
        return base, []
    chance = beliefs(feats, chain, skip, field)
    covered = _labels(words, base)
    added = []
    for (start, end), belief, label in zip(words, chance, covered):
        best = int(np.argmax(belief))
        if label or not best or belief[best] < sure:
            continue
        word = text[start:end]
        cut = word.strip(".,;:!?\"'()[]<>#*$%&|")
        if cut:
            at = start + word.index(cut)
            if "(" + cut + ")" in word:  # the brackets of an area code belong to the number
                at, cut = at - 1, "(" + cut + ")"
            before = added[-1] if added else None
            if before and best == 4 and before[1] == 3 and not cut.startswith("+") and not text[before[2] : at].strip():
                added[-1] = (before[0], 3, at + len(cut))
            else:
                added.append((at, best - 1, at + len(cut)))
    return base, added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, field: Field, sure: float = 0.9) -> DataFrame:
    """One row per document: counts of pattern spans, their digest, and all spans."""

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            base, added = all_spans(text or "", field, sure)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            yield (doc_id, *counts, digest, _joined(base + added), len(added))

    return map_rows(docs, ["doc_id", "text"], SCHEMA, rows_of)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of its first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field, sure: float = 0.9) -> DataFrame:
    """The documents with their personal data masked; null texts stay null."""

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, sum(all_spans(t, field, sure), [])) if isinstance(t, str) else None for t in texts], dtype=object)

    return docs.withColumn("text", cover("text"))
