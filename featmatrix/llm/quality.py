"""Quality rules, line first: bad lines go, then documents that lost too much of their text.

Each line with a word is judged by itself, by the first rule that it breaks:

* navigation: separators (`|`, `>`, `»`, `·`, ...) make up a fifth of its words or more, or it is short and
  consists of menu words;
* boilerplate: it holds a phrase of licences, cookie notes, copyright notes or script warnings, or half of its
  words or more repeat their neighbour;
* punctuation: half of its words or more end in a run of symbols or repeated marks, or more than half of its
  bytes are ASCII marks, or (only with `require_terminal`) no closing mark ends it.

Failing lines are removed. A document is rejected if it fails the base checks or lost more than `max_lost` of its
word characters.

Null text counts as empty: no words, so the base check fails. An empty table gives an empty table. Rows are judged
one by one, so ties and repeated rows have no effect on each other; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from featmatrix.llm.common import map_rows

SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset(b"| > \xc2\xbb \xe2\x80\xba \xc2\xb7 \xe2\x80\xa2 / :: || >> -".split())
MENU = frozenset(b"home menu login logout search next previous prev back top share print sitemap contact help about".split())
BOILERPLATE = (
    b"licensed under", b"released under the", b"all rights reserved", b"\xc2\xa9", b"copyright", b"cookie",
    b"privacy policy", b"terms of use", b"terms of service", b"enable javascript", b"our newsletter", b"click here",
)
SYMBOL_END = re.compile(rb"(?:[#*$%&|<>~^=_]+|[!?]{2,}|[.]{4,})[.,;:!?]*$")
SYMBOL_BYTES = b"#*$%&|<>~^=_!?."
NOT_LETTERS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CLOSING = re.compile(rb"(?:[.!?:;]|\xe2\x80\xa6)(?:[\"')\]]|\xe2\x80[\x99\x9d]|\xc2\xbb)*$")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_punctuation long, n_navigation long, n_boilerplate long, "
    "lost_share double, cleaned string"
)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_lost: float = 0.5
    symbol_words: float = 0.5
    separator_words: float = 0.2
    require_terminal: bool = False


def broken_rule(line: bytes, words: list[bytes], rules: QualityRules) -> str | None:
    """The first rule that the line (UTF-8) breaks, or None."""
    n = len(words)
    odd = len(line) - len(line.translate(None, NOT_LETTERS))  # ASCII marks and symbols
    if odd >= rules.separator_words * n or not line.isascii():
        separators = sum(w in SEPARATORS for w in words)
        if separators >= 2 and separators >= rules.separator_words * n:
            return "navigation"
    low = line.lower()
    if n <= 8 and sum(w.strip(b".,:|") in MENU for w in low.split()) * 2 >= n:
        return "navigation"
    if any(phrase in low for phrase in BOILERPLATE):
        return "boilerplate"
    if n >= 4 and sum(map(eq, words, words[1:])) * 2 >= n:
        return "boilerplate"
    if odd >= rules.symbol_words * n and sum(1 for w in words if SYMBOL_END.search(w)) >= rules.symbol_words * n:
        return "punctuation"
    if odd * 2 > sum(map(len, words)):
        return "punctuation"
    if rules.require_terminal and not CLOSING.search(line.rstrip()):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], window: int) -> int:
    """Words in windows of that many words which occur at least twice in the text.

    Windows get exact integer names by doubling: names of 1, 2, 4, ... words, the last step overlapping.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    name = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        left, right = name[: len(name) - step], name[step:]
        pair = left * (int(name.max()) + 1) + right
        values, name, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
        length += step
    starts = counts[name] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    cover[: len(starts)] += starts
    cover[window : window + len(starts)] -= starts
    return int((np.cumsum(cover)[: len(words)] > 0).sum())


def judge(text: str | None, rules: QualityRules) -> tuple:
    """Everything but the doc_id of a result row."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes are split at blanks and tab to carriage return only, as words are
    word_chars = len(text) - sum(map(raw.count, b" \t\n\v\f\r"))
    seen: set[bytes] = set()
    duplicates, lines, kept_lines, lost = 0, 0, [], 0
    broken = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            kept_lines.append(line)
            continue
        lines += 1
        duplicates += line in seen
        seen.add(line)
        rule = broken_rule(line, own, rules)
        if rule is None:
            kept_lines.append(line)
        else:
            broken[rule] += 1
            lost += sum(len(w.decode("utf-8")) for w in own)
    repeats = repeated_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    share = lost / word_chars if word_chars else 0.0
    return (
        len(words), word_chars, sum(map(text.count, SYMBOLS)), duplicates, repeats, failed,
        not failed and share <= rules.max_lost, lines, broken["punctuation"], broken["navigation"],
        broken["boilerplate"], share, b"\n".join(kept_lines).decode("utf-8"),
    )


def line_first_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: base counts, verdict, lines lost by rule, and the cleaned text."""

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield (doc_id, *judge(text, rules))

    return map_rows(docs, ["doc_id", "text"], SCHEMA, rows_of, batch=512)
