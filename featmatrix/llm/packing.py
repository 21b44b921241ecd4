"""Packing of examples into sequences by dot-product vector bin packing.

An example has three demands: tokens, one segment, and tokens that bear loss. A sequence has a limit on each. While
a sequence is open, the example that fits and has the largest dot product of its demand with the room that is left,
both as shares of the limits and weighted by the total demand of each kind, goes in next; when none fits, the
sequence is closed. Texts longer than a sequence are cut into whole sequences plus a rest, so only rests compete; one with
a prompt, whose tokens bear no loss, is cut where either its tokens or its loss-bearing tokens reach their limit.

Every partition packs its own examples in pools of bounded size: no shuffle and no group that grows with the data.
A pool hands the examples of its last, half-filled sequences on to the next pool, so only the end of a partition
can leave a sequence short. Sequence ids join the partition number and a running number.

Null text counts as empty (its only id is the end). Ties go to the longer, then the earlier example. An empty table
gives an empty table; repeated rows are packed as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from featmatrix.llm.common import map_rows

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long, segment long"
)


#: Characters of text that are encoded together.
TOGETHER = 800_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048
    pool: int = 2048
    window: int = 512


def _plain_pieces() -> re.Pattern:
    """The tokenizer file's pattern for text of a plain range of characters, as a pattern of the faster library."""
    plain = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x180)) if c != 0x131]
    letters = "".join(c for c in plain if regex.match(r"\p{L}", c))
    numbers = "".join(c for c in plain if regex.match(r"\p{N}", c))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


class WordBpe:
    """Ids of a lower-casing word tokenizer, with a memory of pieces.

    Text of a plain range of characters is split here as the tokenizer file does and known pieces are looked up; new
    pieces of several texts are encoded together by the library. Any other text is encoded by the library as a whole.
    The memory has two generations: when the younger is full the older is dropped, so pieces in use stay known.
    """

    CACHE = 240_000
    SPECIAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-įĲ-ſ]|<\|")
    PIECES = _plain_pieces()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def _learn(self, new: set[str]) -> None:
        """Look pieces up in the older generation; encode the rest in one call and cut the ids at word ends."""
        known, older = self.known, self.older
        for piece in new & older.keys():
            known[piece] = older[piece]
        rest = [p for p in new if p not in known]
        if not rest:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(rest)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(rest):
            raise ValueError("pieces must end with a word end")
        raw, start = ids.tobytes(), 0
        for piece, cut in zip(rest, (cuts * 4).tolist()):
            known[piece] = raw[start:cut]
            start = cut

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.CACHE:
            self.older, self.known = self.known, {}
        split: list[list[str] | None] = []
        for text in texts:
            if self.SPECIAL.search(text):
                split.append(None)
                continue
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            split.append(self.PIECES.findall(text.lower()))
        new = set().union(*(parts for parts in split if parts)).difference(self.known)
        if new:
            self._learn(new)
        ids = self.known.__getitem__
        return [
            np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if parts is None else b"".join(map(ids, parts))
            for text, parts in zip(texts, split)
        ]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def pack_vectors(demands: np.ndarray, limits: np.ndarray, window: int) -> list[list[int]]:
    """Bins of indices by the dot-product rule.

    `window`: of equal-looking candidates in order of size, how many are scored for each step; an example outside
    the window enters it as others leave, so each one is packed.
    """
    left = np.argsort(-demands[:, 0], kind="stable")
    share = demands / limits
    weights = share.sum(0) / max(share.sum(), 1e-12)
    weighted = share * weights
    bins: list[list[int]] = []
    while len(left):
        room = limits.astype(np.int64).copy()
        one: list[int] = []
        while len(left):
            # sorted by tokens: the first that can fit
            at = int(np.searchsorted(-demands[left, 0], -room[0], side="left"))
            part = left[at : at + window]
            fits = np.flatnonzero((demands[part] <= room).all(1))
            if not len(fits):
                rest = left[at + window :]
                fits = np.flatnonzero((demands[rest] <= room).all(1))
                if not len(fits):
                    break
                part, at = rest, at + window
            best = int(fits[np.argmax(weighted[part[fits]] @ (room / limits))])
            pick = int(part[best])
            one.append(pick)
            room -= demands[pick]
            left = np.delete(left, at + best)
        if not one:
            raise ValueError("an example exceeds the limits")
        bins.append(one)
    return bins


def _pieces(doc_id: int, ids: bytes, limits: Limits, prompt: int = 0) -> list[tuple]:
    """(doc_id, start, length, crc, doc tokens, loss tokens) of whole sequences and the rest; the first `prompt` ids bear no loss."""
    total, at, out = len(ids) // 4, 0, []
    while at < total:
        # as long as the tokens allow, or as the loss-bearing ones among them do
        end = min(total, at + limits.tokens, max(at, prompt) + limits.loss_tokens)
        out.append((doc_id, at, end - at, zlib.crc32(ids[4 * at : 4 * end]), total, max(0, end - max(at, prompt))))
        at = end
    return out


def pack_examples(
    docs: DataFrame, path: str, end_id: int, limits: Limits = Limits(), prompt: str | None = None
) -> DataFrame:
    """Tokenize every whole text, add the end id, cut and pack. One row per piece.

    `prompt` names a column of texts that come before the text of a row and bear no loss (instructions, earlier turns);
    null is an empty one. The rest of an example and its end bear loss. Without it every token does, as plain text
    has no prompt.
    """

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        tokenizer = _tokenizer(path)
        context = TaskContext.get()
        end = end_id.to_bytes(4, "little")
        number = (context.partitionId() if context else 0) << 33
        bound = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)

        def emit(pieces: list[tuple], bins: list[list[int]]) -> Iterator[tuple]:
            nonlocal number
            for one in bins:
                offset = 0
                for segment, i in enumerate(one):
                    yield (*pieces[i][:5], number, offset, pieces[i][5], segment)
                    offset += pieces[i][2]
                number += 1

        def pack(pieces: list[tuple]) -> list[list[int]]:
            lengths, loss = (np.array([p[i] for p in pieces], np.int64) for i in (2, 5))
            return pack_vectors(np.stack([lengths, np.ones_like(lengths), loss], 1), bound, limits.window)

        def encoded() -> Iterator[tuple]:
            """Documents with their ids; a few texts are encoded together, a long one by itself."""
            held: list[tuple] = []
            size = 0

            def done() -> Iterator[tuple]:
                ids = tokenizer.encode_all([t or "" for row in held for t in row[1:]])
                parts = len(held[0]) - 1
                for i, row in enumerate(held):
                    own = ids[i * parts : (i + 1) * parts]  # the text, and its prompt if there is one
                    yield row[0], b"".join(reversed(own)) + end, len(b"".join(own[1:])) // 4

            for row in rows:
                held.append(row)
                size += sum(len(t or "") for t in row[1:])
                if size >= TOGETHER:
                    yield from done()
                    held, size = [], 0
            if held:
                yield from done()

        pool: list[tuple] = []
        for doc_id, ids, before in encoded():
            for piece in _pieces(doc_id, ids, limits, before):
                if piece[2] == limits.tokens:
                    yield from emit([piece], [[0]])
                else:
                    pool.append(piece)
            if len(pool) >= limits.pool:
                bins = sorted(pack(pool), key=lambda b: -sum(pool[i][2] for i in b))
                back: list[int] = []  # the emptiest sequences are opened again, up to a quarter of the pool
                while bins and len(back) + len(bins[-1]) <= limits.pool // 4:
                    if sum(pool[i][2] for i in bins[-1]) >= 0.98 * limits.tokens:
                        break
                    back += bins.pop()
                yield from emit(pool, bins)
                pool = [pool[i] for i in sorted(back)]
        if pool:
            yield from emit(pool, pack(pool))
        tokenizer.forget()  # the worker lives on and shares its executor's memory with other stages

    columns = ["doc_id", "text"] if prompt is None else ["doc_id", "text", prompt]
    return map_rows(docs, columns, SCHEMA, rows_of, batch=4096)


def padding(sequences: pd.Series) -> float:
    """Share of padding when a sequence is padded to 2048 unless its length is a power of two."""
    padded = [n if n & (n - 1) == 0 else 2048 for n in sequences]
    return 1 - sequences.sum() / max(sum(padded), 1)
