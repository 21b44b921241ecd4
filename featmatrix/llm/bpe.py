"""Byte-level BPE by longest matches and backtracking, with exact merge results.

Bytes are mapped to Latin-1 so that one automaton finds every vocabulary entry inside a pretoken in one pass. From
the left, the longest entry is taken that is compatible with its predecessor: two neighbours are compatible if the
merges would keep them apart. Where none fits, the last entry is given up and a shorter one tried; a position found
hopeless is never tried again, so the work is linear. Compatibility of two entries is memoised.

Null text is encoded as empty text (no ids). Ties cannot occur: exactly one sequence passes the compatibility test.
Rows are independent, an empty table gives an empty table, and further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from featmatrix.llm.common import map_rows

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_equal boolean"

#: The split pattern whose pretokens hold a blank at their start only, unless white space stands in a row.
BLANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A blank beside other white space or at an end of the text.
BLANKS = re.compile(r" \s|\s |^ | \Z")

#: Pretokens whose result a worker remembers at most; then it starts anew.
CACHE = 600_000


class ByteBpe:
    """Encoder and decoder for one rank file (base64 entry and rank per line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.entry = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.halves = {rank: self._split(token, rank) for token, rank in ranks.items()}
        self.merged = {halves: rank for rank, halves in self.halves.items() if halves}
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.splits_at_blanks = pattern == BLANK_PATTERN

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two entries whose merge makes the token, None for single bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                (r, i)
                for i in range(len(parts) - 1)
                if (r := self.ranks.get(parts[i] + parts[i + 1], rank)) < rank
            )
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges, applied to both entries' bytes, end with exactly these two.

        Undo the later merge of the two at their border, step by step: if the border parts of any moment merge with
        a rank below the one undone last, that merge would have come first and joined the two.
        """
        key = left << 32 | right
        known = self.apart.get(key)
        if known is not None:
            return known
        limit = 1 << 60
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                result = False
                break
            one, two = self.halves[left], self.halves[right]
            if one is None and two is None:
                result = True
                break
            # at equal age the left merge happens first, so it is undone last
            if two is None or (one is not None and left > right):
                limit, left = left, one[1]
            else:
                limit, right = right + 1, two[0]
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        self.apart[key] = result
        return result

    def encode_pretoken(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        latin, apart = piece.decode("latin-1"), self.apart
        # taking the longest entry each time is already the answer if all neighbours are compatible
        greedy = [rank for _, (_, rank) in self.automaton.iter_long(latin)]
        for left, right in zip(greedy, greedy[1:]):
            if not (apart.get(left << 32 | right) or self.compatible(left, right)):
                break
        else:
            return tuple(greedy)
        size = len(piece)
        fits: list[list[tuple[int, int]]] = [[] for _ in range(size)]  # by start, from short to long
        for last, entry in self.automaton.iter(latin):
            fits[last - entry[0] + 1].append(entry)
        hopeless = bytearray(size + 1)
        chosen: list[tuple[int, int, int]] = []  # rank, length, how many shorter entries are left
        at, left = 0, len(fits[0])
        while at < size:
            options, before = fits[at], chosen[-1][0] if chosen else None
            while left:
                left -= 1
                length, rank = options[left]
                if not hopeless[at + length] and (before is None or self.compatible(before, rank)):
                    chosen.append((rank, length, left))
                    at += length
                    left = len(fits[at]) if at < size else 0
                    break
            else:
                hopeless[at] = 1
                _, length, left = chosen.pop()
                at -= length
        return tuple(rank for rank, _, _ in chosen)

    def _encode_part(self, part: str) -> bytes:
        known, out = self.known, []
        for piece in self.pattern.findall(part):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.encode_pretoken(piece.encode("utf-8")), "<u4").tobytes()
                if len(known) >= CACHE:
                    known.clear()
                known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text.

        A single blank before another character always starts a pretoken, so a text whose blanks all stand alone
        is looked up between blanks; any other text is split as a whole.
        """
        if not self.splits_at_blanks or BLANKS.search(text):
            return np.frombuffer(self._encode_part(text), "<u4")
        first, *rest = text.split(" ")
        parts = self.parts
        if len(parts) > CACHE:
            parts.clear()
        for part in set(rest).difference(parts):
            parts[part] = self._encode_part(" " + part)
        return np.frombuffer(self._encode_part(first) + b"".join(map(parts.__getitem__, rest)), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBpe:
    return ByteBpe.load(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe = _loaded(path, pattern)
        for doc_id, text in rows:
            yield doc_id, bpe.encode(text or "").tolist()

    return map_rows(docs, ["doc_id", "text"], "doc_id long, ids array<int>", rows_of, batch=256)


def round_trip_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both beside the number of ids."""

    def rows_of(rows: Iterator[tuple]) -> Iterator[tuple]:
        bpe = _loaded(path, pattern)
        for doc_id, text in rows:
            text = text or ""
            ids = bpe.encode(text).tolist()
            decoded = bpe.decode(ids)
            yield (
                doc_id,
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(decoded).hexdigest(),
                decoded == text.encode("utf-8"),
            )

    return map_rows(docs, ["doc_id", "text"], SCHEMA, rows_of)
