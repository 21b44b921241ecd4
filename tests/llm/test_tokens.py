from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from featmatrix.llm.bpe import ByteBpe, encode_documents, round_trip_digest
from featmatrix.llm.packing import Limits, WordBpe, pack_examples, pack_vectors, padding

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a  b ", "a" * 5000, "é" * 700, "x\n\n y\t z", "It's we'LL <|endoftext|>", "İ ΟΔΟΣ ﬁ ½", "日本語 text 12345", "a\x1cb\x85c\xa0d", "the the the"]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe.load(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_ids_equal_the_merges(bpe, plain):
    rnd = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("aehint ") for _ in range(80)) for _ in range(500)]
    for text in texts:
        ids = bpe.encode(text).tolist()
        assert ids == plain.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_byte_ids_of_any_text(bpe, plain, text):
    assert bpe.encode(text).tolist() == plain.encode_ordinary(text)


def test_round_trip_over_a_table(spark, documents, plain):
    rows = list(enumerate(ODD)) + [(3, ODD[3])]
    got = round_trip_digest(documents(rows), RANKS, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = plain.encode_ordinary(ODD[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.decoded_equal
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    one = encode_documents(documents([(1, "to be")]), RANKS, P.PATTERN).first()
    assert one.ids == plain.encode_ordinary("to be")
    assert round_trip_digest(documents(rows).limit(0), RANKS, P.PATTERN).count() == 0


def test_word_ids_equal_the_library():
    mine, library = WordBpe(WORDS), Tokenizer.from_file(WORDS)
    mine.CACHE = 3  # starts anew again and again
    for text in [t or "" for t in ODD] + ["Don't STOP, 42nd street!"] * 3:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_id_is_packed_once(spark, documents):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma,"]) for _ in range(rnd.choice([0, 3, 40, 700, 9000])))) for i in range(60)]
    rows += [(60, None), (61, "")]
    library = Tokenizer.from_file(WORDS)
    limits = Limits(tokens=512, segments=5, loss_tokens=512, pool=20, window=8)
    got = pack_examples(documents(rows), WORDS, 1, limits).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in rows}
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert len(own) <= 5 and sum(r.length for r in own) <= 512 and sum(r.loss_tokens for r in own) <= 512
    assert pack_examples(documents(rows).limit(0), WORDS, 1).count() == 0


def test_loss_bearing_tokens_limit_a_sequence(spark):
    """Instruction data: prompts bear no loss, and sequences close when their answers reach the third limit."""
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(i, say(rnd.randint(0, 60)), say(rnd.choice([0, 5, 40, 300]))) for i in range(400)]
    rows += [(900, say(10), None), (901, None, say(900)), (902, say(700), say(3)), (903, "", ""), (904, say(2), say(1500))]
    docs = spark.createDataFrame([(i, t, p, 1) for i, t, p in rows], "doc_id long, text string, asked string, loss_tokens int").repartition(2)
    limits = Limits(tokens=512, segments=64, loss_tokens=100, pool=100, window=32)
    got = pack_examples(docs, WORDS, 1, limits, "asked").collect()
    tokens = {i: (len((p or "").split()), len((t or "").split()) + 1) for i, t, p in rows}
    sums = {}
    for r in got:
        one = sums.setdefault(r.sequence_id, [0, 0, 0])
        for k, x in enumerate((r.length, 1, r.loss_tokens)):
            one[k] += x
    for i, (before, own) in tokens.items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == before + own == pieces[0].doc_tokens and sum(r.loss_tokens for r in pieces) == own
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert all(r.loss_tokens == max(0, r.start + r.length - max(r.start, before)) for r in pieces)
    assert all(s[0] <= 512 and s[1] <= 64 and s[2] <= 100 for s in sums.values())
    bound = sum(s[2] >= 90 and s[0] < 480 for s in sums.values())
    assert bound > len(sums) / 4  # closed by the third limit, with room for tokens
    free = pack_examples(docs, WORDS, 1, Limits(tokens=512, segments=64, loss_tokens=512, pool=100, window=32), "asked")
    assert free.select("sequence_id").distinct().count() < len(sums)


def test_very_short_texts_leave_little_padding(documents):
    got = pack_examples(documents([(i, "one two three four five six seven") for i in range(6000)], partitions=1), WORDS, 1).collect()
    sums = Counter()
    for r in got:
        sums[r.sequence_id] += r.length
    assert padding(pd.Series(list(sums.values()))) < 0.05


def test_bins_hold_all_limits_and_everything():
    rnd = np.random.default_rng(1)
    demands = np.stack([rnd.integers(1, 100, 300), np.ones(300, int), rnd.integers(0, 60, 300)], 1)
    limits = np.array([100, 4, 70])
    bins = pack_vectors(demands, limits, 16)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all((demands[b].sum(0) <= limits).all() for b in bins)
    fullness = demands.sum(0) / limits
    assert len(bins) <= 1.15 * fullness.max() + 1
    with pytest.raises(ValueError, match="limits"):
        pack_vectors(np.array([[101, 1, 0]]), limits, 16)


def test_padding_counts_powers_of_two_as_full():
    import pandas as pd

    assert padding(pd.Series([2048, 1024, 1])) == 0
    assert padding(pd.Series([1000])) == 1 - 1000 / 2048
