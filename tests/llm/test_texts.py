from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from featmatrix.llm import langid, line_dedup, maxent, pii, quality
from featmatrix.llm import suffix_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality rules


def brute_repeats(words, size=8):
    windows = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return len({i + k for i in range(len(words) - size + 1) if windows[tuple(words[i : i + size])] > 1 for k in range(size)})


def test_base_counts_by_brute_force(documents):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice(["a ", "b ", "c\n", "é#", "| ", "\x0b", "\x1c", " "]) for _ in range(rnd.choice([0, 5, 60, 400])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "same line here.\n" * 30), (103, "x " * 40000), (104, "one two three four five six seven eight " * 2)]
    got = {r.doc_id: r for r in quality.line_first_quality(documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        text, r = text or "", got[i]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeats = brute_repeats(words)
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words)) and r.n_lines == len(lines)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text) and r.n_repeat_words == repeats
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 20 or 100 * repeats > 30 * len(words))
        assert not (r.base_failed and r.kept)


def test_line_rules():
    rules = quality.QualityRules()
    broken = {
        "Home | News | Contact | Login": "navigation", "Share print": "navigation", "a » b » c » d": "navigation",
        "Licensed under the Apache License, Version 2.0.": "boilerplate", "© 2020 All rights reserved": "boilerplate",
        "the the the the and and and and": "boilerplate", "WIN!! BIG!! NOW!! HERE!!": "punctuation",
        "ab*** cd%%% ef&&& gh###": "punctuation", "--- ... ---": "punctuation",
        "A plain sentence with words, a comma and a dot.": None, "Ein Satz mit Umläuten: äöü.": None, "Really? Yes! That is so.": None,
    }
    for line, rule in broken.items():
        raw = line.encode()
        assert quality.broken_rule(raw, raw.split(), rules) == rule, line
    strict = quality.QualityRules(require_terminal=True)
    assert quality.broken_rule(b"no end here at all", b"no end here at all".split(), strict) == "punctuation"
    assert quality.broken_rule(b'he said "so."', b'he said "so."'.split(), strict) is None


def test_documents_that_lose_too_much_are_rejected(documents):
    good = "A plain sentence with seven words or more. " * 1 + "It goes on for quite a while with other words until twenty are there."
    menu = "Home | News | Contact | Login | Search | Help | More | Less"
    rows = [(1, good), (2, good + "\n" + menu), (3, good + "\n" + "\n".join(f"{menu} {i}" for i in range(9)))]
    got = {r.doc_id: (r.kept, r.cleaned) for r in quality.line_first_quality(documents(rows)).collect()}
    assert got == {1: (True, good), 2: (True, good), 3: (False, good)}
    assert quality.line_first_quality(documents(rows).limit(0)).count() == 0


# Language


def test_language_accuracy_and_edges(spark, documents):
    rnd = random.Random(1)
    sounds = {"aa": ["la", "ra", "ma", "ta"], "bb": ["ski", "ow", "ych", "cz"], "cc": ["ung", "sch", "ß", "ein"]}
    say = lambda lang, n: " ".join("".join(rnd.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(lang, rnd.randint(5, 60)), lang) for i, lang in enumerate(rnd.choice(list(sounds)) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "aa"), (903, say("aa", 20000), "aa"), (904, say("bb", 30), None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    model = langid.fit(table.where(~langid.held_out()), per_language=60, centroids=2, cells=1 << 12)
    assert set(model.languages) == set(sounds)
    got = {r.doc_id: r for r in langid.predict(table, model).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1 and r[0] < 900]
    assert len(held) > 50 and sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.99 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred == "aa" and got[904].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_recognised(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    nothing = langid.fit(table.limit(0))
    assert langid.predict(table, nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(table.limit(0), model).count() == 0


def test_far_text_is_rejected(spark):
    table = spark.createDataFrame([(i, "lara mata rama tala " * 5, "aa") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(table)
    assert langid.predict_one("lara mata rama", model)[2] is False
    assert langid.predict_one("щук жэк пых", model)[2] is True


# Byte strings


def brute_strings(rows, length):
    seen = defaultdict(int)
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, raw in raws:
        for at in range(len(raw) - length + 1):
            seen[raw[at : at + length]] += 1
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 2, int)
        for at in range(len(raw) - length + 1):
            if seen[raw[at : at + length]] > 1:
                gone[at + 1 : at + 1 + length] = 1
        stay = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), stay))
    return sorted(out)


@pytest.mark.parametrize("length, gram, hot", [(20, 8, 2000), (20, 8, 4), (31, 12, 40)])
def test_strings_against_brute_force(documents, length, gram, hot):
    rnd = random.Random(3)
    say = lambda n, letters="abcdefg \n": "".join(rnd.choice(letters) for _ in range(n))
    base, passage, edge = say(500), say(length + 15), say(2 * length + 4)
    rows = [(0, base), (1, base), (2, None), (3, ""), (4, "a" * 300), (5, "é" * 100), (6, base[:200] + "ZZ" + base[200:]), (6, base), (7, say(30_000))]
    for i in range(8, 90):
        tail = say(rnd.randint(0, 40), "ab") + base[i : i + rnd.randint(10, 150)]
        rows.append((i, say(rnd.randint(0, 90)) + passage + say(rnd.randint(0, 40)) + (edge if i % 3 else "") + tail))
    conf = sd.Repeats(length=length, gram=gram, hot=hot, range_items=50)
    got = sd.remove_repeats(documents(rows, partitions=6), conf).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute_strings(rows, length)


def test_no_strings(documents):
    assert sd.remove_repeats(documents([(1, "x")]).limit(0)).count() == 0
    assert sd.remove_repeats(documents([(1, "short"), (2, "short")])).agg(F.sum("n_removed")).first()[0] == 0


def test_merge_keeps_order_and_prefixes():
    rnd = random.Random(9)
    for _ in range(200):
        runs = [sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 12))}) for _ in range(rnd.randint(0, 9))]
        merged = list(sd.merge_runs([(keys, sd.front_coded(keys)[0]) for keys in runs]))
        keys = [runs[r][i] for r, i, _ in merged]
        assert keys == sorted(k for run in runs for k in run)
        assert all(same == sd._shared(a, b, 0) for a, b, (_, _, same) in zip(keys, keys[1:], merged[1:]))


def test_front_coding_round_trip():
    entries = [(b"abc", b"xy", 1, 2, 5, 7), (b"abd", b"", 0, 2, -1, 0), (b"b" * 300, b"q", 3, 9, 1 << 40, 4)]
    keys, shared, rest = sd._unpack(sd._pack(b"s", entries))
    assert keys == [e[0] for e in entries] and shared == [0, 2, 0] and rest == [e[1:] for e in entries]


# Lines


def brute_lines(rows, least):
    """All maximal runs by trying every block, shortest with enough words or longer."""
    blocks = defaultdict(list)
    docs = {}
    for i, text in rows:
        if text is None or i is None:
            continue
        lines = text.split("\n")
        own = [(n, x) for n, x in enumerate(lines) if WORD.search(x)]
        docs[i] = lines
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += len(WORD.findall(own[b][1]))
                if words >= least:
                    blocks[tuple(x for _, x in own[a : b + 1])].append((i, own[a][0], own[b][0]))
    gone = {i: set() for i in docs}
    for spots in blocks.values():
        for i, a, b in sorted(spots)[1:]:
            gone[i] |= set(range(a, b + 1))
    return {i: "\n".join(x for n, x in enumerate(lines) if n not in gone[i]) for i, lines in docs.items()}, gone


def test_line_runs_against_brute_force(documents):
    rnd = random.Random(7)
    pool = [" ".join(f"{rnd.choice('abc')}{n}" for n in range(rnd.randint(1, 6))) for _ in range(14)] + ["", " "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.choice([0, 2, 12, 30])))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "w " * 5000), (104, "w " * 5000), (105, "q w e r t y u i o p\n" * 50)]
    want, gone = brute_lines(rows, 8)
    got = {r.doc_id: r for r in line_dedup.line_report(documents(rows), 8).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        if text is not None:
            assert got[i].kept_sha256 == hashlib.sha256(want[i].encode()).hexdigest(), i
            assert got[i].n_removed == len(gone[i]) and got[i].n_lines == len(text.split("\n"))
    assert (got[100].n_lines, got[100].n_removed) == (0, 0)
    kept = line_dedup.remove_repeats(documents(rows), 8)
    assert kept.columns == documents(rows).columns
    left = {r.doc_id: r.text for r in kept.collect()}
    for i, text in rows:
        if text is None or not gone[i]:
            assert left[i] == text
        else:
            assert left.get(i) == (want[i] if WORD.search(want[i]) else None)
    assert line_dedup.line_report(documents(rows).limit(0)).count() == 0


def test_lines_of_rows_that_share_a_doc_id_are_not_lost(documents):
    """Two texts of one doc_id have runs of their own; only what repeats goes."""
    w, u = (" ".join(f"{x}{i}" for i in range(60)) for x in "wu")
    kept = [(r.doc_id, r.text) for r in line_dedup.remove_repeats(documents([(0, w), (1, u), (1, w), (1, u)])).collect()]
    assert sorted(kept) == [(0, w), (1, u), (1, u)]


def test_a_long_text_of_many_runs(documents):
    lines = [" ".join(f"l{i}w{k}" for k in range(10)) for i in range(4000)]
    text = "\n".join(x for i in range(0, 4000, 10) for x in (*lines[i : i + 6], f"own {i}", ""))
    found = {r.doc_id: r for r in line_dedup.line_report(documents([(1, "\n".join(lines)), (2, text)])).collect()}
    assert (found[2].n_removed, found[2].n_runs, found[1].n_removed) == (2400, 400, 0)
    kept = {r.doc_id: r.text for r in line_dedup.remove_repeats(documents([(1, "\n".join(lines)), (2, text)])).collect()}
    assert kept[2] == "\n".join(x for i in range(0, 4000, 10) for x in (f"own {i}", ""))


def test_line_plan_has_no_python(spark, plan_of):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"))
    plan = plan_of(line_dedup.line_report(docs)) + plan_of(line_dedup.remove_repeats(docs))
    assert not re.search("Python|Pandas|Arrow", plan)


# Language model


def test_scores_against_brute_force(documents):
    rnd = random.Random(2)
    words = {"x": [f"{c}ing" for c in "abcdefgh"], "y": [f"{c}ost" for c in "abcdefgh"]}
    say = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    rows = [(i, say("xy"[i % 2], rnd.randint(1, 60))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "Unseen WORDS été"), (903, say("x", 5000)), (902, "twice")]
    conf = maxent.Settings(vocabulary=12, endings=4, classes=4, buckets=256, batch=500, task_tokens=2000, blocks=8)
    table = documents(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    training = table.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)
    tokens = [(i, [w.lower() if w.isascii() else w for w in WORD.findall(t or "")] + ["\n"]) for i, t in rows]
    tokens = [(i, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in own]) for i, own in tokens]
    counts = Counter(w for i, own in tokens if not held(i) for w in own)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted(
        (i, len(own), sum(counts[w] > 0 for w in own), round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), 6))
        for i, own in tokens
    )
    got = maxent.score(table, maxent.fit(training, conf), conf).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    away = [r for r in got if held(r.doc_id) and r.doc_id < 900]
    assert sum(r.score for r in away) > 0.9 * sum(r.base_score for r in away)  # logarithms: nearer to 0 is better
    assert all(math.isfinite(r.score) for r in got)


def test_every_round_trains_on_all_texts(documents, monkeypatch):
    seen = []

    def count(docs, vocabulary, weights, conf):
        seen.append(docs.count())
        return np.zeros((conf.buckets, conf.classes), np.float32)

    monkeypatch.setattr(maxent, "_train_round", count)
    maxent.fit(documents([(i, f"a{i} b c") for i in range(50)]), maxent.Settings(vocabulary=9, endings=4, classes=4, buckets=256, blocks=8))
    assert seen == [50] * maxent.Settings.rounds


def test_scores_without_training(documents):
    table = documents([(1, "a b"), (2, None)])
    got = maxent.score(table, maxent.fit(table.limit(0))).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert maxent.score(table.limit(0), maxent.fit(table)).count() == 0


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_against_the_expressions():
    rnd = random.Random(4)
    bits = ["a", "@", ".", "b.c", "1", "23", "255", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "é", "@x.yz", "a@b.c", "\n", "000", "٣"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text
    pii.base_spans("a" * 200_000)
    pii.base_spans("1" * 200_000)
    pii.base_spans("+1" + " " * 100_000)


def test_fields_spread_a_label_to_repetitions(documents):
    rows = [(i, f"call +1 (555) 010-{i:04d} now") for i in range(200)] + [(500 + i, f"in {1900 + i} we had {i} cats") for i in range(99)]
    rows += [(300, None), (301, ""), (302, "write a@b.org and a@b.org"), (303, "x 10.0.0.1 " * 2000), (304, "9" * 30_000)]
    field = pii.fit(documents(rows))
    got = {r.doc_id: r for r in pii.find(documents(rows), field).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = brute_spans(text or "")
        joined = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    assert all(got[i].n_added == 0 for i in range(500, 599))
    assert pii.find(documents(rows).limit(0), field).count() == 0
    assert pii.fit(documents(rows).limit(0)).words.any() == False  # noqa: E712


def test_field_finds_numbers_that_the_patterns_ran_over(documents):
    phone, card, decoy, ip = "+1 (826) 555-40{:02d}", "4111111111111111", "4111111111111112", "190.137.{}.9"
    rows = [(i, f"call {phone.format(i % 90 + 10)} or pay {card} not {decoy} at {ip.format(i % 200)} now") for i in range(120)]
    glued = [(900, f"call {phone.format(81)} {ip.format(7)} now"), (901, f"call {phone.format(82)} {card} now"), (902, f"pay {decoy} now")]
    got = {r.doc_id: r for r in pii.find(documents(rows + glued), pii.fit(documents(rows + glued))).collect()}
    assert (got[900].n_phone, got[900].n_ip, got[900].n_added) == (0, 1, 1)
    assert got[900].spans == "phone:5:22,ip:23:34"
    assert (got[901].n_phone, got[901].n_card, got[901].spans) == (0, 0, "phone:5:22,card:23:39")
    assert (got[902].spans, got[0].n_added) == ("", 0)
    assert pii.overrun("a +1 22 33") == [] and pii.overrun("") == []


def test_beliefs_follow_links():
    field = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), np.where(np.eye(5, dtype=bool), 2.0, -1.0))
    field.words[1, 4], field.words[2] = 6.0, 0.0
    alone = pii.beliefs([[1], [2]], [], [], field)
    linked = pii.beliefs([[1], [2]], [], [(0, 1)], field)
    assert alone[1, 4] == pytest.approx(0.2) and linked[1, 4] > 0.75 and np.allclose(linked.sum(1), 1)


def test_beliefs_settle_on_long_paths():
    """The exact marginals of a path of 40 like words, of which only the first has evidence."""
    words = np.zeros((pii.FEATURES, 5))
    words[1, 1] = 6
    link = np.where(np.eye(5, dtype=bool), 3.0, -3.0)
    n = 40
    got = pii.beliefs([[1]] + [[2]] * (n - 1), [], [(i, i + 1) for i in range(n - 1)], pii.Field(words, np.zeros((5, 5)), link))
    step = np.exp(link) / np.exp(link).sum(1, keepdims=True)
    belief = np.exp(words[1]) / np.exp(words[1]).sum()
    for i in range(n):
        assert np.allclose(got[i], belief, atol=1e-3), i
        belief = belief @ step


def test_repetitions_are_linked_to_their_first():
    _, _, _, skip = pii._graph(" x x x ".join(["5551234567"] * 20))
    assert {(0, n) for n in range(1, 20)} <= set(skip) and {(n - 1, n) for n in range(1, 20)} <= set(skip)


def test_field_needs_no_pattern_in_the_text():
    words = np.zeros((pii.FEATURES, 5))
    words[43, 1] = 9  # an at sign
    field = pii.Field(words, np.zeros((5, 5)), np.zeros((5, 5)))
    assert pii.all_spans("mail user@localhost now", field) == ([], [(5, 0, 19)])
    assert pii.all_spans("nothing", field) == ([], [])


def test_masking(documents):
    rows = [(1, "mail a@b.org, ip 10.0.0.1!"), (2, None), (3, "nothing")]
    table = documents(rows)
    got = pii.mask(table, pii.fit(table))
    assert got.columns == table.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail <EMAIL>, ip <IP>!", 2: None, 3: "nothing"}


def test_number_signs_are_no_letters_and_a_null_doc_id_is_learned_from(spark):
    rows = [(None if i == 3 else i, "la ra ti mo " * 5, "aa") for i in range(12)] + [(50, "½ ²", "aa"), (51, "½ ² é", "aa"), (52, "①", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(docs, langid.fit(docs.where(~langid.held_out())))
    by_id = {r.doc_id: r.lang_pred for r in found.collect()}
    assert (by_id[50], by_id[51], by_id[52], by_id[None]) == ("und", "aa", "und", "aa")
    assert docs.select(langid.held_out().alias("h")).where("h is null").count() == 0


def test_fused_ranges():
    rnd = random.Random(2)
    for _ in range(200):
        ranges = [(r, a, a + rnd.randrange(4)) for r in rnd.sample([0, 1, 7, 1 << 33], 2) for a in (rnd.randrange(30) for _ in range(rnd.randrange(8)))]
        covered = {(r, x) for r, a, b in ranges for x in range(a, b + 1)}
        fused = [tuple(x) for x in sd.fuse(ranges).tolist()]
        assert {(r, x) for r, a, b in fused for x in range(a, b + 1)} == covered
        assert fused == sorted(fused) and all(r != s or b + 1 < c for (r, _, b), (s, c, _) in zip(fused, fused[1:]))


def near_copies(n, size=1000, edits=2):
    rnd = random.Random(n)
    base = [rnd.choice("abcdefghij klm") for _ in range(size)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(edits):
            own[rnd.randrange(size)] = rnd.choice("XYZUVW")
        rows.append((i, "".join(own)))
    return rows


def test_rows_of_a_large_group_of_near_copies_grow_with_its_documents(spark):
    """Also where its anchors are hot: ranges of windows stay ranges."""
    made = {}
    for n in (500, 4000):
        docs = spark.createDataFrame(near_copies(n), "doc_id long, text string").repartition(8)
        made[n] = sd.repeated_windows(sd._packed(docs)).count() / n
    assert made[4000] <= 2 * made[500]


def test_a_large_group_of_near_copies_against_all_windows(spark):
    rows = near_copies(4000)
    seen = Counter(text[i : i + 200] for _, text in rows for i in range(801))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in sd.remove_repeats(docs).collect()}
    for i, text in rows:
        lost = bytearray(len(text))
        for at in range(801):
            if seen[text[at : at + 200]] > 1:
                lost[at : at + 200] = b"\x01" * 200
        spans = sum(1 for k, x in enumerate(lost) if x and (k == 0 or not lost[k - 1]))
        assert got[i] == (sum(lost), spans, "".join(c for c, x in zip(text, lost) if not x))
