from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import pattern_packing as P
from panelcast.llm import tokens
from tests.llm.test_tokens import crc, expected_ids


def best_fit_decreasing(lengths, size):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else size
        n += room == size
        if room > x:
            insort(rooms, room - x)
    return n


def lengths(kind, n, size, rng):
    draw = {"short": lambda: min(size, 1 + int(rng.expovariate(12 / size))), "any": lambda: rng.randrange(1, size + 1), "thirds": lambda: rng.randrange(size // 5, size // 3), "halves": lambda: rng.randrange(size // 3, size * 3 // 5), "ones": lambda: 1, "hot": lambda: size * 3 // 8 if rng.random() < 0.5 else rng.randrange(1, size)}
    return [draw[kind]() for _ in range(n)]


def test_patterns_fill_a_sequence():
    found = P.patterns(64, 4)
    assert (found @ np.arange(1, 65) == 64).all() and found.sum(1).max() == 4
    assert len({tuple(x) for x in found}) == len(found) == sum(1 for a in range(65) for b in range(a, 65) for c in range(b, 65) if c <= 64 - a - b - c)


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 40)), rng.random(12) * rng.choice([-1, 1, 1], 12)
        x = P.nnls(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gain <= 1e-8).all() and abs(gain @ x) < 1e-8


@pytest.mark.parametrize("kind", ["short", "any", "thirds", "halves", "ones", "hot"])
@pytest.mark.parametrize("fit", [(64, 4), (128, 2)])
def test_plan_places_every_piece_once(kind, fit):
    size, rng = 1024, random.Random(kind)
    for n in (0, 1, 7, 3000):
        drawn = lengths(kind, n, size, rng)
        plan = P.Plan(np.bincount(drawn, minlength=size + 1)[1:], *fit)
        fill, ranks = defaultdict(list), defaultdict(list)
        for length, rank, each, first, count, offset in plan.rows:
            ranks[length] += range(rank, rank + each * count)
            for s in range(first, first + count):
                fill[s] += [(offset + i * length, length) for i in range(each)]
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(drawn.count(k))) for k in set(drawn)}
        assert sorted(fill) == list(range(plan.n_sequences))
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size


@pytest.mark.parametrize("kind", ["short", "any", "thirds", "halves", "hot"])
def test_plans_are_about_as_short_as_best_fit(kind):
    size, drawn = 4096, lengths(kind, 5000, 4096, random.Random(kind))
    histogram = np.bincount(drawn, minlength=size + 1)[1:]
    found = min(P.Plan(histogram, *fit).n_sequences for fit in P.FITS)
    assert found <= best_fit_decreasing(drawn, size) * 1.01 + 1


def test_patterns_carry_the_packing():
    drawn = lengths("any", 5000, 4096, random.Random(1))
    found = P.repeat_counts(np.bincount(drawn, minlength=4097)[1:], 64, 4)
    assert sum(n * int(p.sum()) for p, n in found) >= 0.9 * len(drawn)


def check(df, corpus, word_tok, seq_len, **more):
    want = expected_ids(word_tok, corpus, 1)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in P.pack(df, seq_len=seq_len, **more).withColumn("crc", F.crc32("ids")).collect():
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.crc) for r in parts] == [(k, k * seq_len, len(x), crc(x)) for k, x in enumerate(ids[a : a + seq_len] for a in range(0, len(ids), seq_len))]
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len
    sizes = [r.length for x in by_seq.values() for r in x]
    assert len(by_seq) <= best_fit_decreasing(sizes, seq_len) * 1.02 + 1


@pytest.fixture(scope="module")
def word_tok():
    return tokens.load_tokenizer(tokens.word_tokenizer_path())


def test_packing_places_every_id_once(clashing, corpus, word_tok):
    check(clashing, corpus, word_tok, 256, fits=((64, 4), (64, 2)))


def test_long_texts_are_encoded_in_parts(make, corpus, word_tok, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 2000)
    enc, out = tokens.encoder(tokens.word_tokenizer_path()), []
    from panelcast.llm import common

    text = dict(corpus)[1003]
    for part in common.slices(text, 1000):
        out += enc.encode(P.pa.array([part]))[0].tolist()
    assert out == word_tok.encode(text, add_special_tokens=False).ids
    assert "".join(common.slices(text, 77)) == text


def test_packing_of_nothing_null_and_repeated_rows(make):
    assert P.pack(make([])).count() == 0
    rows = P.pack(make([(None, None), (3, "a b"), (3, "a b")])).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 1), (3, 0, 3), (3, 0, 3)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3
