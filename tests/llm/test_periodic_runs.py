from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import periodic_runs as P


def plain_runs(words, least=12):
    """By the definition: every stretch of period q that no neighbour extends, q its smallest period."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                part = words[i : i + size]
                if not any(part[:-d] == part[d:] for d in range(1, q)):
                    out.add((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def expected(doc_id, text, plant=True):
    words = words_of(doc_id, text, plant)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs),
        *((best[0], best[1], best[2], best[1] * 1000 // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_runs_of_random_words_equal_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words = [rng.choice("abcdef"[: rng.randrange(1, 7)]) for _ in range(rng.randrange(0, 60))]
            for _ in range(rng.randrange(0, 3)):
                at, p, k = rng.randrange(0, len(words) + 1), rng.randrange(1, 9), rng.randrange(2, 30)
                words[at:at] = [words[i % len(words)] if words else "z" for i in range(p)] * (k // p + 1)
            texts.append(words)
        codes, lengths, _ = P.words_of(pa.array([" ".join(x) for x in texts]))
        got = P.runs(codes, lengths).tolist()
        want, base = [], 0
        for words in texts:
            want += [[base + s, n, q] for s, n, q in plain_runs(words)]
            base += len(words)
        assert got == want
        start, size = P.segments(codes, lengths)
        assert P._plain_runs(codes, start, size, 12).tolist() == want


def test_segments_hold_no_word_that_comes_once():
    rng = random.Random(4)
    words = [str(int(rng.paretovariate(0.6))) for _ in range(3000)]
    codes, lengths, _ = P.words_of(pa.array([" ".join(words)]))
    start, size = P.segments(codes, lengths)
    assert len(start) and (size >= 12).all()
    for s, n in zip(start, size, strict=True):
        assert (np.unique(codes[s : s + n], return_counts=True)[1] > 1).all()


def test_hashes_that_fall_together_do_no_harm(monkeypatch):
    monkeypatch.setattr(P.Agreement, "BASE", np.uint64(0))
    codes, lengths, _ = P.words_of(pa.array(["a b c a b d a b c a b d a b c a b d x x y x x y x x y x x z"]))
    want = [list(r) for r in plain_runs("a b c a b d a b c a b d a b c a b d x x y x x y x x y x x z".split())]
    assert P.runs(codes, lengths).tolist() == want


def test_query_equals_brute_force(clashing, corpus):
    got = sorted(P.digest_columns(P.periodic_runs(clashing, plant=True)).collect(), key=lambda r: str(tuple(r)))
    small = [(i, t) for i, t in corpus if len(t or "") < 20_000]
    want = {i: expected(i, t) for i, t in small}
    assert len(got) == len(corpus)
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id in want} == want
    assert any(x[0] for x in want.values()) and any(not x[0] for x in want.values())


def test_awkward_rows(make):
    loop = "x y z " * 9
    pairs = [(None, loop), (None, None), (5, ""), (6, " \n "), (7, "a " * 11), (8, "a " * 12), (8, "a " * 12), (9, "　".join("ab" * 30)), (11, loop + "q " + loop)]
    got = sorted(map(tuple, P.digest_columns(P.periodic_runs(make(pairs), plant=True)).collect()), key=str)
    assert got == sorted(((i, *expected(i, t)) for i, t in pairs), key=str)
    assert P.periodic_runs(make([])).count() == 0


@pytest.mark.parametrize("words", ["a", "a b", "a b c d e f g"])
def test_long_periodic_text(words):
    n = 200_000
    text = " ".join((words.split() * n)[:n])
    codes, lengths, _ = P.words_of(pa.array([text]))
    assert P.runs(codes, lengths).tolist() == [[0, n, len(words.split())]]
