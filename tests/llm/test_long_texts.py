"""Texts beyond a batch: counted part by part they give what they give as a whole."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import common, decontam, digest, minhash, packing, quality, tokens, toxicity
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    block = [prose(rng, 4000) + rng.choice(["\n", "  ", "\r\n\t", " É,ü «ß» "]) for _ in range(40)]
    text = "".join(rng.choice(block) for _ in range(450))
    assert len(text) > tokens.BATCH_BYTES
    return text


@pytest.fixture(scope="module")
def alone(long_text):
    return pa.array([long_text])


@pytest.fixture(scope="module")
def beside(long_text):
    """The same text with another one, which no operator cuts."""
    return pa.array([long_text, "a few words"])


def test_parts_hold_the_whole_text(alone, beside, long_text):
    cut = [p[0].as_py() for p in common.parts(alone)]
    assert "".join(cut) == long_text and len(cut) > 3 and all(x[0] in " \t\n\r" for x in cut[1:])
    assert [p.equals(beside) for p in common.parts(beside)] == [True]


def test_ids(alone, long_text):
    path = tokens.word_tokenizer_path()
    ids, lengths = tokens.encoder(path).encode(alone)
    assert ids.tolist() == tokens.load_tokenizer(path).encode(long_text, add_special_tokens=False).ids
    assert lengths.tolist() == [len(ids)]


def test_curve_cells_in_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([0, 5, 3000, 0, 1, 700])
    ids = rng.integers(0, 49_000, lengths.sum())
    tables = packing.projections(49_152)
    whole = packing.coordinates(ids, lengths, tables)
    monkeypatch.setattr(packing, "STRETCH", 97)
    assert (packing.coordinates(ids, lengths, tables) == whole).all()


def test_triplets_in_stretches(monkeypatch):
    rng = random.Random(5)
    texts = [b"", b"abcd", b"abcde", prose(rng, 900).encode(), "é".encode() * 300, b"xyzzy!"]
    whole = digest.bucket_counts(texts)
    assert whole.sum(1).tolist() == [6 * max(0, len(t) - 4) for t in texts]
    for size in (1, 6, 101):
        monkeypatch.setattr(digest, "STRETCH", size)
        assert (digest.bucket_counts(texts) == whole).all()


def test_shingles(alone, beside):
    h, bounds = minhash.shingle_sets(alone)
    want, at = minhash.shingle_sets(beside)
    assert bounds.tolist() == [0, at[1]] and (h == want[: at[1]]).all()
    wide = pa.array([" " * (5 << 20) + "One two three"])
    assert (minhash.shingle_sets(wide)[0] == minhash.shingle_sets(pa.array(["one two THREE"]))[0]).all()
    assert len(minhash.shingle_sets(pa.array([" " * (5 << 20)]))[0]) == 0


def test_statistics(alone, beside):
    assert np.allclose(quality.statistics(alone)[0], quality.statistics(beside)[0], rtol=1e-12, atol=0)
    blank = " " * (5 << 20)
    assert np.allclose(quality.statistics(pa.array([blank]))[0], quality.statistics(pa.array([blank, "x"]))[0], rtol=1e-12, atol=0)


def test_distinct_words(alone, beside):
    flat, bounds = toxicity.distinct_words(alone)
    want, at = toxicity.distinct_words(beside)
    assert sorted(flat.to_pylist()) == sorted(set(want[: int(at[1])].to_pylist())) and bounds.tolist() == [0, len(flat)]


@pytest.mark.parametrize("stretch", [7, decontam.STRETCH])
def test_windows_across_parts(alone, beside, long_text, monkeypatch, stretch):
    words = long_text[:400].split()
    cut = [len(p[0].as_py()) for p in common.parts(alone)]
    across = long_text[cut[0] - 60 : cut[0] + 60].split()[1:-1]
    items = [("q1", " ".join(words[5:17])), ("q2", " ".join(across[:12])), ("q3", "no such words at all"), ("q4", "  «É, ß ")]
    matcher = decontam.Matcher(items)
    n, found = matcher.find(beside)
    monkeypatch.setattr(decontam, "STRETCH", stretch)
    m, again = matcher.find(alone)
    assert m[0] == n[0] and again[0] == found[0] and {"q1", "q2"} <= set(found[0][1])
