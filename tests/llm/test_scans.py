from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import decontam, digest, secret_scan
from tests.llm.conftest import prose

SECRET = "token = 'Zk39fjQ0pLx82mVb71TnAa55'"


def test_digest_of_equal_texts_and_of_order():
    a, b = "quiet morning light " * 50, "river bridge candle " * 50
    v = digest.vectors([a.encode(), a.encode(), (a + "x").encode(), b.encode(), b"", b"abcd"])
    likeness = digest.likeness(v[[0, 0, 0, 0]], v[[1, 2, 3, 4]])
    assert likeness[0] == 1 and likeness[1] > 0.8 > likeness[2] and (likeness >= 0).all()
    assert len({len(h) for h in digest.to_hex(v)}) == 1
    assert (digest.difference(v[:, ::1], v[::-1]) <= digest.most_difference()).all()
    assert digest.bucket_counts([b"", b"abcd"]).sum() == 0


def test_bucket_counts_equal_a_plain_loop():
    text = "Ünï the quick brown fox".encode()
    want = np.zeros(digest.BUCKETS, int)
    for i in range(len(text) - 4):
        for spots, salt in digest.TRIPLETS:
            t = sum(text[i + p] << 8 * k for k, p in enumerate(spots))
            h = (t * 2654435761 & 0xFFFFFFFF) ^ (salt * 0x01000193 & 0xFFFFFFFF)
            want[(h * 2246822519 & 0xFFFFFFFF) >> 25] += 1
    assert digest.bucket_counts([b"pad", text, b"more of it"])[1].tolist() == want.tolist()


def edited(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(a) // 2
        yield i, a, a[: len(a) - h] + b[:h], b


def test_edited_pairs(clashing, corpus):
    rows = {(r.doc_id, r.n_chars): r for r in digest.edited_pairs(clashing).collect()}
    assert len(rows) == len(corpus)
    for i, a, e, b in edited(corpus):
        r = rows[i, len(a)]
        own, changed, after = (digest.vectors([x.encode()]) for x in (a, e, b))
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (digest.to_hex(own)[0], digest.to_hex(changed)[0])
        assert (r.near_edited, r.near_next) == (digest.likeness(own, changed)[0], digest.likeness(own, after)[0])


@pytest.mark.parametrize("docs", [[], [(5, "alone in here")], [(5, "b text one"), (5, "a text two"), (None, "null id text"), (None, None), (-9, "")]])
def test_edited_pairs_of_few_rows(make, docs):
    got = sorted((r.n_chars, r.edited_sha256) for r in digest.edited_pairs(make(docs)).collect())
    assert got == sorted((len(a), hashlib.sha256(e.encode()).hexdigest()) for _, a, e, _ in edited(docs))


def test_digests_is_narrow(make, corpus):
    rows = digest.digests(make(corpus)).collect()
    assert sorted(r.fingerprint for r in rows) == sorted(digest.to_hex(digest.vectors([(t or "").encode() for _, t in corpus])))


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_base_spans_equal_the_plain_patterns(make):
    rng = random.Random(3)
    bits = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "deadbeefdeadbeef", "0123456789abcdef0", "x", "é", "abcdefghijkl", "-", "tokenK"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))) for i in range(400)] + [(1000, None), (1001, SECRET * 400)]
    scanned = secret_scan.digest_columns(secret_scan.scan_secrets(make(docs), F.col("source"), F.col("source")))
    rows = {r.doc_id: r for r in scanned.collect()}
    assert len(rows) == len(docs)
    for i, t in docs:
        want = base_spans(t or "")
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_ownership_tells_examples_from_live_values(spark):
    copied, own, bare = "Zk39fjQ0pLx82mVb71TnAa55", "Qw71hhXc93LmPo20RtYu64Bn", "Hj82KdLs03MnBv57QaZx19We"
    rows = [(i, f"use token={copied} as in the manual", f"repo{i}", f"owner{i % 6}") for i in range(30)]
    rows += [(100 + i, f"password: {own}", f"repo{i}", "owner9") for i in range(30)] + [(200, f"left here {bare} by chance", None, None), (201, f"{copied} bare", "r", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(docs, F.col("repo"), F.col("owner")).collect()}
    assert {s.verdict for i in range(30) for s in got[i]} == {"example"}
    assert {(s.verdict, s.n_owners, s.n_repos) for i in range(30) for s in got[100 + i]} == {("live", 1, 30)}
    assert [(s.kind, s.verdict) for s in got[200]] == [(3, "live")]
    assert got[201] == []


def test_secrets_of_nothing(make):
    assert secret_scan.scan_secrets(make([]), F.col("source"), F.col("lang")).count() == 0


def item_windows(text, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [w[i : i + window] for i in range(max(len(w) > 0, len(w) - window + 1))]


def brute_contamination(docs, items):
    keys = [(str(i), k) for i, t in items for k in item_windows(t)[1]]
    for i, t in docs:
        w, hit, names = item_windows(t)[0], set(), set()
        for name, k in keys:
            for p in range(len(w) - len(k) + 1):
                if w[p : p + len(k)] == k:
                    hit.update(range(p, p + len(k)))
                    names.add(name)
        yield i, len(w), len(hit), sorted(names)


@pytest.fixture(scope="module")
def bench_items():
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(12)] + [(12, None), (13, "..."), (14, "Zebra crossing"), (15, "Zebra"), (16, "ÉTÉ Über")]
    return items + [(17, items[0][1]), (18, items[1][1].upper())]


@pytest.fixture(scope="module")
def leaky(bench_items):
    rng = random.Random(9)
    docs = [(i, prose(rng, 40)) for i in range(20)]
    for i in range(20, 40):
        w = bench_items[i % 12][1].split()
        docs.append((i, prose(rng, 20) + "\n" + "; ".join(w[i % 9 : i % 9 + rng.choice([9, 10, 14])]) + " -- " + prose(rng, 5)))
    return docs + [(50, None), (51, ""), (52, "a zebra, zebra crossing"), (53, "l'ÉTÉ über alles"), (54, "été über"), (55, (bench_items[2][1] + " ") * 300)]


@pytest.mark.parametrize("limit", [1 << 20, 700])
def test_contamination_equals_brute_force(spark, make, bench_items, leaky, limit):
    bench = spark.createDataFrame(bench_items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(make(leaky), bench, max_item_bytes=limit).collect()}
    want = {i: (n, h, x) for i, n, h, x in brute_contamination(leaky, bench_items)}
    assert got == want
    assert sum(h > 0 for _, h, _ in want.values()) > 10


def test_contamination_of_nothing(spark, make):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontam.contamination(make([(1, "one two"), (None, None)]), empty).orderBy("n_words").collect()] == [(0, 0), (2, 0)]
    assert decontam.contamination(make([]), empty).count() == 0


def test_word_places_are_places_in_the_original():
    text = "«Été», it's\n2 Zürich—ÀB"
    flat, bounds = decontam.words(pa.array([text]))
    assert [text[a:b].lower() for a, b in decontam.word_places(text)] == [w.lower() for w in flat.to_pylist()]
    assert bounds.tolist() == [0, len(flat)]
