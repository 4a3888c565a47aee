"""The two classifiers against plain versions that hold everything in memory."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelcast.llm import common, quality, queries, toxicity
from tests.conftest import SF001


def plain_statistics(text: str) -> list[float]:
    data, words = text.encode(), re.findall(r"[^ \t\n\v\f\r]+", text)
    size, n, lines = len(data), len(words), text.count("\n") + 1
    share = lambda a, b: a / max(b, 1)
    count = lambda chars: sum(text.count(c) for c in chars)
    within = lambda lo, hi: sum(lo <= b <= hi for b in data)
    upper, lower = within(65, 90), within(97, 122)
    entropy = -sum(c / size * math.log2(c / size) for c in Counter(data).values()) if size else 0.0
    times, pairs = Counter(words), set(zip(words, words[1:], strict=False))
    return [
        math.log1p(size), math.log1p(n), share(size, n), math.log1p(share(size, lines)),
        share(upper, size), share(lower, size), share(within(48, 57), size), share(within(192, 255), size), share(count(".,"), size),
        share(count("!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"), size),
        share(count("!?"), n), share(count("|"), n), share(count("#$%&*"), n), share(upper, upper + lower), entropy,
        share(len(times), n), share(sum(c == 1 for c in times.values()), n), math.sqrt(share(max(times.values(), default=0), n)),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), share(len(pairs), n),
    ]


def test_statistics_against_plain_python(spark, corpus):
    texts = [t or "" for _, t in corpus] + ["a a a b\nA! 12 | ## x.y,z", "é é ü"] + [r.text or "" for r in common.table(spark, SF001, "documents").collect()]
    assert np.allclose(quality.statistics(pa.array(texts)), [plain_statistics(t) for t in texts], rtol=1e-9, atol=1e-12)


def rising(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression by its definition: the greatest, over starts up to i, of the
    least, over ends from i, of the means in between."""
    n = len(means)
    mean = lambda j, k: np.average(means[j : k + 1], weights=weights[j : k + 1])
    return np.array([max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)])


def test_quality_against_a_ridge_fit_in_memory(spark):
    docs, labels = (common.table(spark, SF001, t) for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in queries.op10_fourier_quality(spark, SF001).collect()}
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    fold_of = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(quality.FOLDS))
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality", held.alias("held"), fold_of.alias("fold")).orderBy("doc_id").collect()
    x = np.array([plain_statistics(r.text or "") for r in rows], np.float32).astype(float)
    taught = np.array([not r.held for r in rows])
    y, fold = np.array([r.quality for r in rows], float), np.array([r.fold for r in rows])

    mean, scale = x[taught].mean(0), x[taught].std(0)
    scale[scale < 1e-5] = 1
    rng = np.random.default_rng(7)
    frequencies, phases = rng.standard_normal((quality.STATISTICS, quality.FOURIER)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.FOURIER)
    z = np.cos(np.clip((x - mean) / scale, -8, 8) @ frequencies + phases) * np.sqrt(2 / quality.FOURIER)
    z = np.column_stack([z, np.ones(len(z))])
    penalty = math.sqrt(quality.RIDGE * max(1.0, taught.sum() / 1000)) * np.eye(z.shape[1])

    def ridge(use):
        return np.linalg.lstsq(np.vstack([z[use], penalty]), np.r_[y[use], np.zeros(len(penalty))], rcond=None)[0]

    raw = z @ ridge(taught)
    left_out = np.zeros(len(rows))
    for f in range(quality.FOLDS):
        left_out[fold == f] = z[fold == f] @ ridge(taught & (fold != f))
    spot = np.clip((left_out + 0.5) / 2 * quality.SCORE_BINS, 0, quality.SCORE_BINS - 1).astype(int)
    bins = [np.flatnonzero(taught & (spot == b)) for b in sorted(set(spot[taught]))]
    weights = np.array([len(b) for b in bins], float)
    places, hits = np.array([left_out[b].mean() for b in bins]), np.array([y[b].mean() for b in bins])
    level = rising(weights, hits)
    knots = sorted(set(np.round(level, 12)))
    pools = [np.isclose(level, v, atol=1e-9) for v in knots]
    curve = np.interp(raw, [np.average(places[p], weights=weights[p]) for p in pools], knots)
    want = 0.999 * curve + 0.001 * np.clip(raw, 0, 1)
    assert len(got) == docs.count()
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=2e-4)


def plain_words(text: str) -> set[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights that make the penalised likelihood greatest, by Newton steps to convergence."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curvature = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + toxicity.RIDGE * np.eye(len(w))
        step = np.linalg.solve(curvature, x.T @ (y - p) - toxicity.RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def test_toxicity_against_a_chain_in_memory(spark):
    docs, labels = (common.table(spark, SF001, t) for t in ("documents", "labels"))
    got = {r.doc_id: (r.p_low_quality, r.score) for r in queries.op8_toxicity_chain(spark, SF001).collect()}
    fold_of = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(toxicity.FOLDS))
    rows = docs.join(labels.select("doc_id", "quality", F.col("toxic").cast("int").alias("toxic")), "doc_id").select("doc_id", "text", "quality", "toxic", fold_of.alias("fold")).orderBy("doc_id").collect()
    held, fold = [plain_words(r.text or "") for r in rows], np.array([r.fold for r in rows])
    probability = lambda x, w: 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    applied, unseen = [], []  # probabilities of the links so far: by the whole models, and out of fold
    for y in (np.array([1 - r.quality for r in rows], float), np.array([r.toxic for r in rows], float)):
        n, ones = len(y), y.sum()
        scored = []
        texts = Counter(w for ws in held for w in ws)
        hits = Counter(w for ws, t in zip(held, y, strict=True) for w in ws if t)
        for w, t in texts.items():
            gap, share = hits[w] / ones - (t - hits[w]) / (n - ones), t / n
            value = abs(gap) / math.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)) + 1e-12)
            if t >= toxicity.LEAST_TEXTS and value >= toxicity.LEAST_Z:
                scored.append((-value, w))
        vocabulary = [w for _, w in sorted(scored)[: toxicity.WORDS]]
        base = np.array([[w in ws for w in vocabulary] for ws in held], float).reshape(n, -1)
        seen = np.column_stack([base, *unseen, np.ones(n)])
        whole = logistic(seen, y)
        out = np.zeros(n)
        for f in range(toxicity.FOLDS):
            out[fold == f] = probability(seen[fold == f], logistic(seen[fold != f], y[fold != f]))
        applied.append(probability(np.column_stack([base, *applied, np.ones(n)]), whole))
        unseen.append(out)
    assert len(got) == docs.count()
    assert np.allclose([got[r.doc_id] for r in rows], np.column_stack(applied), atol=2e-3)
