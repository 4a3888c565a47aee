"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Every text becomes about twenty statistics (lengths, shares of character classes,
repetition, entropy). Random Fourier features of the standardised statistics
approximate a Gaussian kernel; ridge scores follow from normal equations that each
partition sums for its rows, per fold. Scores of held-out folds are counted in
bins, and an isotonic curve through the bins turns scores into probabilities.

Inputs of a score are the statistics of the text alone.

Defined cases: null and empty texts have all statistics 0 and get a score like any
other; rows without id or label teach nothing; with no labels, or labels of one
class only, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common, linear

FOURIER = 256
FOLDS = 5
RIDGE = 1e-3
#: Width of the kernel in units of standardised statistics.
WIDTH = 3.0
#: Bins of out-of-fold scores for the isotonic curve.
SCORE_BINS = 1024
#: Labelled rows that the fit uses at most; beyond, a hash of the id chooses.
MAX_LABELLED = 200_000
STATISTICS = 20


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def byte_counts(texts: pa.Array) -> np.ndarray:
    """How often each byte occurs: a row of 256 numbers for each text."""
    n = len(texts)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if raw else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Columns for each text: words, distinct words, words that come once, the most
    frequent word's count, words that repeat the one before, distinct pairs of
    neighbours."""
    n = len(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    codes = pc.dictionary_encode(flat).indices.to_numpy()[full].astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(full)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    words = np.diff(bounds)
    of_word = np.repeat(np.arange(n), words)
    span = int(codes.max(initial=0)) + 1
    _, first, times = np.unique(of_word * span + codes, return_index=True, return_counts=True)
    distinct = np.bincount(of_word[first], minlength=n)
    once = np.bincount(of_word[first][times == 1], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, of_word[first], times)
    beside = of_word[1:] == of_word[:-1]
    again = np.bincount(of_word[1:][beside & (codes[1:] == codes[:-1])], minlength=n)
    pairs = np.unique(np.column_stack([of_word[1:][beside], codes[:-1][beside] * span + codes[1:][beside]]), axis=0)
    distinct_pairs = np.bincount(pairs[:, 0], minlength=n) if len(pairs) else np.zeros(n)
    return np.column_stack([words, distinct, once, most, again, distinct_pairs])


def long_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``byte_counts`` and ``word_counts`` of a single long text, part by part; words
    are numbered as they come."""
    code: dict[str, int] = {}
    times, bytes_seen, pairs = np.zeros(0, np.int64), np.zeros((1, 256)), np.zeros(0, np.int64)
    last, again = np.zeros(0, np.int64), 0
    for part in common.parts(texts):
        bytes_seen += byte_counts(part)
        flat = pc.ascii_split_whitespace(part).flatten()
        coded = pc.dictionary_encode(flat.filter(pc.not_equal(flat, "")))
        own = np.fromiter((code.setdefault(w, len(code)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        words = np.concatenate([last, own[coded.indices.to_numpy()]])
        times = np.pad(times, (0, len(code) - len(times))) + np.bincount(words[len(last) :], minlength=len(code))
        again += int((words[1:] == words[:-1]).sum())
        pairs = np.union1d(pairs, words[:-1] << 32 | words[1:])
        last = words[-1:]
    return bytes_seen, np.array([[times.sum(), len(times), (times == 1).sum(), times.max(initial=0), again, len(pairs)]], np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS numbers for each text."""
    histogram, counts = long_counts(texts) if common.is_long(texts) else (byte_counts(texts), word_counts(texts))
    words, distinct, once, most, again, distinct_pairs = counts.T
    size = histogram.sum(1)
    of = lambda chars: histogram[:, [ord(c) for c in chars]].sum(1)
    upper, lower, digits = histogram[:, 65:91].sum(1), histogram[:, 97:123].sum(1), histogram[:, 48:58].sum(1)
    lead = histogram[:, 192:].sum(1)  # first bytes of non-ASCII characters
    common_marks = of(".,")
    symbols = of("!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~")
    p = histogram / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    lines = of("\n") + 1
    return np.column_stack([
        np.log1p(size), np.log1p(words), _share(size, words), np.log1p(_share(size, lines)),
        _share(upper, size), _share(lower, size), _share(digits, size), _share(lead, size), _share(common_marks, size), _share(symbols, size),
        _share(of("!?"), words), _share(of("|"), words), _share(of("#$%&*"), words), _share(upper, upper + lower), entropy,
        _share(distinct, words), _share(once, words), np.sqrt(_share(most, words)), _share(again, words), _share(distinct_pairs, words),
    ])


def described(docs: DataFrame) -> DataFrame:
    """A written table (doc_id, features) of every row of ``docs (doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch):
                x = statistics(common.strings(part.column("text")))
                features = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS), pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), features], names=["doc_id", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return common.staged(common.map_arrow(rows, run, "doc_id long, features array<float>"), "quality-features")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    base: float

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / FOURIER), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the raw score keeps the order
        of texts that the isotonic curve puts level."""
        if not len(self.weights):
            return np.full(len(x), self.base)
        raw = self.fourier(x) @ self.weights
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1)


def fit(labelled: DataFrame, seed: int = 7) -> Model:
    """The model of ``labelled (doc_id, features, label)``, labels 0 and 1."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = linear.features_of(batch)
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        return np.array([[x.sum(0), (x * x).sum(0), np.r_[len(y), y.sum(), np.zeros(STATISTICS - 2)]]])

    total, squares, (n, ones, *_) = linear.summed(labelled, moments, (1, 3, STATISTICS))[0]
    mean = total / max(n, 1)
    scale = np.sqrt(np.maximum(squares / max(n, 1) - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    rng = np.random.default_rng(seed)
    empty = np.zeros(0)
    model = Model(mean, scale, rng.standard_normal((STATISTICS, FOURIER)) / WIDTH, rng.uniform(0, 2 * np.pi, FOURIER), empty, empty, empty, ones / n if n else 0.5)
    if not 0 < ones < n:
        return model
    width = FOURIER + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.fourier(linear.features_of(batch))
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        out = np.zeros((FOLDS, width, width + 1))
        for f in range(FOLDS):
            own = z[fold == f]
            out[f] = own.T @ np.column_stack([own, y[fold == f]])
        return out

    folded = labelled.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    parts = linear.summed(folded, equations, (FOLDS, width, width + 1))
    solve = lambda s: np.linalg.solve(s[:, :-1] + RIDGE * max(1.0, n / 1000) * np.eye(width), s[:, -1])
    held_out = np.array([solve(parts.sum(0) - parts[f]) for f in range(FOLDS)])
    model.weights = solve(parts.sum(0))

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        z = model.fourier(linear.features_of(batch))
        y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
        raw = (z * held_out[batch.column("fold").to_numpy(zero_copy_only=False)]).sum(1)
        spot = np.clip((raw + 0.5) / 2 * SCORE_BINS, 0, SCORE_BINS - 1).astype(int)
        return np.array([[np.bincount(spot, minlength=SCORE_BINS), np.bincount(spot, weights=y, minlength=SCORE_BINS), np.bincount(spot, weights=raw, minlength=SCORE_BINS)]])

    count, hits, raw = linear.summed(folded, bins, (1, 3, SCORE_BINS))[0]
    used = count > 0
    model.knots, model.values = linear.isotonic(raw[used] / count[used], count[used], hits[used] / count[used])
    return model


def scored(features: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(linear.features_of(batch)))], names=["doc_id", "score"])

    return common.map_arrow(features, run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Every row of ``docs (doc_id, text)``: doc_id, held_out, score, predicted.

    The fit uses rows of ``labels (doc_id, quality)`` whose crc32 of the id as text
    leaves another remainder than 1 by 3, and at most about ``max_labelled``.
    """
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(~held_out & F.col("label").isin(0, 1))
    features = described(docs)
    labelled = common.staged(features.join(linear.bounded(taught, max_labelled), "doc_id"), "quality-labelled")
    rows = scored(features, fit(labelled))
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
