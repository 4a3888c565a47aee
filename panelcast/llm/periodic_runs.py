"""Periodic runs of words, found by recursive frequency splitting.

A run is a stretch of words with smallest period ``q`` and a length of at least
``max(min_length, 2 * q)`` that no neighbouring word extends. Each word of a run
comes at least twice in it, so a word that occurs once in a segment can lie in no
run of that segment: it splits the segment in two. The parts are split again by
their own counts until nothing changes, and parts of fewer than ``min_length``
words go. A run never holds a split, so the segments that are left hold all runs.

These are scanned lag by lag. Words ``q`` apart agree over at least
``step = max(q, min_length - q)`` places of a run in a row, so looking at every
``step``-th place finds it; the agreeing stretch around such a place is measured
with prefix sums of hashed words by bisection and then compared word by word. That
takes ``m log(m)`` looks for a segment of ``m`` words, also where everything agrees.

Everything is done on arrays of word numbers, for all texts of a batch at once.
Memory is a small multiple of a batch, which holds one longer text at most.

Defined cases: a null text is empty and has no words; empty and white-space texts
have no runs; repeated rows are answered each on their own; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelcast.llm import common

MIN_LENGTH = 12
#: Places looked at together in the lag scan; bounds its memory.
BLOCK = 1 << 18
#: Words hashed at a time when kept words are joined.
JOIN_WORDS = 1 << 16


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, words of each text, the distinct words). Words are parted
    by ASCII white space."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    coded = pc.dictionary_encode(flat)
    return coded.indices.to_numpy(zero_copy_only=False)[full], np.diff(ends), coded.dictionary


def _repeated(segment: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which words come more than once in their segment."""
    if not len(codes) or segment[0] == segment[-1]:
        return np.bincount(codes)[codes] > 1
    _, inverse, count = np.unique(segment * (int(codes.max()) + 1) + codes, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def segments(codes: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the stretches that frequency splitting leaves of texts whose
    words stand in ``codes`` one text after the other."""
    place = np.arange(len(codes))
    segment = np.repeat(np.arange(len(lengths)), lengths)
    while True:
        stays = _repeated(segment, codes[place])
        left, segment = place[stays], segment[stays]
        if not len(left):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.concatenate([[True], (np.diff(left) > 1) | (np.diff(segment) > 0)])
        number = np.cumsum(first) - 1
        size = np.bincount(number)
        long_enough = size[number] >= min_length
        done = len(left) == len(place) and long_enough.all()
        place, segment = left[long_enough], number[long_enough]
        if done:
            return left[first], size
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)


class Agreement:
    """How far two places of a word array agree, forwards and backwards, by bisection
    over prefix sums of ``hash(word) * base ** place`` modulo 2 ** 64."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), self.BASE)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.power[:-1], dtype=np.uint64)])

    def _same(self, lo: np.ndarray, hi: np.ndarray, lag: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.power[lag] == self.sums[hi + lag] - self.sums[lo + lag]

    def _bisect(self, limit: np.ndarray, same) -> np.ndarray:
        good, bad = np.zeros_like(limit), limit + 1
        while (open_ := bad - good > 1).any():
            middle = (good + bad) // 2
            ok = same(middle) & open_
            good, bad = np.where(ok, middle, good), np.where(open_ & ~ok, middle, bad)
        return good

    def forwards(self, at: np.ndarray, lag: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._bisect(limit, lambda k: self._same(at, at + k, lag))

    def backwards(self, at: np.ndarray, lag: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._bisect(limit, lambda k: self._same(at - k, at, lag))

    def exact(self, lo: int, hi: int, lag: int) -> bool:
        return bool((self.codes[lo:hi] == self.codes[lo + lag : hi + lag]).all())


def _scan(tell: Agreement, start: np.ndarray, size: np.ndarray, min_length: int) -> np.ndarray:
    """Rows (start, length, period) of all stretches with a period, also one that is a
    multiple of the smallest."""
    codes, found = tell.codes, [np.zeros((0, 3), np.int64)]
    lags = size // 2
    before = np.concatenate([[0], np.cumsum(lags)])
    for lo in range(0, int(before[-1]), BLOCK):
        entry = np.arange(lo, min(lo + BLOCK, int(before[-1])))
        seg = np.searchsorted(before, entry, side="right") - 1
        lag = entry - before[seg] + 1
        step = np.maximum(lag, min_length - lag)
        looks = -(-(size[seg] - lag) // step)
        total = np.concatenate([[0], np.cumsum(looks)])
        a = 0
        while a < len(entry):
            b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK, side="right")) - 1)
            which = np.repeat(np.arange(a, b), looks[a:b])
            at = start[seg[which]] + (np.arange(len(which)) - (total[which] - total[a])) * step[which]
            hit = codes[at] == codes[at + lag[which]]
            which, at = which[hit], at[hit]
            s, q = seg[which], lag[which]
            right = tell.forwards(at, q, start[s] + size[s] - q - at)
            left = tell.backwards(at, q, at - start[s])
            ok = left + right >= step[which]
            found.append(np.unique(np.column_stack([at - left, left + right + q, q])[ok], axis=0))
            a = b
    return np.concatenate(found)


def runs(codes: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period; ``start`` counts
    through all texts."""
    start, size = segments(codes, lengths, min_length)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    tell = Agreement(codes)
    found = _scan(tell, start, size, min_length)
    # A stretch found with several periods has the least of them; the others are its multiples.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1)])[: len(found)]]
    for s, n, q in found.tolist():
        if not tell.exact(s, s + n - q, q):  # two hashes fell together
            return _plain_runs(codes, start, size, min_length)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _plain_runs(codes: np.ndarray, start: np.ndarray, size: np.ndarray, min_length: int) -> np.ndarray:
    """As ``runs``, without hashes."""
    found: dict[tuple[int, int], int] = {}
    for s, m in zip(start.tolist(), size.tolist(), strict=True):
        part = codes[s : s + m]
        for q in range(1, m // 2 + 1):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], part[q:] == part[:-q], [0]])))
            for a, b in edge.reshape(-1, 2).tolist():
                if b - a >= max(q, min_length - q):
                    found.setdefault((s + a, b - a + q), q)
    rows = sorted((s, q, n) for (s, n), q in found.items())
    return np.array([(s, n, q) for s, q, n in rows], np.int64).reshape(-1, 3)


def planted(codes: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> np.ndarray:
    """The words after planting: with ``h = crc32(decimal doc_id)``, ``g = h // 10``, a
    text of ``n`` words with ``h % 10 = 0`` repeats the ``p = 1 + (n - a) // (3 + g % 8)``
    words from ``a = g % n`` on to its end. A null id is left as it is."""
    out = codes.copy()
    for lo, n, doc in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), doc_ids, strict=True):
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[lo + a : lo + n] = codes[lo + a + np.arange(n - a) % p]
    return out


def _joined_sha(codes: np.ndarray, distinct: pa.Array) -> str:
    """sha256 of the words joined by one space, a stretch at a time."""
    digest = hashlib.sha256()
    for lo in range(0, len(codes), JOIN_WORDS):
        words = distinct.take(pa.array(codes[lo : lo + JOIN_WORDS]))
        digest.update((" " if lo else "").encode() + " ".join(words.to_pylist()).encode())
    return digest.hexdigest()


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, n_collapsed long, collapsed_sha256 string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, plant: bool = False) -> DataFrame:
    """The runs of each text of ``docs (doc_id, text)`` and what is left of it.

    Per row: doc_id, n_words, runs (start, length, period; by start, then period),
    n_collapsed (words left when each run keeps its first period) and the sha256 of
    those words joined by one space. ``plant`` first plants runs as ``planted`` says.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch):
                yield scanned(part)

    def scanned(part: pa.RecordBatch) -> pa.RecordBatch:
        codes, lengths, distinct = words_of(common.strings(part.column("text")))
        if plant:
            codes = planted(codes, lengths, part.column("doc_id").to_pylist())
        ends = np.cumsum(lengths)
        found = runs(codes, lengths, min_length)
        doc = np.searchsorted(ends, found[:, 0], side="right")
        gone = np.zeros(len(codes) + 1, np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
        keep = np.cumsum(gone[:-1]) == 0
        shas, left = [], []
        for lo, hi in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
            words = codes[lo:hi][keep[lo:hi]]
            shas.append(_joined_sha(words, distinct))
            left.append(len(words))
        offsets = np.searchsorted(doc, np.arange(len(lengths) + 1))
        inside = found[:, 0] - (ends - lengths)[doc]
        rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (inside, found[:, 1], found[:, 2])], fields=list(_RUN))
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), pa.array(lengths, pa.int64()), listed, pa.array(left, pa.int64()), pa.array(shas, pa.string())],
            names=["doc_id", "n_words", "runs", "n_collapsed", "collapsed_sha256"],
        )

    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    return common.map_arrow(rows, scan, SCHEMA)


def digest_columns(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs`` its greatest run (ties: least start, then period)
    and the sha256 of the runs written as ``start,length,period`` and a line feed."""
    from pyspark.sql import functions as F

    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
