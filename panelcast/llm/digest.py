"""Quartile bucket digests of texts.

All byte triplets taken from a sliding window of five bytes (six triplets a
window, after the published TLSH construction) are hashed into 128 buckets. The
quartiles of the bucket counts turn each bucket into two bits. The digest is a
hex string: a logarithmic length, the two ratios of the quartiles, and the
buckets. Two digests are compared by a difference score that is bounded, so a
likeness between 0 and 1 follows from it.

A digest is a function of the text's UTF-8 bytes alone: equal texts have equal
digests. A text of fewer than five bytes has no triplets; its body is empty
(all buckets 0) and its length tells such texts apart only roughly.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common

BUCKETS = 128
#: Positions in the five-byte window, each triplet with an odd salt of its own.
TRIPLETS = (((0, 1, 2), 3), ((0, 1, 3), 5), ((0, 2, 3), 7), ((0, 1, 4), 11), ((0, 2, 4), 13), ((0, 3, 4), 17))
#: Bounds of the parts of the score: steps of length, steps of each ratio, and a
#: bucket that moves from the first to the last quartile.
MOST_LENGTH, MOST_RATIO, FAR_BUCKET = 24, 8, 6
HEADER = 3
#: Bytes whose triplets are counted at a time; bounds the memory of long texts.
STRETCH = 2 << 20


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the hashed triplets: a row of BUCKETS numbers for each text."""
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros(len(texts) * BUCKETS, np.int64)
    for lo in range(0, len(joined) - 4, STRETCH):  # a stretch sees the four bytes behind it
        data = joined[lo : lo + STRETCH + 4].astype(np.uint32)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.clip(bounds, lo, lo + len(data))))
        inside = doc[:-4] == doc[4:]
        base = doc[:-4][inside] * BUCKETS
        for spots, salt in TRIPLETS:
            a, b, c = (data[i : len(data) - 4 + i][inside] for i in spots)
            mixed = (a | b << np.uint32(8) | c << np.uint32(16)) * np.uint32(2654435761) ^ np.uint32(salt * 0x01000193)
            mixed *= np.uint32(2246822519)
            out += np.bincount(base + (mixed >> np.uint32(25)).astype(np.int32), minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def vectors(texts: list[bytes]) -> np.ndarray:
    """Digests as rows of bytes: length, two ratios, then 0 to 3 for each bucket."""
    counts = bucket_counts(texts)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    body = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    top = np.maximum(q3, 1)
    length = np.floor(np.log(np.fromiter(map(len, texts), np.float64, len(texts)) + 1) / np.log(1.1))
    return np.column_stack([np.minimum(length, 255), 15 * q1 // top, 15 * q2 // top, body]).astype(np.uint8)


def to_hex(vector: np.ndarray) -> list[str]:
    body = vector[:, HEADER:].reshape(len(vector), -1, 4)
    packed = body[:, :, 0] | body[:, :, 1] << 2 | body[:, :, 2] << 4 | body[:, :, 3] << 6
    return [row.tobytes().hex() for row in np.column_stack([vector[:, :HEADER], packed]).astype(np.uint8)]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference scores of rows of digests; at most ``most_difference()``."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    gap = np.abs(x - y)
    body = np.where(gap[:, HEADER:] == 3, FAR_BUCKET, gap[:, HEADER:]).sum(1)
    return np.minimum(gap[:, 0], MOST_LENGTH) + np.minimum(gap[:, 1:HEADER], MOST_RATIO).sum(1) + body


def most_difference() -> int:
    return MOST_LENGTH + 2 * MOST_RATIO + BUCKETS * FAR_BUCKET


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests; 0 from the body difference on that two independent
    digests have on average (13/8 a bucket)."""
    return np.maximum(0.0, 1 - difference(a, b) / (BUCKETS * 13 / 8))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs (doc_id, text)``, in one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch, limit=1 << 20):
                texts = [x.encode() for x in common.strings(part.column("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(to_hex(vectors(texts)))], names=["doc_id", "fingerprint"])

    return common.map_arrow(docs.select("doc_id", common.text_or_empty().alias("text")), run, "doc_id long, fingerprint string")


def next_in_order(docs: DataFrame) -> DataFrame:
    """Rows of (block, doc_id, text, guest): every row of ``docs`` in the block of its
    id, and the first row of the following block once more as a guest behind it.

    Blocks are ranges of ids, cut at quantiles of the id column, so that one
    shuffle of the texts brings neighbours together. The driver gets one number per
    block. Order: descending id, rows without id last, ties by text; behind the
    last row comes the first.
    """
    blocks = common.shuffle_partitions(docs)
    ids = docs.select("doc_id")
    probs = [i / blocks for i in range(1, blocks)] or [0.5]
    cuts = sorted(set(ids.select(F.percentile_approx("doc_id", probs, 10_000).alias("q")).first()["q"] or []))

    def block_of(x: int | None) -> int:
        """Descending order of ids is ascending order of blocks."""
        return len(cuts) + 1 if x is None else len(cuts) - bisect_right(cuts, x)

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = pa.array([block_of(x) for x in batch.column("doc_id").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([block, batch.column("doc_id")], names=["block", "doc_id"])

    tops = common.map_arrow(ids, blocks_of, "block int, doc_id long").groupBy("block").agg(F.max("doc_id").alias("top")).orderBy("block").collect()
    used = [r["block"] for r in tops]
    #: The first id of a block, and the block whose last row it follows.
    host = {r["top"]: used[i - 1] for i, r in enumerate(tops)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            guests = [i for i, x in enumerate(doc_ids) if x in host]
            block = pa.array([block_of(x) for x in doc_ids] + [host[doc_ids[i]] for i in guests], pa.int32())
            rows = batch.take(pa.array([*range(len(doc_ids)), *guests], pa.int32())) if guests else batch
            guest = pa.array([False] * len(doc_ids) + [True] * len(guests))
            yield pa.RecordBatch.from_arrays([block, rows.column("doc_id"), rows.column("text"), guest], names=["block", "doc_id", "text", "guest"])

    placed = common.map_arrow(docs.select("doc_id", common.text_or_empty().alias("text")), place, "block int, doc_id long, text string, guest boolean")
    return placed.repartitionById(blocks, F.pmod("block", F.lit(blocks))).sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is replaced
    by the beginning of the next document's text (descending id; see
    ``next_in_order``). A single document is its own next one.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Repeated ids each give a row.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far: block, id, text, guest
        for batch in batches:
            for part in common.by_bytes(batch, limit=1 << 20):
                rows = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
                both = ([held] if held else []) + rows
                held = rows[-1]
                found = [i for i, (a, b) in enumerate(zip(both, both[1:], strict=False)) if not a[3] and a[0] == b[0]]
                if found:
                    yield compared(both, np.array(found))

    def compared(rows: list[tuple], at: np.ndarray) -> pa.RecordBatch:
        texts = [(rows[i][2], rows[i + 1][2]) for i in at]
        halves = [(x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode() for x, y in texts]
        every, edited = vectors([r[2].encode() for r in rows]), vectors(halves)
        own, after = every[at], every[at + 1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in at], pa.int64()), pa.array([len(x) for x, _ in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in halves]),
                pa.array(to_hex(own)), pa.array(to_hex(edited)), pa.array(likeness(own, edited)), pa.array(likeness(own, after)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return common.map_arrow(next_in_order(docs), pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
