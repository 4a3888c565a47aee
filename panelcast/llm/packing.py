"""Packing along a space-filling curve.

Every document becomes a hashed count vector of its token ids, projected to a
few dimensions by a fixed random matrix and quantised; its place on the Hilbert
curve through that grid is its sort key. Documents are range-sorted by (key,
doc_id) and laid end to end along the curve, and the stream is cut every
``seq_len`` ids. So neighbouring documents share sequences and only the last
sequence of the corpus has padding.

Keys of many copies are equal, so ranges are cut by (key, doc_id, row): a hot key
spreads over as many partitions as it needs.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
each on their own; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common, tokens

HASHED = 256
DIMS = 4
BITS = 15
SEED = 20240229
#: Ids that are counted at a time; bounds the memory of long texts.
STRETCH = 4 << 20


def projections(vocab_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token id its hashed coordinate and sign, and the matrix to few dimensions."""
    mixed = np.arange(vocab_size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    slot = (mixed >> np.uint64(40)).astype(np.int64) % HASHED
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    matrix = np.random.default_rng(SEED).standard_normal((HASHED, DIMS))
    return slot, sign, matrix


def coordinates(ids: np.ndarray, lengths: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """A grid cell of DIMS numbers below 2**BITS for each document."""
    slot, sign, matrix = tables
    n = len(lengths)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.zeros(n * HASHED)
    for lo in range(0, len(ids), STRETCH):
        some = ids[lo : lo + STRETCH]
        doc = np.repeat(np.arange(n), np.diff(np.clip(bounds, lo, lo + len(some))))
        counts += np.bincount(doc * HASHED + slot[some], weights=sign[some], minlength=n * HASHED)
    counts = counts.reshape(n, HASHED)
    damped = np.sign(counts) * np.sqrt(np.abs(counts))
    norm = np.linalg.norm(damped, axis=1, keepdims=True)
    spot = damped @ matrix / np.where(norm > 0, norm, 1)
    top = (1 << BITS) - 1
    return np.clip((spot + 4) / 8 * top, 0, top).astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell on the Hilbert curve (Skilling, 2004): the axes are turned
    into the transposed index, whose bits are then interleaved."""
    x = [c.copy() for c in np.asarray(cells, np.int64).T]
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[-1] & (1 << b), t ^ ((1 << b) - 1), t)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ t) >> b & 1)
    return key


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A written table (row, doc_id, key, n, ids): ``row`` numbers the rows, and
    ``ids`` are little-endian bytes, the end id included."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer)
        tables, row = projections(enc.vocab_size), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in common.by_bytes(batch, limit=tokens.BATCH_BYTES):
                plain, lengths = enc.encode(common.strings(part.column("text")))
                key = hilbert_key(coordinates(plain, lengths, tables))
                ids, lengths = tokens.with_end_id(plain, lengths, end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(key))), part.column("doc_id"), pa.array(key), pa.array(lengths), tokens.cut(ids, lengths, "<u2" if enc.vocab_size <= 1 << 16 else "<u4")],
                    names=["row", "doc_id", "key", "n", "ids"],
                )
                row += len(key)

    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    return common.staged(common.map_arrow(rows, encode, "row long, doc_id long, key long, n long, ids binary"), "packing-ids")


def along_curve(rows: DataFrame) -> DataFrame:
    """(row, at): how many ids lie on the curve before each row of (row, doc_id,
    key, n). The driver adds up one number per partition of the range sort."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, run = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = run + np.cumsum(n) - n
            run += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int32)), pa.array(at), batch.column("n")], names=["row", "part", "at", "n"])

    ordered = rows.select("row", "doc_id", "key", "n").repartitionByRange(common.shuffle_partitions(rows), "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    spots = common.staged(common.map_arrow(ordered, local, "row long, part int, at long, n long"), "packing-order")
    totals = {r["part"]: r["n"] for r in spots.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, run = [], 0
    for part in range(max(totals, default=-1) + 1):
        before.append(run)
        run += totals.get(part, 0)
    starts = np.array(before, np.int64)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(batch.column("at").to_numpy() + starts[batch.column("part").to_numpy()])], names=["row", "at"])

    return common.map_arrow(spots, shift, "row long, at long")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, seq_len: int = 4096) -> DataFrame:
    """The pieces of all documents of ``docs (doc_id, text)``.

    Per piece: doc_id, start (the document's ids before it), length, doc_tokens,
    sequence_id, offset (in the sequence) and ids, little-endian 32-bit. A sequence
    holds ``seq_len`` ids without gaps; the last one may be shorter.
    """
    rows = encoded(docs, tokenizer or tokens.word_tokenizer_path(), end_id)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch, "ids"):
                at, n = part.column("at").to_numpy(), part.column("n").to_numpy()
                data = part.column("ids")
                first = at // seq_len
                count = (at + n - 1) // seq_len - first + 1
                doc = np.repeat(np.arange(len(n)), count)
                sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                lo = np.maximum(sequence * seq_len, at[doc])
                length = np.minimum((sequence + 1) * seq_len, (at + n)[doc]) - lo
                raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] else np.zeros(0, np.uint8)
                offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
                width = int(offsets[-1] - offsets[0]) // max(1, int(n.sum()))
                ids = raw[offsets[0] : offsets[-1]].view(f"<u{width}")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), *map(pa.array, (lo - at[doc], length, n[doc], sequence, lo - sequence * seq_len)), tokens.cut(ids, length, "<u4")],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    placed = rows.select("row", "doc_id", "n", "ids").join(along_curve(rows), "row").select("doc_id", "at", "n", "ids")
    return common.map_arrow(placed, pieces, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
