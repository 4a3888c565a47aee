"""Packing by patterns of lengths, fitted by non-negative least squares.

Only the histogram of piece lengths (one count for each length up to ``seq_len``)
decides how many sequences of which make there are; the pieces themselves are then
dealt to them by their rank among the pieces of one length.

1. Texts are encoded into a written table of pieces of at most ``seq_len`` ids.
2. Lengths are binned to ``units`` steps, upwards. A pattern is a set of at most
   ``max_docs`` bins that fill a sequence. Repeat counts of all patterns are fitted to
   the binned histogram by non-negative least squares (Lawson and Hanson), a bin
   weighing as much as its length, and rounded, within what there is of each bin.
   Finer bins leave less free but allow fewer documents a pattern, so the plan is
   made for each (units, max_docs) of ``FITS``, and the one with the fewest
   sequences stands.
3. Residual pieces, from the longest on, go to the sequence with the least room that
   holds them: to what binning and short patterns leave free, then to new sequences.
   This works on counts: pieces of one length and sequences of one fill are handled
   together, so the time does not depend on the number of pieces.
4. Pieces are range-sorted by (length, row), which splits a hot length over as many
   tasks as it needs; prefix sums of one number a partition give each piece its rank,
   and the plan, whose size depends on ``seq_len`` alone, its sequence and offset.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each
on their own; an empty table gives no pieces; other columns are ignored, whatever
their names. A very long text is encoded in parts cut at white space.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common, tokens
from panelcast.llm.packing import along_curve

SEQ_LEN = 4096
FITS = ((64, 4), (128, 3), (256, 2))


def patterns(units: int, max_docs: int) -> np.ndarray:
    """Rows that count the bins 1 to ``units`` of every set of at most ``max_docs`` bins
    that add up to ``units``."""

    def parts(left: int, most: int, docs: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
        elif docs:
            for first in range(min(left, most), -(-left // docs) - 1, -1):
                for rest in parts(left - first, first, docs - 1):
                    yield (first, *rest)

    return np.array([np.bincount(p, minlength=units + 1)[1:] for p in parts(units, units, max_docs)])


def nnls(matrix: np.ndarray, target: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """The non-negative ``x`` that makes ``|matrix @ x - target|`` least."""
    n = matrix.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n):
        gain = matrix.T @ (target - matrix @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance:
            break
        active[best] = True
        while True:
            trial = np.zeros(n)
            trial[active] = np.linalg.lstsq(matrix[:, active], target, rcond=None)[0]
            if (trial[active] > 0).all():
                break
            down = active & (trial <= 0)
            # As far towards the trial as all stay non-negative; who reaches zero leaves.
            x = x + np.min(x[down] / (x[down] - trial[down])) * (trial - x)
            active &= x > tolerance * 1e-3
            x[~active] = 0
            if not active.any():
                trial = x
                break
        x = trial
    return x


def repeat_counts(histogram: np.ndarray, units: int, max_docs: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, repeats), most repeats first. ``histogram[k]`` counts pieces of length
    ``k + 1``; no pattern asks for more pieces of a bin than are left."""
    bins = np.ceil(np.arange(1, len(histogram) + 1) * units / len(histogram)).astype(int)
    left = np.bincount(bins, weights=histogram, minlength=units + 1)[1:].astype(np.int64)
    if not left.sum():
        return []
    rows, weight = patterns(units, max_docs), np.arange(1, units + 1) / units
    fit = nnls(rows.T * weight[:, None], left / left.sum() * weight) * left.sum()
    out = []
    for i in np.argsort(-fit, kind="stable"):
        used = rows[i] > 0
        n = min(round(float(fit[i])), int((left[used] // rows[i][used]).min()))
        if n > 0:
            left -= n * rows[i]
            out.append((rows[i], n))
    return out


class Plan:
    """Rows (length, first rank, pieces a sequence, first sequence, sequences, offset):
    the pieces of one length, from a rank on, go side by side at ``offset`` to
    sequences in a row."""

    def __init__(self, histogram: np.ndarray, units: int, max_docs: int):
        self.size = len(histogram)
        self.left = {i + 1: int(n) for i, n in enumerate(histogram) if n}
        self.rank = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.n_sequences = 0
        #: By room left: stretches (first sequence, sequences).
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        by_bin: dict[int, list[int]] = {}
        for length in sorted(self.left):
            by_bin.setdefault(-(-length * units // self.size), []).append(length)
        for pattern, n in repeat_counts(histogram, units, max_docs):
            groups = [(self._new(n), n, self.size)]
            for b in np.repeat(np.arange(1, units + 1), pattern).tolist():
                groups = [g for group in groups for g in self._fill(*group, by_bin[b])]
            for first, count, room in groups:
                self._open(first, count, room)
        for length in sorted(self.left, reverse=True):
            self._residual(length)

    def _new(self, n: int) -> int:
        self.n_sequences += n
        return self.n_sequences - n

    def _open(self, first: int, count: int, room: int) -> None:
        if room and count:
            if room not in self.open:
                insort(self.rooms, room)
            self.open.setdefault(room, []).append((first, count))

    def _place(self, length: int, each: int, first: int, count: int, room: int) -> None:
        self.rows.append((length, self.rank[length], each, first, count, self.size - room))
        self.rank[length] += each * count
        self.left[length] -= each * count

    def _fill(self, first: int, count: int, room: int, lengths: list[int]) -> Iterator[tuple[int, int, int]]:
        """One piece of the bin with these ``lengths`` for each of the sequences, the
        longest first; (first, sequences, room) of those with one fill."""
        while count:
            while not self.left[lengths[-1]]:
                lengths.pop()
            length = lengths[-1]
            n = min(count, self.left[length])
            self._place(length, 1, first, n, room)
            yield first, n, room - length
            first, count = first + n, count - n

    def _residual(self, length: int) -> None:
        while n := self.left[length]:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, count = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[at]
            else:
                room = self.size
                count = -(-n // (room // length))
                first = self._new(count)
            each = min(room // length, n)
            used = min(count, n // each)
            self._place(length, each, first, used, room)
            self._open(first, used, room - each * length)
            self._open(first + used, count - used, room)

    def arrays(self) -> list[np.ndarray]:
        return list(np.array(sorted(self.rows), np.int64).reshape(-1, 6).T)


PIECES = "row long, doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, seq_len: int) -> DataFrame:
    """A written table of the pieces of ``docs``: consecutive ids of a document, the end
    id behind its last, as little-endian bytes, ``seq_len`` of them but for the last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, row = tokens.encoder(tokenizer), TaskContext.get().partitionId() << 36
        dtype = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"

        def made(doc: np.ndarray, ids: np.ndarray, lengths: np.ndarray, doc_ids: pa.Array, before: np.ndarray) -> pa.RecordBatch:
            """Pieces of documents whose ids stand in ``ids`` in a row; ``before`` ids of each are gone already."""
            count = -(-lengths // seq_len)
            which = np.repeat(np.arange(len(doc)), count)
            start = (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * seq_len
            size = np.minimum(seq_len, lengths[which] - start)
            start += before[which]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(which))), doc_ids.take(pa.array(doc[which])).cast(pa.int64()), pa.array((start // seq_len).astype(np.int32)), pa.array(start), pa.array(size), tokens.cut(ids, size, dtype)],
                names=["row", "doc_id", "piece", "start", "length", "ids"],
            )

        def long_text(text: str, doc_id: pa.Array) -> Iterator[pa.RecordBatch]:
            rest, done, one = np.zeros(0, np.int64), 0, np.zeros(1, np.int64)
            for part in common.slices(text, tokens.BATCH_BYTES // 2):
                rest = np.concatenate([rest, enc.encode(pa.array([part]))[0]])
                if full := len(rest) // seq_len * seq_len:
                    yield made(one, rest[:full], np.array([full]), doc_id, one + done)
                    rest, done = rest[full:], done + full
            rest = np.append(rest, end_id)
            yield made(one, rest, np.array([len(rest)]), doc_id, one + done)

        for batch in batches:
            for part in common.by_bytes(batch, limit=tokens.BATCH_BYTES):
                texts, doc_ids = common.strings(part.column("text")), part.column("doc_id")
                if part.num_rows == 1 and texts.nbytes > tokens.BATCH_BYTES:
                    found = long_text(texts[0].as_py(), doc_ids)
                else:
                    ids, lengths = tokens.with_end_id(*enc.encode(texts), end_id)
                    found = iter([made(np.arange(len(lengths)), ids, lengths, doc_ids, np.zeros(len(lengths), np.int64))])
                for out in found:
                    row += out.num_rows
                    yield out

    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    return common.staged(common.map_arrow(rows, encode, PIECES), "pattern-pieces")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, seq_len: int = SEQ_LEN, fits: tuple[tuple[int, int], ...] = FITS) -> DataFrame:
    """The pieces of all documents of ``docs (doc_id, text)``, packed into few sequences.

    Per piece: doc_id, piece (from 0), start (the document's ids before it), length,
    sequence_id, offset (in the sequence, without gaps) and ids, little-endian 32-bit.
    The driver sees one count for each length up to ``seq_len``.
    """
    cut = pieces(docs, tokenizer or tokens.word_tokenizer_path(), end_id, seq_len)
    histogram = np.zeros(seq_len, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r["length"] - 1] = r["n"]
    plan = min((Plan(histogram, *fit) for fit in fits), key=lambda p: p.n_sequences)
    length_of, rank_of, each, first_seq, _, offset_of = plan.arrays()
    before = np.concatenate([[0], np.cumsum(histogram)])  # at length - 1: shorter pieces
    spot = before[length_of - 1] + rank_of  # where a plan row's pieces begin, in the order by length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch, "ids"):
                at, length = part.column("at").to_numpy(), part.column("length").to_numpy()
                row = np.searchsorted(spot, at, side="right") - 1
                nth, within = np.divmod(at - spot[row], each[row])
                data = part.column("ids")
                width = len(data[0].as_py()) // int(length[0])
                raw = np.frombuffer(b"".join(data.to_pylist()), f"<u{width}")
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(first_seq[row] + nth), pa.array(offset_of[row] + within * length), tokens.cut(raw, length, "<u4")],
                    names=["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"],
                )

    ranked = along_curve(cut.select("row", "doc_id", F.col("length").alias("key"), F.lit(1).cast("long").alias("n")))
    placed = cut.join(ranked.hint("merge"), "row").select("doc_id", "piece", "start", "length", "at", "ids")
    return common.map_arrow(placed, place, "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary")
