"""Token-id files with Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents (ascending id, nulls last) as one
array, then three coded parts and a footer::

    "EFTOK001" | ids, little-endian, 2 or 4 bytes each | boundaries | document ids | null ids
    | footer: the numbers of HEAD | "EFTOK001"

Boundaries and document ids are rising sequences and are kept in Elias-Fano
form: of each value the lowest ``l`` bits lie packed in a row, and the rest is a
bitmap in which value ``i`` sets bit ``(value >> l) + i``. A sample of where
every 64th set bit lies lets ``select`` find any value in constant time. That
takes about ``2 + log2(universe / n)`` bits a value, and no 64-bit table.

Each task of a range partitioning by id writes its files through a streaming
writer; each attempt of a task writes under a name of its own and then moves the
file to the name that all attempts share, with the same bytes. Files are
reached by pyarrow's file systems, so any folder with a URI of theirs can be used.

Defined cases: a null or empty text gives the end id alone; repeated ids stay
side by side, ordered by text; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm import common, tokens

MAGIC = b"EFTOK001"
#: Footer: documents, documents without id, ids, bytes of an id, least document
#: id, then bytes of the boundary part and of the document part.
HEAD = struct.Struct("<QQQQqQQ")
#: An Elias-Fano part: values, low bits, bytes of the low part, bytes of the bitmap.
PART = struct.Struct("<QQQQ")
SAMPLE = 64
#: Ids in a file before the next one begins.
FILE_IDS = 8 << 20
#: Documents whose boundaries are selected at a time.
READ_DOCS = 4096


class EliasFano:
    """A rising sequence of non-negative integers in Elias-Fano form."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        """Value ``i``, by the sample before it and a scan of a short stretch of the bitmap."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        seen = -bin(int(self.high[byte]) & ((1 << (at & 7)) - 1)).count("1")
        while seen + (ones := bin(int(self.high[byte])).count("1")) <= left:
            seen, byte = seen + ones, byte + 1
        bit = [b for b in range(8) if self.high[byte] >> b & 1][left - seen]
        return int(self._low(np.array([i]))[0]) | (byte * 8 + bit - i) << self.low_bits

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """Values ``lo`` to ``hi``: the bitmap is read from the sample before the first to the
        one behind the last."""
        first, behind = int(self.samples[lo // SAMPLE]), -(-hi // SAMPLE)
        end = int(self.samples[behind]) if behind < len(self.samples) else len(self.high) * 8
        at = np.flatnonzero(np.unpackbits(self.high[first >> 3 : (end >> 3) + 1], bitorder="little")) + (first >> 3) * 8
        i = np.arange(lo, hi)
        return (at[at >= first][lo % SAMPLE :][: hi - lo] - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def select_all(self) -> np.ndarray:
        """All values in order."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        i = np.arange(self.n)
        return (at - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def to_bytes(self) -> bytes:
        return PART.pack(self.n, self.low_bits, len(self.low), len(self.high)) + b"".join(x.tobytes() for x in (self.low, self.high, self.samples.astype("<u4")))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, low, high = PART.unpack_from(data)
        part = lambda lo, size, kind="u1": np.frombuffer(data, kind, size, lo)
        return cls(n, low_bits, part(PART.size, low), part(PART.size + low, high), part(PART.size + low + high, -(-n // SAMPLE), "<u4"))


class TokenFileWriter:
    """Streams ids into a file; only lengths and document ids stay in memory."""

    def __init__(self, folder: str, name: str, width: int, attempt: int = 0):
        self.fs, root = common.open_fs(folder)
        self.path, self.part, self.width = f"{root}/{name}", f"{root}/.{name}.{attempt}.part", width
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.lengths: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.n_ids = self.nulls = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(ids.astype(f"<u{self.width}")))
        self.lengths.append(lengths)
        known = [x for x in doc_ids if x is not None]
        self.doc_ids += known
        self.nulls += len(doc_ids) - len(known)
        self.n_ids += len(ids)

    def close(self) -> tuple[int, int]:
        """Writes the coded parts and puts the file in place; (documents, ids)."""
        ends = np.concatenate([[0], *[x for x in self.lengths]]).cumsum()
        least = self.doc_ids[0] if self.doc_ids else 0
        bounds = EliasFano.of(ends).to_bytes()
        docs = EliasFano.of(np.array([x - least for x in self.doc_ids], np.uint64)).to_bytes()
        self.out.write(bounds + docs + HEAD.pack(len(ends) - 1, self.nulls, self.n_ids, self.width, least, len(bounds), len(docs)) + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(ends) - 1, self.n_ids


class TokenFile:
    """Reads a file's coded parts; ids are read by range."""

    def __init__(self, folder: str, name: str):
        fs, root = common.open_fs(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self._at(size - HEAD.size - len(MAGIC), HEAD.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is no token file")
        self.n_docs, self.nulls, self.n_ids, self.width, self.least, bounds, docs = HEAD.unpack_from(tail)
        coded = self._at(len(MAGIC) + self.n_ids * self.width, bounds + docs)
        self.bounds, self.docs = EliasFano.from_bytes(coded[:bounds]), EliasFano.from_bytes(coded[bounds:])

    def _at(self, lo: int, size: int) -> bytes:
        return self.file.read_at(size, lo)

    def doc_ids(self, lo: int, hi: int) -> list[int | None]:
        """Ids of documents ``lo`` to ``hi`` of the file; those without come last."""
        known = self.n_docs - self.nulls
        found = self.docs.select_range(lo, min(hi, known)).tolist() if lo < known else []
        return [x + self.least for x in found] + [None] * (hi - lo - len(found))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the file's array."""
        return np.frombuffer(self._at(len(MAGIC) + lo * self.width, (hi - lo) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))


MANIFEST = "part int, file int, name string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the token files of ``docs (doc_id, text)`` into ``folder`` and returns
    their manifest (part, file, name, n_docs, n_ids), in order of part and file.

    The texts are shuffled once, by range of ``doc_id``. ``folder`` must be a URI or
    path that all executors share.
    """
    tokenizer = tokenizer or tokens.word_tokenizer_path()
    rows = (
        docs.select("doc_id", common.text_or_empty().alias("text"))
        .repartitionByRange(common.shuffle_partitions(docs), F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    )
    fs, root = common.open_fs(folder)
    fs.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc, part, done, out = tokens.encoder(tokenizer), task.partitionId(), [], None
        width = 2 if enc.vocab_size <= 1 << 16 else 4

        def finish() -> None:
            done.append((part, len(done), out.path.rpartition("/")[2], *out.close()))

        for batch in batches:
            for piece in common.by_bytes(batch, limit=tokens.BATCH_BYTES):
                out = out or TokenFileWriter(folder, f"part-{part:06d}-{len(done):06d}.eftok", width, task.taskAttemptId())
                ids, lengths = tokens.with_end_id(*enc.encode(common.strings(piece.column("text"))), end_id)
                out.add(piece.column("doc_id").to_pylist(), ids, lengths)
                if out.n_ids >= file_ids:
                    finish()
                    out = None
        if out:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(list(zip(*done, strict=True)) or [[]] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["part", "file", "name", "n_docs", "n_ids"],
        )

    return common.staged(common.map_arrow(rows, write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before
    it), n_tokens and its ids as little-endian 32-bit integers (binary).

    The driver sums one number per written partition; the files are dealt to as many
    tasks as there are files, up to the shuffle partitions, and a task holds one file's
    coded parts and a few megabytes of ids at a time.
    """
    totals = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    before, run = {}, 0
    for part in sorted(totals):
        before[part], run = run, run + totals[part]
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from documents(TokenFile(folder, row["name"]), before[row["part"]] + row["earlier"])

    def documents(f: TokenFile, start: int) -> Iterator[pa.RecordBatch]:
        for block in range(0, f.n_docs, READ_DOCS):
            n = min(READ_DOCS, f.n_docs - block)
            ends, doc_ids, lo = f.bounds.select_range(block, block + n + 1).astype(np.int64), f.doc_ids(block, block + n), 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + common.BATCH_BYTES // 4, side="right")) - 1)
                lengths = np.diff(ends[lo : hi + 1])
                ids = tokens.cut(f.ids(int(ends[lo]), int(ends[hi])), lengths, "<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[lo:hi], pa.int64()), pa.array(ends[lo:hi] + start, pa.int64()), pa.array(lengths, pa.int64()), ids],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                lo = hi

    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")
    files = manifest.select("part", "file", "name", earlier.alias("earlier"))
    # Neither adaptive coalescing nor the window's own partitioning may join the readers.
    dealt = files.repartitionById(common.shuffle_partitions(manifest), (F.col("part") + F.col("file")).cast("int"))
    return common.map_arrow(dealt, read, "doc_id long, start long, n_tokens long, ids binary")
