"""Benchmark decontamination with one Aho-Corasick automaton.

The normalised words of the test items are numbered; every ten consecutive words
of an item (or all words of a shorter item) are one key of the automaton, a
sequence of word numbers. Texts are normalised byte for byte, so that places in
the normalised text are places in the original; their words are numbered in the
same way by Arrow, and each text runs through the automaton once. Words that no
item has get the number 0, which no key contains.

The items are written once into the shared folder, and each worker builds the
automaton from there; the driver sees the number of their bytes only. The scan is a
single narrow stage without a shuffle. An automaton holds up to ``MAX_ITEM_BYTES`` of
text; a larger benchmark is written in shards of about that size, so that a worker
holds one of them, and the findings are merged per document. A long text runs
through the automaton part by part, which carries its state over.

Defined cases: null texts have no words; repeated rows are each reported; an
empty benchmark or an empty table hits nothing; items that repeat a window are all
named; of a null item id the name is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common

WINDOW = 10
#: Text of test items that one automaton holds; it bounds what a worker keeps.
MAX_ITEM_BYTES = 16 << 20
#: Word numbers that go through the automaton at a time.
STRETCH = 1 << 18

#: Byte table: A-Z become lower case, all ASCII but letters and digits a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)

_MATCHERS: dict[str, Matcher] = {}


def fold(texts: pa.Array) -> pa.Array:
    """Normalised texts, each byte in its old place."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    folded = FOLD[np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))] if data else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(folded))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and the bounds of each text's words."""
    parts = pc.ascii_split_whitespace(fold(texts))
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return flat.filter(pa.array(full)), ends[offsets]


class Matcher:
    """The automaton over the windows of (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        import ahocorasick

        flat, bounds = words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = pc.unique(flat)
        codes = self.number(flat)
        keys: dict[tuple[int, ...], set[str]] = {}
        for (name, _), lo, hi in zip(items, bounds, bounds[1:], strict=False):
            for i in range(lo, max(lo + (hi > lo), hi - window + 1)):
                keys.setdefault(tuple(codes[i : min(i + window, hi)].tolist()), set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in keys.items():
            self.automaton.add_word(key, (len(key), sorted(names)))
        if keys:
            self.automaton.make_automaton()
        self.empty = not keys

    def number(self, flat: pa.Array) -> np.ndarray:
        return pc.add(pc.fill_null(pc.index_in(flat, self.vocabulary), -1), 1).to_numpy(zero_copy_only=False)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[list[list[int]], list[str]]]]:
        """Number of words of each text; its hit ranges of words (merged, end
        exclusive) and the items found in it."""
        if common.is_long(texts):
            n, spot = np.zeros(1, np.int64), Spots(self.automaton, self.empty)
            for part in common.parts(texts):
                codes = self.number(words(part)[0])
                spot.add(codes)
                n += len(codes)
            return n, [spot.found()]
        flat, bounds = words(texts)
        codes, out = self.number(flat), []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            spot = Spots(self.automaton, self.empty)
            spot.add(codes[lo:hi])
            out.append(spot.found())
        return np.diff(bounds), out


class Spots:
    """What the automaton finds in the words of one text, which come in stretches."""

    def __init__(self, automaton, empty: bool):
        self.automaton, self.empty = automaton, empty
        self.search = None
        self.ranges: list[list[int]] = []
        self.names: set[str] = set()

    def add(self, codes: np.ndarray) -> None:
        for lo in range(0, 0 if self.empty else len(codes), STRETCH):
            stretch = tuple(codes[lo : lo + STRETCH].tolist())
            if self.search is None:
                self.search = self.automaton.iter(stretch)
            else:
                self.search.set(stretch)  # goes on in the state it is in
            for end, (length, found) in self.search:
                self.names.update(found)
                start = end - length + 1
                while self.ranges and self.ranges[-1][1] >= start:
                    start = min(start, self.ranges.pop()[0])
                self.ranges.append([start, end + 1])

    def found(self) -> tuple[list[list[int]], list[str]]:
        return self.ranges, sorted(self.names)


def word_places(text: str) -> list[tuple[int, int]]:
    """Character offsets of each word in the original text."""
    folded = text.encode().translate(bytes(FOLD.tolist()))
    out, chars = [], 0
    for part in folded.split(b" "):
        size = len(part.decode())
        if size:
            out.append((chars, chars + size))
        chars += size + 1
    return out


def matcher_of(folder: str, shard: int, window: int) -> Matcher:
    """The automaton of a shard of the items in ``folder``; a worker keeps the last one."""
    key = f"{folder}/shard={shard}/{window}"
    if key not in _MATCHERS:
        _MATCHERS.clear()
        fs, root = common.open_fs(folder)
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(f"{root}/shard={shard}", allow_not_found=True)) if f.path.endswith(".parquet"))
        tables = [pq.read_table(f, columns=["item_id", "text"], filesystem=fs, partitioning=None) for f in files]
        items = [pair for t in tables for pair in zip(t["item_id"].to_pylist(), t["text"].to_pylist(), strict=True)]
        _MATCHERS[key] = Matcher(items, window)
    return _MATCHERS[key]


def _scan(rows: DataFrame, folder: str, shard: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher = matcher_of(folder, shard, window)
            for part in common.by_bytes(batch):
                n, found = matcher.find(common.strings(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array([r for r, _ in found], pa.list_(pa.list_(pa.int64()))), pa.array([x for _, x in found], pa.list_(pa.string()))],
                    names=["row", "doc_id", "n_words", "ranges", "items"],
                )

    return common.map_arrow(rows, run, "row long, doc_id long, n_words long, ranges array<array<long>>, items array<string>")


def hit_words(ranges: str) -> str:
    """SQL: words in the union of ranges, which come sorted by their start."""
    fold_one = "struct(greatest(a.top, r[1]) AS top, a.n + greatest(0L, r[1] - greatest(a.top, r[0])) AS n)"
    return f"aggregate({ranges}, struct(0L AS top, 0L AS n), (a, r) -> {fold_one}, a -> a.n)"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Every row of ``docs (doc_id, text)`` against ``benchmark (item_id, text)``:
    doc_id, n_words, ranges (hit words, end exclusive), items (sorted ids found)
    and n_hit."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), common.text_or_empty().alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = 1 if size <= max_item_bytes else -(-size // max_item_bytes) + 1
    folder = common.scratch_path(docs.sparkSession, "decontam-items")
    items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))).write.partitionBy("shard").parquet(folder)
    rows = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", common.text_or_empty().alias("text"))
    if shards == 1:
        found = _scan(rows, folder, 0, window)
    else:
        rows = common.staged(rows.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
        each = [_scan(rows, folder, i, window) for i in range(shards)]
        together = each[0]
        for part in each[1:]:
            together = together.unionAll(part)
        found = together.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.select("doc_id", "n_words", "ranges", "items", F.expr(hit_words("ranges")).alias("n_hit"))
