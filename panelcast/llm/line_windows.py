"""Line dedup by overlapping three-line windows.

The lines of a text that hold more than white space are numbered; every three
consecutive ones form a window, whose trimmed lines are hashed to 128 bits. Over
the whole corpus the document of least id that has a window owns it. In all other
documents the window is a later occurrence, as it is in the owner where it starts
three or more lines behind its first place there. The lines that later
occurrences cover are merged and removed, and the first occurrence stays.

Only hashes are grouped and joined. Each document reports a window once, the
counts are aggregated per task before the shuffle, and the equi-join that finds
later occurrences is one that adaptive execution splits where a window is hot.

Defined cases: a text of fewer than three such lines has no window and stays as
it is; blank lines stay unless all other lines go, which leaves the empty text; a
null text counts as empty; a null id comes after all others; rows that repeat an
id count as one document, whose own rows are not deduplicated against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common

WINDOW = 3
LAST = (1 << 63) - 1


def order_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(LAST))


def window_hashes(text: str, window: int = WINDOW) -> tuple[list[int], np.ndarray]:
    """Places of the numbered lines among all lines, and the hash of each window as
    two 64-bit integers (shape: windows, 2)."""
    import xxhash

    lines = [x.strip(" \t\r").encode() for x in text.split("\n")]
    places = [i for i, x in enumerate(lines) if x]
    kept = [lines[i] for i in places]
    hashes = b"".join(xxhash.xxh3_128_digest(b"\n".join(kept[i : i + window])) for i in range(len(kept) - window + 1))
    return places, np.frombuffer(hashes, "<i8").reshape(-1, 2)


def covered(hashes: np.ndarray, foreign: set[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged ranges (first, last) of line numbers that later occurrences cover."""
    first: dict[tuple[int, int], int] = {}
    out: list[tuple[int, int]] = []
    for i, key in enumerate(map(tuple, hashes.tolist())):
        if key in foreign or i >= first.setdefault(key, i) + window:
            if out and i <= out[-1][1] + 1:
                out[-1] = (out[-1][0], i + window - 1)
            else:
                out.append((i, i + window - 1))
    return out


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A written table (doc, h1, h2) of every document's distinct windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch):
                found = [np.unique(window_hashes(t, window)[1], axis=0) for t in common.strings(part.column("text")).to_pylist()]
                doc = np.repeat(part.column("doc").to_numpy(), [len(x) for x in found])
                flat = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["doc", "h1", "h2"])

    rows = docs.select(order_key().alias("doc"), common.text_or_empty().alias("text"))
    return common.staged(common.map_arrow(rows, run, "doc long, h1 long, h2 long"), "line-windows")


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the later occurrences of repeated windows cut out of ``text``,
    and three new columns: n_lines (numbered lines), n_removed, and removed (the
    merged ranges of removed line numbers, as ``first-last``, comma-joined)."""
    found = windows(docs, window)
    owners = found.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("other")).filter("owner < other")
    later = (
        found.join(owners.select("h1", "h2", "owner"), ["h1", "h2"]).filter("doc > owner")
        .groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("__later"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.by_bytes(batch):
                rows = [
                    one(t or "", {(x["h1"], x["h2"]) for x in f or ()})
                    for t, f in zip(part.column("text").to_pylist(), part.column("__later").to_pylist(), strict=True)
                ]
                text, n_lines, n_removed, removed = (list(x) for x in zip(*rows, strict=True))
                kinds = dict(text=(text, pa.string()), n_lines=(n_lines, pa.int64()), n_removed=(n_removed, pa.int64()), removed=(removed, pa.string()))
                arrays = [pa.array(*kinds[c]) if c in kinds else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    def one(text: str, foreign: set[tuple[int, int]]) -> tuple[str, int, int, str]:
        places, hashes = window_hashes(text, window)
        ranges = covered(hashes, foreign, window)
        gone = {places[i] for a, b in ranges for i in range(a, b + 1)}
        if gone:
            kept = [x for i, x in enumerate(text.split("\n")) if i not in gone]
            text = "\n".join(kept) if len(gone) < len(places) else ""
        return text, len(places), len(gone), ",".join(f"{a}-{b}" for a, b in ranges)

    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    keyed = docs.select(*columns).withColumn("text", common.text_or_empty()).withColumn("__doc", order_key())
    joined = keyed.join(later.withColumnRenamed("doc", "__doc"), "__doc", "left").select(*columns, "__later")
    names = [*columns, "n_lines", "n_removed", "removed"]
    schema = joined.drop("__later").schema.add("n_lines", "long").add("n_removed", "long").add("removed", "string")
    return common.map_arrow(joined, cut, schema)
