"""Exact token counts of whole texts by a byte-level BPE tokenizer.

An Arrow function returns lengths only. Batches hold about the same number of
bytes of text each; a text longer than a batch is split. A text may be split in
front of a single space that a non-space follows: the tokenizer's own pattern
begins a new piece there whatever stands before, so the count of a text is the
sum over its pieces. Distinct pieces of a batch are found by Arrow and new ones
are encoded in one ``encode_batch`` call, so frequent pieces are encoded once.

Defined cases: a null or empty text has 0 tokens; special strings inside a text
count as the library counts them by default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common, tokens

#: Distinct pieces remembered by a worker before it starts afresh; bounds memory.
MAX_PIECES = 400_000
#: A space in front of a word: safe whatever white space stands before it.
SAFE = re.compile(r" (?=\w)")
#: White space next to a space: such texts are cut by SAFE only.
RUNS = r" [\s\pZ\x1c-\x1f\x{85}]|^ $"

_COUNTERS: dict[str, PieceCounter] = {}


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceCounter:
    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        self.tok, self.max_pieces, self.seen = tokens.load_tokenizer(path), max_pieces, {}
        count = lambda x: len(self.tok.encode(x, add_special_tokens=False))
        if any(count(a + b) != count(a) + count(b) for a, b in (("a", " b"), ("a \n", " b"), ("1  ", " (b"))):
            raise ValueError(f"{path}: this tokenizer joins pieces across spaces; its texts can't be cut there")

    def _lengths(self, pieces: list[str]) -> np.ndarray:
        if len(self.seen) > self.max_pieces:
            self.seen.clear()
        if new := [x for x in pieces if x not in self.seen]:
            self.seen.update(zip(new, map(len, self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        runs = pc.match_substring_regex(texts, RUNS).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(runs):
            text = texts[int(i)].as_py()
            at = [0, *(m.start() for m in SAFE.finditer(text)), len(text)]
            out[i] = self._lengths([text[a:b] for a, b in zip(at, at[1:], strict=False)]).sum()
        plain = np.flatnonzero(~runs)
        if len(plain):
            out[plain] = self._plain(texts.take(pa.array(plain)))
        return out

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Texts in which a non-space follows every space: each space begins a piece."""
        parts = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(parts.flatten())
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        after = self._lengths([f" {x}" for x in distinct])[codes]
        heads = codes[offsets[:-1]]
        used, where = np.unique(heads, return_inverse=True)
        after[offsets[:-1]] = self._lengths([distinct[i] for i in used])[where]
        ends = np.concatenate([[0], np.cumsum(after)])
        return np.diff(ends[offsets])


def segments(text: str, limit: int) -> list[str]:
    """``text`` split in front of safe spaces into parts of about ``limit`` characters."""
    out, lo = [], 0
    while len(text) - lo > limit and (m := SAFE.search(text, lo + limit)):
        out.append(text[lo : m.start()])
        lo = m.start()
    return [*out, text[lo:]]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, batch_bytes: int = common.BATCH_BYTES) -> DataFrame:
    """Every row of ``docs (doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit
    (more than ``limit`` tokens). One narrow stage without a shuffle."""
    tokenizer = tokenizer or byte_tokenizer_path()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = PieceCounter(tokenizer)
        counter = _COUNTERS[tokenizer]
        for batch in batches:
            for part in common.by_bytes(batch, limit=batch_bytes):
                texts = common.strings(part.column("text"))
                if part.num_rows == 1 and pc.binary_length(texts)[0].as_py() > batch_bytes:
                    n = np.array([sum(int(counter.count(pa.array([x]))[0]) for x in segments(texts[0].as_py(), batch_bytes))])
                else:
                    n = counter.count(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = common.map_arrow(docs.select("doc_id", common.text_or_empty().alias("text")), lengths, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
