"""Token ids of many texts at once, for tokenizers that drop white space.

A text is cut at ASCII white space. Such a tokenizer encodes the pieces
independently, so the ids of a text are those of its pieces in order. The
distinct pieces of a batch are found by Arrow, new ones go to the tokenizers
library, and the ids are put together by numpy. A piece of plain letters, with or
without a full stop or comma behind it, is lower-cased and parted by Arrow; its new
parts go straight to the library's model in the byte alphabet. All other pieces
pass the whole tokenizer in one ``encode_batch`` call.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelcast.llm import common

#: Distinct parts of pieces that a worker remembers before it starts afresh; bounds
#: its memory.
MAX_PARTS = 500_000
#: Bytes of text encoded at a time: the more, the fewer distinct pieces come twice.
BATCH_BYTES = 8 << 20

#: Pieces whose letters a lower-casing tokenizer with a byte alphabet handles one
#: by one: Latin letters that normalisation leaves alone, then perhaps a mark.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
LETTERS = "^[a-zß-öø-ÿ]+$"
MARKS = (".", ",")
#: The byte alphabet writes the bytes 0xC3 and 0x80 to 0xBF of those letters thus:
#: bytes that Latin-1 prints stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
ALPHABET = {c: "".join(_HIDDEN.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}

_ENCODERS: dict[str, PieceEncoder] = {}


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_tokenizer(path: str):
    """The tokenizer of a file, on one thread: Spark's tasks already use all cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker and file; workers are reused between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def listed(strings: pa.Array) -> list[str]:
    """The strings as Python objects; by numpy, which is faster than one by one."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Ids of texts, remembering the ids of parts of pieces seen before."""

    def __init__(self, path: str, max_parts: int = MAX_PARTS):
        self.tok = load_tokenizer(path)
        probe = [self.tok.encode(x, add_special_tokens=False).ids for x in ("a b", "a", "b", "\n a\t")]
        if probe[0] != probe[1] + probe[2] or probe[3] != probe[1]:
            raise ValueError(f"{path}: this tokenizer keeps white space; its texts can't be cut there")
        self.model, self.max_parts = self.tok.model, max_parts
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        probe = ["Ab,", "ÀÖß.", "Ñandú", "x", "É,", "DIE.", "öffnen"]
        want = [i for x in self.tok.encode_batch(probe, add_special_tokens=False) for i in x.ids]
        try:
            self.plain = True
            self._clear()
            self.plain = self.encode(pa.array(probe))[0].tolist() == want
        except ValueError:
            self.plain = False
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self._slots(pa.array(["", *MARKS]))  # slots 0, 1, 2

    def _learn(self, parts: pa.Array) -> None:
        letters = pc.match_substring_regex(parts, LETTERS).to_numpy(zero_copy_only=False) if self.plain else np.zeros(len(parts), bool)
        parts = listed(parts)
        others = iter(self.tok.encode_batch_fast([x for x, m in zip(parts, letters, strict=True) if not m], add_special_tokens=False))
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(x if x.isascii() else x.translate(ALPHABET))] if m else next(others).ids for x, m in zip(parts, letters, strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        base = len(self.slot)
        self.slot.update(zip(parts, range(base, base + len(parts)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))])

    def _slots(self, parts: pa.Array) -> np.ndarray:
        """Slots of distinct parts; new ones are learnt."""
        slots = np.fromiter((self.slot.get(x, -1) for x in listed(parts)), np.int64, len(parts))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = len(self.slot) + np.arange(len(new))
            self._learn(parts.take(pa.array(new)))
        return slots

    def _gather(self, slots: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``slots`` in a row, and where those of each end (from 0)."""
        lengths = length[slots]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids[np.repeat(start[slots] - ends[:-1], lengths) + np.arange(ends[-1])], ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text). A single text beyond a
        batch is encoded part by part."""
        if common.is_long(texts, BATCH_BYTES):
            ids = np.concatenate([self._encode(x)[0] for x in common.parts(texts, BATCH_BYTES)])
            return ids, np.array([len(ids)])
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(pieces.flatten())
        distinct = coded.dictionary
        mark = np.zeros(len(distinct), np.int64)
        if self.plain:
            plain = pc.match_substring_regex(distinct, PLAIN)
            for i, m in enumerate(MARKS):
                mark[pc.and_(plain, pc.ends_with(distinct, m)).to_numpy(zero_copy_only=False)] = i + 1
            distinct = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(distinct, "".join(MARKS))), distinct)
        parts = pc.dictionary_encode(distinct)
        if len(self.slot) > self.max_parts:
            self._clear()
        core = self._slots(parts.dictionary)[parts.indices.to_numpy()]
        ids, ends = self._gather(np.column_stack([core, mark]).ravel(), self.start, self.length, self.ids)
        starts, ends = ends[:-1:2], ends[2::2]  # of the distinct pieces
        ids, ends = self._gather(coded.indices.to_numpy(), starts, ends - starts, ids)
        return ids, np.diff(ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()])


def with_end_id(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` put behind the ids of every text."""
    out = np.full(len(ids) + len(lengths), end_id, ids.dtype)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths + 1) - 1] = False
    out[keep] = ids
    return out, lengths + 1


def cut(ids: np.ndarray, lengths: np.ndarray, dtype: str) -> pa.Array:
    """The ids of each text as little-endian bytes of ``dtype``."""
    data = np.ascontiguousarray(ids.astype(dtype))
    offsets = np.concatenate([[0], np.cumsum(lengths)]) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]
    ).cast(pa.binary())
