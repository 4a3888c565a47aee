from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import packing, token_counts, token_files, tokens


@pytest.fixture(scope="module")
def word_tok():
    return tokens.load_tokenizer(tokens.word_tokenizer_path())


@pytest.fixture(scope="module")
def byte_tok():
    return tokens.load_tokenizer(token_counts.byte_tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected_ids(tok, corpus, end):
    return {i: tok.encode(t or "", add_special_tokens=False).ids + [end] for i, t in corpus}


def test_piece_encoder_equals_the_library(word_tok):
    rng = random.Random(5)
    bits = ["a", "Zürich", "É", "été", "l'été.", "Don't", "x.", "x,,", "9a", "ß", "Σς", "İ", "é", "ＡＢ", "<|endoftext|>", "日本", "a.b", "...", "ÿ", "×", "÷", "ÐÞ"]
    gaps = [" ", "  ", "\n", "\t", "　", " ", "", "\x1c", "\x85"]
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    enc = tokens.PieceEncoder(tokens.word_tokenizer_path(), max_parts=500)
    for lo in range(0, 3000, 300):
        ids, lengths = enc.encode(pa.array(texts[lo : lo + 300]))
        want = [word_tok.encode(t, add_special_tokens=False).ids for t in texts[lo : lo + 300]]
        assert lengths.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_piece_encoder_refuses_a_tokenizer_that_keeps_spaces():
    with pytest.raises(ValueError, match="white space"):
        tokens.PieceEncoder(token_counts.byte_tokenizer_path())


def test_piece_counter_equals_the_library(byte_tok):
    rng = random.Random(6)
    bits = [" ", " ", "\n", "\t", "a", "b1", "'s", "'ll", "!", "é", " ", "　", "<|endoftext|>", "12", "\x1c", "\x85", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(8000)] + ["", " ", "  "]
    counter = token_counts.PieceCounter(token_counts.byte_tokenizer_path(), max_pieces=300)
    assert counter.count(pa.array(texts)).tolist() == [len(byte_tok.encode(t).ids) for t in texts]


def test_segments_join_to_the_text_and_keep_the_count(byte_tok):
    text = "one  two\n three (four) five's <|endoftext|> six " * 40
    for limit in (1, 7, 100, 10_000):
        parts = token_counts.segments(text, limit)
        assert "".join(parts) == text
        assert sum(len(byte_tok.encode(p).ids) for p in parts) == len(byte_tok.encode(text).ids)


def test_counts(clashing, corpus, byte_tok):
    got = {(r.doc_id, r.n_bytes): r for r in token_counts.count_tokens(clashing, batch_bytes=1000).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        n = len(byte_tok.encode(t or "").ids)
        r = got[i, len((t or "").encode())]
        assert (r.n_tokens, r.over_limit) == (n, n > 1024)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
def test_elias_fano_round_trip(n):
    rng = random.Random(n)
    for top in (1, 10**3, 10**12, 2**62):
        values = np.sort(np.array([rng.randrange(top) for _ in range(n)], np.uint64))
        coded = token_files.EliasFano.of(values)
        data = coded.to_bytes()
        back = token_files.EliasFano.from_bytes(data)
        assert back.select_all().tolist() == values.tolist()
        assert [back.select(i) for i in range(n)] == values.tolist()
        if n == 1000 and top == 10**12:
            assert len(data) < 8 * n * 0.6


def test_token_files_round_trip(spark, clashing, corpus, word_tok, tmp_path):
    manifest = token_files.write_token_files(clashing, str(tmp_path / "f"), file_ids=500)
    assert manifest.count() > 3
    want, start = expected_ids(word_tok, corpus, 1), 0
    got = sorted(token_files.read_token_files(manifest, str(tmp_path / "f")).withColumn("crc", F.crc32("ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(want)
    for r in got:
        assert (r.start, r.n_tokens, r.crc) == (start, len(want[r.doc_id]), crc(want[r.doc_id]))
        start += r.n_tokens
    name = manifest.orderBy("part", "file").first()["name"]
    file = token_files.TokenFile(str(tmp_path / "f"), name)
    assert file.document(1).tolist() == want[got[1].doc_id]


def test_token_files_of_null_ids_and_ties(make, tmp_path):
    docs = make([(None, "x y"), (3, "b"), (3, "a"), (-5, ""), (None, None)])
    rows = token_files.read_token_files(token_files.write_token_files(docs, str(tmp_path / "g")), str(tmp_path / "g")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [-5, 3, 3, None, None]
    assert [r.n_tokens for r in rows] == [1, 2, 2, 1, 3]


def test_token_files_are_read_by_as_many_tasks_as_files(spark, make, tmp_path):
    docs = make([(i, f"word {i} " * 30) for i in range(400)])
    manifest = token_files.write_token_files(docs, str(tmp_path / "i"), file_ids=300)
    files = manifest.count()
    rows = token_files.read_token_files(manifest, str(tmp_path / "i")).select("doc_id", F.spark_partition_id().alias("task"))
    tasks = {r.task for r in rows.collect()}
    assert files == len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("n", [1, 63, 64, 65, 700])
def test_elias_fano_selects_ranges(n):
    rng = random.Random(n)
    for top in (1, 500, 10**9):
        values = np.sort(np.array([rng.randrange(top) for _ in range(n)], np.uint64))
        coded = token_files.EliasFano.of(values)
        for _ in range(40):
            lo = rng.randrange(n)
            hi = rng.randrange(lo, n + 1)
            assert coded.select_range(lo, hi).tolist() == values[lo:hi].tolist()


def test_token_files_of_nothing(make, tmp_path):
    manifest = token_files.write_token_files(make([]), str(tmp_path / "h"))
    assert token_files.read_token_files(manifest, str(tmp_path / "h")).count() == 0


def test_hilbert_curve_visits_all_cells_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert_key(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing_places_every_id_once(clashing, corpus, word_tok):
    want = expected_ids(word_tok, corpus, 2)
    rows = packing.pack(clashing, seq_len=64).withColumn("crc", F.crc32("ids")).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.crc) == (at, len(ids), crc(ids[at : at + r.length])) and r.length > 0
            at += r.length
        assert at == len(ids)
    for s, parts in by_seq.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or s == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_packing_puts_copies_side_by_side(make):
    text = "quiet morning in the green garden by the river " * 20
    docs = [(i, f"ocean {i} music paper candle {i * 37} " * 20) for i in range(40)] + [(100, text), (7000, text), (300, text)]
    rows = packing.pack(make(docs)).orderBy("sequence_id", "offset").select("doc_id").distinct().count()
    assert rows == 43
    order = [r.doc_id for r in packing.pack(make(docs)).orderBy("sequence_id", "offset").collect()]
    spots = sorted(order.index(i) for i in (100, 300, 7000))
    assert spots[-1] - spots[0] <= 4


def test_packing_of_nothing_and_of_null(make):
    assert packing.pack(make([])).count() == 0
    r = packing.pack(make([(None, None)])).collect()
    assert [(x.doc_id, x.start, x.length, x.sequence_id, x.offset) for x in r] == [(None, 0, 1, 0, 0)]
